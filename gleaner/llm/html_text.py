"""Main text of HTML pages by maximum-scoring subsequence.

A page is a stream of tokens: words score positive, tags negative, with
weights learned from labelled pages.  A page labels itself where it marks its
content with ``article`` or ``main``: tokens inside are content, all others
are not.  One linear scan finds the contiguous stretch of the highest sum.
Containers that announce boilerplate by name, role or class score negative
words and never enter the text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SAMPLE = 2000  # labelled pages that the weights are learned from, at most

# fixed values: element names
RAW = "script style title textarea xmp iframe noembed noframes noscript template svg math select object canvas audio video".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split())
INLINE = set("a abbr b bdi bdo big br button cite code data del dfn em font i img input ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
BOILERPLATE = set("nav header footer aside form menu dialog button head search".split())
CONTENT = {"article", "main"}
# fixed values: words of a class or id, and roles, that announce boilerplate
CUES = set("""ad ads advert adverts advertisement adsense adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices
    newsletter subscribe subscription sidebar widget widgets related recommended recommendations share sharing social menu menus nav navbar
    navigation breadcrumb breadcrumbs pagination pager footer masthead comment comments commentlist disqus reply replies respond
    popup modal overlay login signup""".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*'|[\"'<])*?)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_BARE = re.compile(r"(?:^|\s)hidden(?:\s|$|=)", re.I)

WORD, TAG, BREAK = 0, 1, 2


def announces(name: str, attrs: str) -> bool:
    """Whether an element names itself as boilerplate."""
    if name in BOILERPLATE:
        return True
    if not attrs or name in ("html", "body", "main"):
        return False
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), (a or b or c).lower()
        if key in ("class", "id"):
            hints = set(re.split(r"[^a-z0-9]+", value))
            if hints & CUES if name != "article" else hints & {"comment", "comments", "reply", "ad", "ads", "advert"}:
                return True
        elif key == "role" and value in ROLES or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return True
    return bool(_BARE.search(_ATTR.sub(" ", attrs)))


def stream(page: str) -> Iterator[tuple[int, str, str]]:
    """(kind, place, value): text pieces, tags and block breaks in page order.

    The place is ``content`` (inside a marked content element), ``inset``
    (boilerplate in there), ``boilerplate`` or ``page``.
    """
    stack: list[tuple[str, bool, bool]] = []  # name, in boilerplate, in content
    at = 0

    def place(skip: bool | None = None) -> str:
        skipped, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        skipped = skipped if skip is None else skip
        return ("inset" if skipped else "content") if inside else "boilerplate" if skipped else "page"

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield WORD, place(), page[at:m.start()]
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        block = name in BLOCK
        if block:
            yield BREAK, place(), name
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    # an inline end tag closes nothing beyond its own block
                    if block or not any(s[0] in BLOCK for s in stack[i + 1:]):
                        del stack[i:]
                    break
        else:
            if block and stack:  # a block ends an open paragraph, an item the item before
                if stack[-1][0] == "p" or name == stack[-1][0] and name in ("li", "dt", "dd", "tr", "td", "th"):
                    stack.pop()
            skip, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            attrs = m["attrs"]
            cue = announces(name, attrs)
            yield TAG, place(skip or cue), name
            if name not in VOID and not attrs.endswith("/") and (block or cue):
                stack.append((name, skip or cue, inside or name in CONTENT and not cue))
    if at < len(page):
        yield WORD, place(), page[at:]


def counted(page: str) -> Counter:
    """Labelled evidence of one page: (feature, is content) -> count; empty if it marks no content."""
    seen: Counter = Counter()
    for kind, place, value in stream(page or ""):
        if kind == WORD:
            seen["#word", place] += len(value.split())
        elif kind == TAG:
            seen[value if value in BLOCK or value in INLINE else "#other", place] += 1
    if not any(p == "content" for _, p in seen):
        return Counter()
    out: Counter = Counter()
    for (feature, place), n in seen.items():
        out[feature, place == "content"] += n
    return out


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> dict[str, float]:
    """Cost of each element name, from at most ``sample`` pages chosen by a hash of their id.

    Cost is the log ratio of a tag's rate per word outside and inside of marked
    content, between 0.01 and 8.  The result has a fixed number of entries.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for t in b.column("html"):
                total.update(counted(t.as_py()))
        if total:
            yield pa.record_batch([pa.array([f for f, _ in total]), pa.array([c for _, c in total]), pa.array(list(total.values()), pa.int64())], ["feature", "content", "n"])

    marked = pages.filter(F.col(html_col).rlike("(?i)<(article|main)\\b"))
    chosen = marked.orderBy(F.xxhash64(id_col), id_col).select(F.col(id_col).alias("id")).limit(sample)
    texts = marked.join(F.broadcast(chosen.distinct()), F.col(id_col) == F.col("id"), "left_semi").select(F.col(html_col).alias("html"))
    rows = texts.mapInArrow(run, "feature string, content boolean, n long").groupBy("feature", "content").agg(F.sum("n").alias("n")).collect()
    inside, outside = {r.feature: r.n for r in rows if r.content}, {r.feature: r.n for r in rows if not r.content}
    words_in, words_out = inside.pop("#word", 0) + 1, outside.pop("#word", 0) + 1
    names = (inside.keys() | outside.keys()) - {"#word"}
    return {f: min(8.0, max(0.01, math.log(((outside.get(f, 0) + 0.5) / words_out) / ((inside.get(f, 0) + 0.5) / words_in)))) for f in names}


def extract(page: str | None, costs: dict[str, float]) -> str:
    """The main text: blocks of the best stretch, one per line."""
    if not page:
        return ""
    tokens = list(stream(page))
    marked = any(place == "content" and kind == WORD and value.strip() for kind, place, value in tokens)
    best = total = 0.0
    start, region = 0, (0, 0)
    for i, (kind, place, value) in enumerate(tokens):
        if kind == BREAK:
            continue
        if kind == WORD:
            n = len(value.split())
            total += 0 if place == "inset" else n if place == "content" or place == "page" and not marked else -n
        else:  # a marked element vouches for its tags
            total -= 0.01 if place == "content" else 0 if place == "inset" else costs.get(value, 1.0)
        if total > best:
            best, region = total, (start, i + 1)
        elif total < 0:
            total, start = 0.0, i + 1
    blocks, block = [], []
    for kind, place, value in tokens[slice(*region)]:
        if kind == BREAK:
            blocks.append("".join(block))
            block = []
        elif place in ("content", "page"):
            block.append(html.unescape(value) if kind == WORD else " " if value == "br" else "")
    blocks.append("".join(block))
    return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def main_text(pages: DataFrame, costs: dict[str, float] | None = None, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, text, n_chars) per row; null and empty pages give an empty text.

    Whole pages are read.  ``costs`` are learned from the pages themselves if
    not given.  Repeated rows stay; an empty table gives an empty table.
    """
    costs = learn(pages, id_col, html_col) if costs is None else costs
    picked = pages.select(F.col(id_col).alias("id"), *keep, F.col(html_col).alias("html"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            texts = [extract(t.as_py(), costs) for t in b.column("html")]
            yield pa.record_batch([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                  [*b.schema.names[:-1], "text", "n_chars"])

    return picked.mapInArrow(run, f"{kinds}, text string, n_chars long")
