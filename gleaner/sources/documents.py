"""Records from landed text: HTML tables, markdown, feeds, listings, text blocks.

A document is taken apart inside its row with whole-text regular expressions
and then exploded; only text_blocks and listing_links shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import vocab as V
from ..functions.html import strip_html, unescape
from ..functions.text import (clean_title, collapse, contains_any, extract_url, first_nonblank, head, news_announcement,
                              once, plausible_title, strip, strip_markdown, text)
from ..functions.urls import path_depth, resolve
from ..operators.location import classify_text, clean_location


def _all(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _tags(*names) -> Column:
    return F.array(*[F.lit(n) if isinstance(n, str) else n for n in names])


# ---- HTML tables ---------------------------------------------------------

def html_rows(docs: DataFrame, *keys: str) -> DataFrame:
    """Table rows with at least three cells: arrays of cell text and links.

    A row holds the cells from its start tag to the next start tag of a row,
    whichever table that is in; each end tag after the third cell gives the row
    once.  So the cells that follow a table inside a cell count to the last
    inner row.  Rows and cells without an end tag give nothing, and a cell
    begins anew at a start tag inside it.  Comments are left out.  ``pos`` is
    the number of the row's start tag.
    """
    plain = F.regexp_replace(text("body"), r"(?s)<!--.*?(?:-->|\z)", "")
    rows = docs.select(*keys, F.posexplode(F.split(plain, r"(?i)<tr\b[^>]*>")).alias("at", "row"))
    begun = F.slice(F.split("row", r"(?i)<t[dh]\b[^>]*>"), 2, F.length("row") + 1)
    cells = F.transform(F.filter(begun, lambda p: p.rlike(r"(?i)</t[dh]\s*>")), lambda p: F.regexp_extract(p, r"(?is)\A(.*?)</t[dh]\s*>", 1))
    rows = rows.withColumn("cells", cells).where(F.size("cells") >= 3)
    after_third = F.regexp_replace("row", r"(?is)\A(?:(?>.*?<t[dh]\b[^>]*>)(?>.*?</t[dh]\s*>)){3}", "")
    rows = rows.withColumn("ends", F.size(F.split(after_third, r"(?i)</tr\s*>")) - 1).where("ends > 0")
    split = F.transform("cells", lambda c: F.struct(
        strip(unescape(F.regexp_replace(c, r"<[^>]*>", ""))).alias("text"),
        _all(c, r"""(?is)<a\b[^>]*?\bhref\s*=\s*["'](http[^"']*)["']""").alias("links")))
    rows = rows.select(*keys, F.col("at").alias("pos"), split.alias("cells"), "ends")
    return rows.select(*keys, "pos", "cells", F.explode(F.sequence(F.lit(1), "ends"))).drop("col")


def table_listings(docs: DataFrame, *keys: str) -> DataFrame:
    """Company / role / location / application rows as records."""
    cell = lambda i: F.get("cells", F.lit(i))
    rows = html_rows(docs, *keys).select(*keys, "pos", *[text(cell(i)["text"]).alias(n) for i, n in enumerate(("company", "role", "place"))],
                                         F.coalesce(F.get(cell(3)["links"], F.lit(0)), F.get(cell(0)["links"], F.lit(0)), F.get(cell(1)["links"], F.lit(0)), F.lit("https://simplify.jobs")).alias("target"))
    locked = F.col("company").contains("🔒") | F.col("role").contains("🔒") | F.col("place").contains("🔒")
    rows = rows.where((F.col("company") != "") & ~F.lower("company").isin("company", "name", "organization") & (F.col("role") != "") & ~locked)
    rows = classify_text(rows, clean_location("place"), clean_location(F.concat_ws(" ", "role", "company")))
    where = F.when(F.col("loc.raw") != "", F.col("loc.raw")).otherwise(F.col("place"))
    return rows.select(*keys, "pos", F.concat_ws(" — ", "company", "role").alias("name"), F.col("company").alias("organizer"),
                       F.concat(F.col("role"), F.lit(" position at "), F.col("company"), F.lit(". Location: "), first_nonblank("place", F.lit("Various")), F.lit(".")).alias("description"),
                       F.lit("Students / New Grads (check listing)").alias("eligibility"), where.alias("location"), F.col("loc.label").alias("mode"), F.lit("Free").alias("fee"),
                       F.lit("Competitive / Check listing").alias("stipend"), F.lit("Apply ASAP (Rolling)").alias("deadline"), F.col("target").alias("application_link"), F.col("target").alias("website"),
                       _tags("internship", "simplifyjobs", "software-engineering").alias("tags"), F.lit("open").alias("status"),
                       F.col("loc.mode").alias("location_mode"), F.col("loc.label").alias("location_label"), F.nullif(F.col("loc.country"), F.lit("")).alias("country"))


# ---- markdown ------------------------------------------------------------

_BLOCK = r"(?md)((?:^[^\S\n]*\|(?:[^\n]*\|)?[^\S\n]*(?:\n|\z))+)"


def markdown_rows(docs: DataFrame, *keys: str) -> DataFrame:
    """Rows of pipe tables: ``cells`` as (header, value) pairs and the raw line.

    A run of pipe lines is a table, its first line that is no separator is the
    header.
    """
    blocks = docs.select(*keys, F.posexplode(_all(text("body"), _BLOCK)).alias("table", "block"))
    lines = F.filter(F.transform(F.split("block", "\n"), lambda x: strip(x)), lambda x: x != "")
    cut = F.transform(lines, lambda x: F.struct(x.alias("line"), F.split(x, r"\|").alias("parts")))
    parsed = F.transform(cut, lambda r: F.struct(r["line"].alias("line"), F.transform(
        F.slice(r["parts"], 2, F.greatest(F.size(r["parts"]) - 2, F.lit(0))), lambda c: strip(c)).alias("cells")))
    kept = F.filter(parsed, lambda r: (F.size(r["cells"]) > 0) & ~F.forall(r["cells"], lambda c: c.rlike(r"\A[-:\s]+\z")))
    rows = once(once(blocks, _rows=kept), _head=F.transform(F.get("_rows", F.lit(0))["cells"], lambda c: F.lower(strip_markdown(c))))
    rows = rows.select(*keys, "table", "_head", F.posexplode(F.slice("_rows", 2, F.greatest(F.size("_rows") - 1, F.lit(0)))).alias("pos", "r"))
    pairs = F.transform("_head", lambda h, i: F.struct(h.alias("h"), F.coalesce(F.get("r.cells", i), F.lit("")).alias("v")))
    return once(rows.where(F.size("r.cells") >= 2).select(*keys, "table", "pos", "_head", "r", F.col("r.line").alias("line")), cells=pairs).select(*keys, "table", "pos", "cells", "line")


def _cell(*headers: str) -> Column:
    """First header with text in it; a repeated header counts by its last column."""
    one = lambda h: F.coalesce(F.try_element_at(F.filter("cells", lambda c: c["h"] == h), F.lit(-1))["v"], F.lit(""))
    return first_nonblank(*[one(h) for h in headers])


def markdown_programs(docs: DataFrame, *keys: str) -> DataFrame:
    """Program records from pipe tables."""
    rows = once(once(markdown_rows(docs, *keys), _raw=_cell(*V.NAME_HEADERS)), _plain=strip_markdown("_raw"))
    low = F.lower("_plain")
    rows = rows.where((F.length("_plain") >= 2) & ~F.col("_plain").startswith("!") & ~low.isin(V.TABLE_NAME_REJECT) & ~contains_any(low, ["badge", "shields.io", "img.shields"]))
    rows = once(rows, name=strip(F.regexp_replace("_plain", r"\A[⭐\s*]+", ""))).where(F.length("name") >= 2)
    link = first_nonblank(extract_url("_raw"), extract_url(_cell("application process")), extract_url(_cell("application")), extract_url(_cell("link")), extract_url("line"), F.lit("https://github.com"))
    plain = lambda default, *h: first_nonblank(strip_markdown(_cell(*h)), F.lit(default))
    return rows.select(*keys, "table", "pos", "name", F.concat(F.lit("Open source program / mentorship: "), F.col("name")).alias("description"),
                       plain("Open to all", "eligibility", "requirements", "type").alias("eligibility"), plain("Online / Remote", "location", "mode").alias("mode"), F.lit("Free").alias("fee"),
                       plain("Check program page", "stipend", "awards", "rewards").alias("stipend"),
                       plain("Annual / Check page", "timeline", "deadline", "deadline (approx.)", "status 2025").alias("deadline"),
                       link.alias("application_link"), link.alias("website"), F.lit("open").alias("status"))


def positional_programs(docs: DataFrame, *keys: str) -> DataFrame:
    """Program records by column position: name, description, eligibility, deadline.

    The first row of a table is its header unless a separator comes first.
    """
    blocks = docs.select(*keys, F.posexplode(_all(text("body"), _BLOCK)).alias("table", "block"))
    lines = F.filter(F.transform(F.split("block", "\n"), lambda x: strip(x)), lambda x: x != "")
    parsed = F.filter(F.transform(F.transform(lines, lambda x: F.split(x, r"\|")), lambda p: F.transform(
        F.slice(p, 2, F.greatest(F.size(p) - 2, F.lit(0))), lambda c: strip(c))), lambda r: F.size(r) >= 2)
    ruled = lambda r: F.forall(r, lambda c: c.rlike(r"\A[-:]*\z"))
    data = F.filter(F.col("_rows"), lambda r, i: ~ruled(r) & ((i > 0) | ruled(F.get("_rows", F.lit(0)))))
    rows = once(blocks, _rows=parsed).select(*keys, "table", F.posexplode(data).alias("pos", "c"))
    cell = lambda i, default: F.coalesce(F.get("c", F.lit(i)), F.lit(default))
    linked = F.regexp_extract(cell(0, ""), r"\A\[([^\]]+)\]", 1)
    rows = once(rows, name=first_nonblank(linked, cell(0, ""))).where(F.length("name") >= 3)
    link = F.regexp_extract(cell(0, ""), r"\]\(([^)]+)\)", 1)
    check = "Check program page"
    return rows.select(*keys, "table", "pos", "name", F.lit("Open Source Community").alias("organizer"), cell(1, "").alias("description"),
                       cell(2, check).alias("eligibility"), F.lit("Remote / Online").alias("mode"), F.lit("Free").alias("fee"), cell(3, check).alias("deadline"),
                       first_nonblank(link, F.lit(check)).alias("application_link"), link.alias("website"), _tags("open-source").alias("tags"),
                       F.lit("open").alias("status"), F.lit("every-os-programs-github").alias("source"))


_ITEM = r"(?md)^((?:[*-]|\d+\.)\s+\[[^\]]+\]\((?:https?://[^)]*|)\)\s*(?:[-–—:]\s*.*)?)"
_ITEM_PARTS = r"(?md)^(?:[*-]|\d+\.)\s+\[([^\]]+)\]\((https?://[^)]*|)\)\s*(?:[-–—:]\s*(.*))?"


def markdown_list(docs: DataFrame, *keys: str) -> DataFrame:
    """Records from '- [Name](url) - text' items."""
    rows = docs.select(*keys, F.posexplode(_all(text("body"), _ITEM)).alias("pos", "item"))
    part = lambda i: strip(F.regexp_extract("item", _ITEM_PARTS, i))
    rows = rows.select(*keys, "pos", part(1).alias("name"), part(2).alias("_link"), part(3).alias("_note"))
    link = first_nonblank("_link", F.lit("https://github.com"))
    return rows.where((F.length("name") >= 2) & ~contains_any(F.lower("name"), ["badge", "awesome"])).select(
        *keys, "pos", "name", F.lit("Student / Research Organization").alias("organizer"),
        first_nonblank("_note", F.concat(F.col("name"), F.lit(" fellowship / student program"))).alias("description"),
        F.lit("Students / Graduates (check program details)").alias("eligibility"), F.lit("Check listing").alias("mode"), F.lit("Free").alias("fee"),
        F.lit("Stipend / Mentorship provided").alias("stipend"), F.lit("Annual / Check portal").alias("deadline"), link.alias("application_link"), link.alias("website"),
        _tags("fellowship", "student").alias("tags"), F.lit("open").alias("status"))


# name: (pattern of the section, category) -- fixed values
SECTIONS = {
    "hackathons": r"(?s)(# Hackathons & Competitions.*?)(?=##\s*2\.2\s*Competitions|\z)",
    "competitions": r"(?s)(##\s*2\.2\s*Competitions.*?)(?=##|\n#\s|\z)",
    "fellowships": r"(?s)(##\s*Student Fellowship Programs.*?)(?=##|\n#\s|\z)",
}


def _section(docs: DataFrame, category: str) -> DataFrame:
    return docs.withColumn("body", F.regexp_extract(text("body"), SECTIONS[category], 1)).where(F.col("body") != "")


def markdown_sections(docs: DataFrame, *keys: str) -> DataFrame:
    """Three named sections of a resources page, each with its own mapping."""
    def table(category: str, headers: list[str], reject: list[str], organizer: str, prize: str, tags: list[str], site: str) -> DataFrame:
        rows = markdown_rows(_section(docs, category), *keys).withColumn("_raw", _cell(*headers)).withColumn("name", strip_markdown("_raw"))
        rows = rows.where((F.col("name") != "") & ~F.lower("name").isin(reject))
        link = first_nonblank(extract_url("_raw"), extract_url("line"), F.lit(site))
        dates = strip_markdown(_cell("event dates", "status"))
        if category == "hackathons":
            note, due = F.concat(F.lit("Hackathon: "), F.col("name"), F.lit(". Dates: "), first_nonblank(dates, F.lit("Check listing"))), first_nonblank(dates, F.lit("Check event page"))
        else:
            note, due = F.concat(F.lit("Competitive challenge: "), F.col("name"), F.lit(". "), strip_markdown(_cell("status 2025"))), F.lit("Check competition portal")
        return rows.select(*keys, F.lit(category).alias("category"), "table", "pos", "name", F.lit(organizer).alias("organizer"), note.alias("description"),
                           first_nonblank(strip_markdown(_cell("location")), F.lit("Online")).alias("mode"), F.lit(prize).alias("prize"), due.alias("deadline"),
                           link.alias("application_link"), _tags(*tags).alias("tags"), F.lit(f"github-dipakkr-{category}").alias("source"))

    items = markdown_list(_section(docs, "fellowships"), *keys)
    listed = items.select(*keys, F.lit("fellowships").alias("category"), F.lit(0).alias("table"), "pos", "name", "organizer", "description", "mode", F.lit(None).cast("string").alias("prize"), "deadline",
                          "application_link", "tags", F.lit("github-dipakkr-fellowships").alias("source"))
    return (table("hackathons", ["event", "name"], ["event", "name", "#"], "Global / Student", "Prizes / Swag / Grants", ["hackathon", "global"], "https://mlh.io")
            .unionByName(table("competitions", ["name"], ["name", "id", "#"], "Global Competition Organizers", "Awards / Cash / Recognition", ["competition", "coding-challenge"], "https://unstop.com"))
            .unionByName(listed))


# ---- feeds, listings, search ---------------------------------------------

def _child(item: Column, *names: str) -> Column:
    """Text of the first child with one of the names, in document order."""
    body = F.regexp_extract(item, rf"(?is)<(?:[\w-]+:)?(?:{'|'.join(names)})(?:\s[^>]*[^/>]|\s)?>(.*?)</(?:[\w-]+:)?(?:{'|'.join(names)})\s*>", 1)
    return strip(unescape(F.regexp_replace(body, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")))


def feed_entries(docs: DataFrame, *keys: str, limit: Column | int | None = None) -> DataFrame:
    """RSS items and Atom entries with a title, all or the first ``limit`` per feed."""
    items = _all(text("body"), r"(?is)(<(?:item|entry)\b.*?</(?:item|entry)\s*>)")
    alternate = lambda i: F.coalesce(F.get(F.filter(_all(i, r"(?is)(<link\b[^>]*>)"), lambda g: g.contains("href") & (~g.contains("rel=") | g.rlike(r"""rel\s*=\s*["']alternate["']"""))), F.lit(0)), F.lit(""))
    parsed = F.transform(items, lambda i: F.struct(
        _child(i, "title").alias("title"),
        first_nonblank(_child(i, "link"), strip(F.regexp_extract(alternate(i), r"""(?is)href\s*=\s*["']([^"']*)["']""", 1))).alias("link"),
        _child(i, "pubdate", "published", "updated", "date").alias("published"),
        strip_html(_child(i, "description", "summary", "content")).alias("summary")))
    kept = head(F.filter(parsed, lambda e: e["title"] != ""), limit)
    return docs.select(*keys, F.posexplode(kept).alias("pos", "e")).select(*keys, "pos", "e.*")


def _reader_record(rows: DataFrame, keys: list[str], name: Column, link: Column, source: Column, description: Column) -> DataFrame:
    """Shared shape: what was not observed stays empty; a deadline is never invented."""
    blank = [F.lit("").alias(c) for c in ("organizer", "eligibility", "mode", "fee", "prize", "deadline")]
    return rows.select(*keys, name.alias("name"), link.alias("application_link"), link.alias("website"), description.alias("description"), *blank,
                       _tags("agent-reach").alias("tags"), F.lit("open").alias("status"), source.alias("source"))


def feed_records(entries: DataFrame, *keys: str) -> DataFrame:
    """Records from entries that carry ``source`` and ``filter`` of their feed."""
    rows = entries.withColumn("_name", clean_title("title")).where(F.col("link").startswith("http"))
    rows = rows.where(plausible_title("_name") & ((text("filter") != "keywords") | news_announcement(F.col("_name"), F.col("summary"))))
    return _reader_record(rows, [*keys, "pos"], F.col("_name"), F.col("link"), F.col("source"), strip(text("summary")))


def listing_links(docs: DataFrame, *keys: str, limit: int | None = None) -> DataFrame:
    """Distinct links of a listing page that look like detail pages, all or the first ``limit``.

    Input columns: url (of the page), body (markdown), source.
    """
    found = _all(text("body"), r"(\[[^\]\n]{3,}\]\([^)\s]+\))")
    rows = docs.select(*keys, "url", "source", F.posexplode(found).alias("pos", "l"))
    rows = rows.select(*keys, "url", "source", "pos", clean_title(F.regexp_extract("l", r"\[([^\]\n]{3,})\]", 1)).alias("name"),
                       resolve(F.col("url"), F.regexp_extract("l", r"\]\(([^)\s]+)\)", 1)).alias("target"))
    host = lambda c: F.lower(F.regexp_extract(c, r"\Ahttps?://([^/?#]+)", 1))
    rows = rows.where(plausible_title("name") & contains_any(F.lower("name"), V.LISTING_HINTS) & F.col("target").startswith("http")
                      & (host(F.col("target")) == host(F.col("url"))) & (path_depth("target") >= 2))
    first = rows.groupBy(*keys, "url", F.regexp_replace("target", r"/+\z", "").alias("_key")).agg(F.min_by(F.struct("name", "target", "source"), "pos").alias("r"), F.min("pos").alias("pos"))
    w = Window.partitionBy(*keys, "url").orderBy("pos")
    top = first if limit is None else first.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit)
    return _reader_record(top, [*keys, "pos"], F.col("r.name"), F.col("r.target"), F.col("r.source"), F.lit(""))


def search_records(hits: DataFrame, *keys: str) -> DataFrame:
    """Search hits (title, url, snippet) with a plausible title and a hint word."""
    rows = hits.where(text("url") != "").withColumn("_name", clean_title("title"))
    rows = rows.where(plausible_title("_name") & contains_any(F.lower("_name"), V.LISTING_HINTS))
    return _reader_record(rows, list(keys), F.col("_name"), F.col("url"), F.lit("reach:search:exa"), text("snippet"))


def reader_payload(docs: DataFrame, *keys: str) -> DataFrame:
    """Title line and the text after 'Markdown Content:'."""
    body = text("body")
    first = F.substring_index(F.regexp_replace(body, r"\A\s+", ""), "\n", 1)
    rest = F.regexp_extract(body, r"(?sm)^Markdown Content:[^\S\n]*$(.*)\z", 1)
    marked = body.rlike(r"(?m)^Markdown Content:\s*$")
    return docs.select(*keys, F.trim(F.regexp_extract(first, r"\ATitle:\s*(.+)\z", 1)).alias("title"),
                       F.when(marked, F.regexp_replace(rest, r"\A\s+", "")).otherwise(body).alias("text"))


# ---- text blocks and posts -----------------------------------------------

def _blocks(docs: DataFrame, keys: list[str], marker: str) -> DataFrame:
    """Lines of each record: a blank line ends it once its marker line was seen."""
    parts = docs.select(*keys, F.posexplode(F.split(text("body"), r"\n[^\S\n]*(?=\n)")).alias("pos", "part"))
    closed = parts.withColumn("_has", F.col("part").rlike(rf"(?m)^[^\S\n]*(?:{marker}):[^\S\n]*\S").cast("int"))
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return (closed.withColumn("record", F.coalesce(F.sum("_has").over(w), F.lit(0)))
            .groupBy(*keys, "record").agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("p"))   # parts of one document
            .select(*keys, "record", F.filter(F.transform(F.split(F.array_join(F.transform("p", lambda x: x["part"]), "\n"), "\n"), lambda x: strip(x)), lambda x: x != "").alias("lines")))


def _after(line: Column) -> Column:
    return strip(F.regexp_replace(line, r"\A[^:]*:", ""))


def post_blocks(docs: DataFrame, *keys: str) -> DataFrame:
    """Posts from 'Title: / URL: / Body:' blocks; other lines extend the body."""
    is_ = lambda x, *p: contains_prefix(x, p)

    def fold(acc: Column, x: Column) -> Column:
        return F.struct(
            F.when(is_(x, "Title:"), _after(x)).otherwise(acc["title"]).alias("title"),
            F.when(is_(x, "URL:", "Link:"), _after(x)).otherwise(acc["url"]).alias("url"),
            F.when(is_(x, "Body:", "Text:"), _after(x)).when(is_(x, "Title:", "URL:", "Link:"), acc["body"])
            .otherwise(F.concat(acc["body"], F.lit(" "), x)).alias("body"))

    start = F.struct(*[F.lit("").alias(c) for c in ("title", "url", "body")])
    rows = _blocks(docs, list(keys), "Title").withColumn("r", F.aggregate("lines", start, fold))
    return rows.where(F.col("r.title") != "").select(*keys, "record", "r.title", "r.url", "r.body")


def tweet_blocks(docs: DataFrame, *keys: str) -> DataFrame:
    """Short posts from 'Text: / URL: / Author:' blocks; other lines are ignored."""
    last = lambda *p: F.coalesce(_after(F.try_element_at(F.filter("lines", lambda x: contains_prefix(x, p)), F.lit(-1))), F.lit(""))
    rows = _blocks(docs, list(keys), "Text|Tweet")
    return rows.select(*keys, "record", last("Text:", "Tweet:").alias("text"), last("URL:", "Link:").alias("url"),
                       last("Author:", "User:").alias("author")).where(F.col("text") != "")


def contains_prefix(c: Column, prefixes) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out
