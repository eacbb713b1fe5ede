"""Facts extracted from landed page captures.

Every step is a projection of one capture row; the only shuffle is the final
choice of one capture per canonical URL, which aggregates before it shuffles.
Input columns: url, final_url, status, error, body and optionally tier
(0 = direct, higher = fallback transport) and capture_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import html, urls
from ..functions import vocab as V
from ..functions.dates import parse_published_date
from ..functions.text import found_terms, lits, strip, text
from .ranking import numbered

_STRETCH = 4096   # attempts whose running counts one window task makes

_LD = r"""(?is)<script[^>]+type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""
_NODE = "array<struct<path:array<int>,depth:int,node:string>>"


# ---- JSON-LD -------------------------------------------------------------

def _get(node: Column, key: str) -> Column:
    return F.get_json_object(node, f"$['{key}']")


def _elements(json: Column) -> Column:
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def _objects(json: Column, depth: Column) -> Column:
    """The JSON objects in a value: itself, or the items of a list one level deeper."""
    return (F.when(json.startswith("{"), F.array(F.struct((depth + 1).alias("depth"), json.alias("node"))))
            .when(json.startswith("["), F.transform(
                F.filter(_elements(json), lambda e: e.startswith("{")),
                lambda e: F.struct((depth + 2).alias("depth"), e.alias("node"))))
            .otherwise(F.expr("cast(array() as array<struct<depth:int,node:string>>)")))


def _children(parent: Column) -> Column:
    values = F.transform(lits([f"$['{k}']" for k in V.CHILD_KEYS]), lambda path: F.call_function("get_json_object", parent["node"], path))
    found = F.flatten(F.transform(F.array_compact(values), lambda v: _objects(v, parent["depth"])))
    return F.transform(found, lambda c, i: F.struct(
        F.concat(parent["path"], F.array(i)).alias("path"), c["depth"].alias("depth"), c["node"].alias("node")))


def _first_text(value: Column) -> Column:
    return F.when(value.startswith("["), F.get(_elements(value), F.lit(0))).otherwise(value)


def node_types(node: Column) -> Column:
    raw = F.coalesce(F.nullif(_get(node, "@type"), F.lit("")), _get(node, "type"))
    many = F.when(raw.startswith("["), _elements(raw)).when(raw.isNotNull(), F.array(raw)).otherwise(F.array().cast("array<string>"))
    return F.transform(many, lambda t: F.lower(F.trim(F.substring_index(t, "/", -1))))


def with_nodes(captures: DataFrame) -> DataFrame:
    """Add ``nodes``: every JSON-LD object of the page in document order."""
    blocks = F.transform(F.regexp_extract_all(text("body"), F.lit(_LD), F.lit(1)),
                         lambda b: F.regexp_replace(strip(html.unescape(b)), r"\A<!\[CDATA\[|\]\]>\z", ""))
    roots = F.flatten(F.transform(blocks, lambda b, i: F.transform(
        F.when(F.try_parse_json(b).isNotNull(), _objects(strip(b), F.lit(-1))),
        lambda r, j: F.struct(F.array(i, j).alias("path"), r["depth"].alias("depth"), r["node"].alias("node")))))
    df = captures.withColumn("_n0", F.coalesce(roots, F.array()).cast(_NODE))
    for level in range(1, V.JSONLD_DEPTH + 1):
        deeper = F.flatten(F.transform(F.col(f"_n{level - 1}"), _children))
        df = df.withColumn(f"_n{level}", F.filter(deeper, lambda n: n["depth"] <= V.JSONLD_DEPTH).cast(_NODE))
    levels = [f"_n{i}" for i in range(V.JSONLD_DEPTH + 1)]
    return df.withColumn("nodes", F.array_sort(F.concat(*levels))).drop(*levels)


def json_ld_nodes(captures: DataFrame, *keys: str) -> DataFrame:
    """One row per JSON-LD object: keys, position, node text, lower-cased types."""
    exploded = with_nodes(captures).select(*keys, F.posexplode("nodes").alias("pos", "n"))
    return exploded.select(*keys, "pos", F.col("n.node").alias("node"), node_types(F.col("n.node")).alias("types"))


def _entity(value: Column) -> Column:
    one = _first_text(value)
    return F.trim(text(F.when(one.startswith("{"), _get(one, "name")).otherwise(one)))


def _offer(value: Column) -> Column:
    one = _first_text(value)
    price = F.coalesce(F.nullif(_get(one, "price"), F.lit("")), _get(one, "highPrice"))
    return F.when(one.startswith("{") & (text(price) != ""),
                  F.trim(F.concat_ws(" ", text(_get(one, "priceCurrency")), price))).otherwise("")


def structured_facts(captures: DataFrame, as_of: str) -> DataFrame:
    """Add event and posting facts; the first node that gives a value wins."""
    def read(n: Column) -> Column:
        node = n["node"]
        types = node_types(node)
        event = F.arrays_overlap(types, lits(V.EVENT_TYPES))
        posting = ~event & F.arrays_overlap(types, lits(V.POSTING_TYPES))

        def day(key: str) -> Column:
            return parse_published_date(_first_text(_get(node, key)), as_of)

        status = F.lower(text(_get(node, "eventStatus")))
        title = F.coalesce(F.nullif(_get(node, "title"), F.lit("")), _get(node, "name"))
        host = F.coalesce(F.nullif(_get(node, "organizer"), F.lit("")), _get(node, "author"))
        return F.struct(
            html.clean_text(F.when(event, _get(node, "name")).when(posting, title)).alias("name"),
            F.when(event, day("startDate")).when(posting, day("datePosted")).alias("start"),
            F.when(event, day("endDate")).alias("end"),
            F.when(posting, day("validThrough")).alias("through"),
            F.when(event, _entity(host)).when(posting, _entity(_get(node, "hiringOrganization"))).otherwise("").alias("organizer"),
            F.when(event, _offer(_get(node, "offers"))).otherwise("").alias("prize"),
            F.when(event & (status.contains("cancel") | status.contains("postpone")),
                   F.concat(F.lit("eventStatus="), F.substring_index(status, "/", -1))).alias("called_off"))

    def first(field: str, blank: bool) -> Column:
        facts = F.col("_facts")
        keep = (lambda f: f[field] != "") if blank else (lambda f: f[field].isNotNull())
        value = F.get(F.filter(facts, keep), F.lit(0))[field]
        return F.coalesce(value, F.lit("")) if blank else value

    df = with_nodes(captures).withColumn("_facts", F.transform("nodes", read))
    return df.withColumns({
        "jsonld_name": first("name", True), "start_date": first("start", False), "end_date": first("end", False),
        "valid_through": first("through", False), "ld_organizer": first("organizer", True), "prize_text": first("prize", True),
        "called_off": text(first("called_off", False))}).drop("_facts", "nodes")


# ---- page facts ----------------------------------------------------------

def page_facts(captures: DataFrame) -> DataFrame:
    """Add title, og_title, meta_description, site_name and the visible text."""
    body = text("body")
    df = captures.withColumns({"_meta": html.meta_pairs(body), "visible": html.visible_text(body)})
    meta = F.col("_meta")

    def pick(*keys: str) -> Column:
        return html.clean_text(F.coalesce(*[F.nullif(html.meta_value(meta, k), F.lit("")) for k in keys], F.lit("")))

    title = html.clean_text(html.element_text(body, "title"))
    heading = html.clean_text(F.regexp_replace(html.element_text(body, "h1"), r"<[^>]+>", " "))
    return df.withColumns({
        "title": F.coalesce(F.nullif(title, F.lit("")), heading), "og_title": pick("og:title", "twitter:title"),
        "meta_description": pick("og:description", "twitter:description", "description"), "site_name": pick("og:site_name")}).drop("_meta")


def challenge_signals(facts: DataFrame) -> DataFrame:
    """Add the bot-check phrases of a page; body phrases count on thin pages only."""
    in_title = found_terms(F.lower(F.concat_ws("\n", "title", "og_title")), V.CHALLENGE_TITLES)
    thin = F.length(F.trim("visible")) < V.THIN_PAGE_CHARS
    in_body = F.when(thin, found_terms(F.lower("visible"), V.CHALLENGE_BODIES)).otherwise(F.array().cast("array<string>"))
    return facts.withColumn("challenge", F.concat(in_title, in_body))


def page_signals(facts: DataFrame) -> DataFrame:
    """Add closure phrases of the visible text and dead-page phrases of the title."""
    return facts.withColumns({"closed_signals": found_terms(F.lower("visible"), V.CLOSED_PHRASES),
                              "rot_signals": found_terms(F.lower("title"), V.ROT_PHRASES)})


def capture_error(status: Column, error: Column) -> Column:
    """Error code of a capture; '' when the page was read."""
    st = status.cast("string")
    return (F.when(text(error) != "", error).when(status.isNull(), F.lit("unexpected:none"))
            .when(status.isin(401, 403, 429), F.concat(F.lit("blocked_"), st))
            .when(status >= 400, F.concat(F.lit("http_"), st)).otherwise(""))


def evidence_kind(name: Column, has_date: Column, og: Column, description: Column, title: Column) -> Column:
    return (F.when((name != "") | has_date, "jsonld").when((og != "") | (description != ""), "opengraph")
            .when(title != "", "html").otherwise("none"))


EVIDENCE_COLUMNS = ("key url final_url status ok kind error title og_title jsonld_name description site_name organizer "
                    "start_date end_date valid_through prize_text closed_signals rot_signals challenge content_hash via").split()


def capture_evidence(captures: DataFrame, as_of: str) -> DataFrame:
    """Evidence of every single capture."""
    df = captures
    if "tier" not in df.columns:
        df = df.withColumn("tier", F.lit(0))
    if "capture_id" not in df.columns:
        df = df.withColumn("capture_id", F.lit(0).cast("bigint"))
    df = df.withColumn("key", urls.canonical_url("url")).withColumn("_code", capture_error(F.col("status"), F.col("error")))
    df = page_signals(challenge_signals(structured_facts(page_facts(df), as_of)))
    fetched = F.col("_code") == ""
    walled = fetched & (F.size("challenge") > 0)
    ok = fetched & ~walled
    has_date = F.coalesce("start_date", "end_date", "valid_through").isNotNull()
    kind = evidence_kind(F.col("jsonld_name"), has_date, F.col("og_title"), F.col("meta_description"), F.col("title"))
    none = F.array().cast("array<string>")

    def fact(c: str, alias: str | None = None) -> Column:
        return F.when(ok, F.col(c)).otherwise(F.lit("")).alias(alias or c)

    return df.select(
        "key", "url", F.coalesce("final_url", "url").alias("final_url"), "status", ok.alias("ok"),
        F.when(ok, kind).otherwise("none").alias("kind"),
        F.when(walled, F.concat(F.lit("challenge_page:"), F.substring(F.get("challenge", F.lit(0)), 1, 24)))
        .otherwise(F.col("_code")).alias("error"),
        fact("title"), fact("og_title"), fact("jsonld_name"), fact("meta_description", "description"), fact("site_name"),
        fact("ld_organizer", "organizer"),
        *[F.when(ok, F.col(c)).alias(c) for c in ("start_date", "end_date", "valid_through")],
        fact("prize_text"),
        F.when(ok, F.col("closed_signals")).otherwise(none).alias("closed_signals"),
        F.when(ok, F.col("rot_signals")).when(F.col("status").isin(404, 410), F.array(F.col("_code"))).otherwise(none).alias("rot_signals"),
        F.when(fetched, F.col("challenge")).otherwise(none).alias("challenge"),
        F.when(fetched, F.substring(F.sha2(text("body"), 256), 1, 16)).otherwise("").alias("content_hash"),
        F.when(F.col("tier") > 0, "reach").otherwise("direct").alias("via"), "tier", "capture_id")


def network_health(captures: DataFrame, least: int = V.BREAKER_MIN_ATTEMPTS, rate: float = V.BREAKER_RATE) -> DataFrame:
    """One row (attempts, hard_failures, tripped_at, network_down): the first place of the run where hard failures dominate.

    The direct captures are attempts in the order of ``capture_id``, nulls first;
    of equal ids, failures come last.  The breaker trips at the first attempt, from the ``least``-th on, at which the
    share of hard failures so far is ``rate`` or more; ``tripped_at`` is its
    capture_id, null if it never trips, and the counts are those up to it, or
    of the whole run.  No captures: zeros, null and false.

    The running counts are a prefix scan on two levels: rows are numbered over
    sorted ranges, the failures of a range are summed, and a window runs within
    each range only.
    """
    error = capture_error(F.col("status"), F.col("error"))
    hard = error.startswith("network:") | error.startswith("unexpected:")
    direct = captures.where(F.col("tier") == 0) if "tier" in captures.columns else captures
    # a stretch is a run of numbers, so its running counts need no row of another one
    rows = numbered(direct.select("capture_id", hard.cast("bigint").alias("hard")), "attempt", F.asc_nulls_first("capture_id"), "hard")
    rows = rows.withColumn("stretch", F.floor((F.col("attempt") - 1) / _STRETCH))
    sums = rows.groupBy("stretch").agg(F.sum("hard").alias("failures"))
    earlier = _running(sums, "stretch", "failures").select("stretch", "before")
    within = Window.partitionBy("stretch").orderBy("attempt").rowsBetween(Window.unboundedPreceding, 0)
    counts = (rows.withColumn("here", F.sum("hard").over(within)).join(earlier, "stretch")
              .select("capture_id", "attempt", (F.col("here") + F.col("before")).alias("failures")))
    trips = (F.col("attempt") >= least) & (F.col("failures") >= F.lit(rate) * F.col("attempt"))
    place = F.struct(F.col("attempt").alias("attempts"), F.col("failures").alias("hard_failures"), F.col("capture_id").alias("tripped_at"))
    ends = counts.agg(F.min(F.when(trips, place)).alias("trip"), F.max(place).alias("last"))
    return ends.select(*[F.coalesce(f"trip.{c}", f"last.{c}", F.lit(0)).cast("bigint").alias(c) for c in ("attempts", "hard_failures")],
                       F.col("trip.tripped_at").alias("tripped_at"), F.col("trip").isNotNull().alias("network_down"))


def _running(sums: DataFrame, place: str, value: str) -> DataFrame:
    """Add ``before``: the sum of the values of all earlier places, by groups of _STRETCH places and once more over the groups."""
    group = F.floor(F.col(place) / _STRETCH).alias("group")
    sums = sums.withColumn("group", group)
    tops = sums.groupBy("group").agg(F.sum(value).alias("top"))
    over = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)   # a row for _STRETCH^2 rows of the run
    tops = tops.select("group", F.coalesce(F.sum("top").over(over), F.lit(0)).alias("base"))
    inside = Window.partitionBy("group").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return (sums.withColumn("own", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(tops, "group")
            .withColumn("before", F.col("own") + F.col("base")).drop("own", "base", "group"))


def build_evidence(captures: DataFrame, as_of: str) -> DataFrame:
    """One row per canonical URL.

    A fallback capture replaces the direct one when that was refused, failed
    or had no facts, and the fallback has some; status and final URL stay those
    of the direct one.  Dead links stand.
    """
    ev = capture_evidence(captures, as_of)
    titled = (F.col("title") != "") | (F.col("og_title") != "") | (F.col("jsonld_name") != "")
    dated = F.coalesce("start_date", "end_date", "valid_through").isNotNull()
    retry_error = F.lit(False)
    for p in ("blocked_", "http_5", "network:", "unexpected:"):
        retry_error = retry_error | F.col("error").startswith(p)
    retry = (F.size("rot_signals") == 0) & F.when(F.col("ok"), (F.col("kind") == "none") | ~(titled | dated)).otherwise(retry_error)
    direct = F.col("tier") == 0
    usable = F.col("ok") & ((F.col("kind") != "none") | titled)
    quality = F.when(direct & ~retry, 0).when(~direct & usable, 1).when(direct, 2).otherwise(3)
    place = F.struct(quality.alias("quality"), "tier", "capture_id", "url")
    best = F.min_by(F.struct(*EVIDENCE_COLUMNS[1:]), place)
    first = F.min_by(F.struct("status", "final_url"), F.when(direct, place))
    one = ev.groupBy("key").agg(best.alias("e"), first.alias("first")).select("key", "first", "e.*")
    rescued = (F.col("via") != "direct") & F.col("first").isNotNull()
    one = one.withColumns({"status": F.when(rescued, F.col("first.status")).otherwise(F.col("status")),
                           "final_url": F.when(rescued, F.col("first.final_url")).otherwise(F.col("final_url"))}).drop("first")
    down = network_health(captures if "capture_id" in captures.columns else captures.withColumn("capture_id", F.lit(0).cast("bigint"))).select(
        "network_down").scalar()
    hard = F.col("error").startswith("network:") | F.col("error").startswith("unexpected:")
    return one.withColumn("error", F.when(hard & down, "network_down").otherwise(F.col("error")))


def evidence_summary() -> Column:
    """One line per evidence row."""
    end = F.coalesce("valid_through", "end_date")
    bits = F.concat_ws(" ", "kind", F.when(F.col("via") != "direct", F.concat(F.lit("via="), F.col("via"))),
                       F.when(end.isNotNull(), F.concat(F.lit("ends="), F.date_format(end, "yyyy-MM-dd"))),
                       F.when(F.size("closed_signals") > 0, F.concat(F.lit("closed:"), F.substring(F.get("closed_signals", F.lit(0)), 1, 28))),
                       F.when(F.size("rot_signals") > 0, F.concat(F.lit("rot:"), F.substring(F.get("rot_signals", F.lit(0)), 1, 20))))
    why = F.when(F.col("error") != "", F.col("error")).otherwise(F.coalesce(F.col("status").cast("string"), F.lit("")))
    return F.when(F.col("ok"), bits).otherwise(F.concat(F.lit("no-evidence("), why, F.lit(")")))
