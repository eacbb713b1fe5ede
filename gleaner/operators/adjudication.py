"""Layer 2: claims of a record against the evidence of its own page.

Findings are structs (code, severity, detail, fix_field, fix_value) computed
in place; a severity is contradiction, suspicion or info.  Ordered gates turn
them into accept, quarantine or reject.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocab as V
from ..functions.dates import as_date, day, parse_claimed_date
from ..functions.text import containment, distinctive_tokens, source_family, source_trust, strip, text, title_key
from ..functions.urls import canonical_url, path_depth, primary_url, url_domain
from .joins import lookup

FINDING = "struct<code:string,severity:string,detail:string,fix_field:string,fix_value:string>"
_LINKS = ("application_link", "url", "website", "link")


def _has(df: DataFrame, name: str) -> Column:
    return text(name) if name in df.columns else F.lit("")


def _found(cond: Column, code: str, severity: str, detail: Column, fix: tuple[str, Column] | None = None) -> Column:
    field, value = fix if fix else (None, F.lit(None))
    return F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), detail.alias("detail"),
                                 F.lit(field).cast("string").alias("fix_field"), value.cast("string").alias("fix_value")))


def _list(*found: Column) -> Column:
    return F.array_compact(F.array(*found)).cast(f"array<{FINDING}>")


# ---- joins ---------------------------------------------------------------

def corroboration_index(*groups: DataFrame) -> DataFrame:
    """Title key -> number of distinct source families that assert it.

    Pairs are made distinct first, so a title repeated by one source for a
    third of all rows collapses before anything is shuffled by title.
    """
    rows = reduce(lambda a, b: a.unionByName(b), [g.select("name", "source") for g in groups])
    pairs = rows.select(title_key("name").alias("key"), source_family("source").alias("family")).where("key <> ''").distinct()
    return pairs.groupBy("key").agg(F.count("*").alias("families"))


def corroborate(df: DataFrame, index: DataFrame) -> DataFrame:
    """Add ``corroboration``, at least 1."""
    return (lookup(df.withColumn("_key", title_key("name")), index.withColumnRenamed("key", "_key"), ["_key"])
            .withColumn("corroboration", F.greatest(F.lit(1), F.coalesce("families", F.lit(1))).cast("bigint")).drop("_key", "families"))


def attach_evidence(df: DataFrame, evidence: DataFrame) -> DataFrame:
    """Add ``ev``: the evidence of the canonical primary URL, extracted once per URL."""
    df = df.withColumn("_url", primary_url(*[_has(df, c) for c in _LINKS]))
    df = df.withColumn("_key", F.when(F.col("_url") != "", canonical_url("_url")))
    side = evidence.select(F.col("key").alias("_key"), F.struct(*[c for c in evidence.columns if c != "key"]).alias("ev"))
    out = lookup(df, side, ["_key"])
    error = (F.when(F.col("_url") == "", "no_url").when(F.col("ev").isNull(), "not_captured").otherwise(F.col("ev.error")))
    return out.withColumn("ev_ok", F.coalesce("ev.ok", F.lit(False))).withColumn("ev_error", error).drop("_key", "_url")


def _dates(df: DataFrame, as_of: str) -> DataFrame:
    return df.withColumns({"_due": parse_claimed_date(_has(df, "deadline"), as_of), "_event": parse_claimed_date(_has(df, "event_date"), as_of)})


# ---- checks --------------------------------------------------------------

def chk_internal(df: DataFrame, as_of: str) -> Column:
    """Self-contradictions; needs the columns _due and _event."""
    now = F.lit(as_date(as_of))
    status, due, event = F.lower(strip(_has(df, "status"))), F.col("_due"), F.col("_event")
    ahead = (F.coalesce(due, event).isNotNull()) & F.coalesce(due > now, F.lit(True)) & F.coalesce(event > now, F.lit(True))
    found = [
        _found((status == "open") & (due < now), "stale_open_status", "suspicion",
               F.concat(F.lit("status=open but deadline "), day(due), F.lit(" already passed")), ("status", F.lit("closed"))),
        _found((status == "closed") & ahead, "contradictory_closed_status", "suspicion",
               F.concat(F.lit("status=closed but all dates are in the future ("), F.concat_ws(", ", F.date_format(due, "yyyy-MM-dd"), F.date_format(event, "yyyy-MM-dd")), F.lit(")"))),
        _found(F.datediff(due, event) > V.DEADLINE_OVERSHOOT, "deadline_after_event", "suspicion",
               F.concat(F.lit("deadline "), day(due), F.lit(" is well after eventDate "), day(event)))]
    for c, shown in (("name", "name"), ("deadline", "deadline"), ("application_link", "applicationLink")):
        v = F.lower(strip(_has(df, c)))
        found.append(_found(v.isin(V.PLACEHOLDERS), "placeholder_field", "suspicion", F.concat(F.lit(f"{shown} is a placeholder ('"), v, F.lit("')"))))
    a, b = url_domain(_has(df, "application_link")), url_domain(_has(df, "website"))
    found.append(_found((a != "") & (b != "") & (a != b), "link_domain_split", "info",
                        F.concat(F.lit("applicationLink("), a, F.lit(") != website("), b, F.lit(")"))))
    return _list(*found)


def chk_link(df: DataFrame) -> Column:
    claimed, final, rot = _has(df, "application_link"), text("ev.final_url"), F.col("ev.rot_signals")
    dead = F.size(rot) > 0
    cd, fd = url_domain(claimed), url_domain(final)
    live = ~dead & (claimed != "") & (final != "")
    root = (cd == fd) & (path_depth(claimed) >= 2) & (path_depth(final) == 0)
    return _list(
        _found(dead, "link_rot", "contradiction", F.concat(F.lit("target page looks dead ("), F.array_join(F.slice(rot, 1, 2), ", "), F.lit(")"))),
        _found(live & root, "redirect_to_root", "suspicion", F.concat(F.lit("deep link redirected to site root ("), final, F.lit(")"))),
        _found(live & ~root & (cd != "") & (fd != "") & (cd != fd), "cross_domain_redirect", "suspicion",
               F.concat(F.lit("redirected off-domain: "), cd, F.lit(" -> "), fd)))


def title_overlap(df: DataFrame) -> Column:
    """Best share of the claimed words found in any text of the page."""
    claim = distinctive_tokens("name")
    pages = [F.col(f"ev.{c}") for c in ("jsonld_name", "og_title", "title", "description", "site_name", "organizer")]
    return F.greatest(*[containment(claim, distinctive_tokens(p)) for p in pages])


def chk_title(df: DataFrame) -> Column:
    """Needs the column _overlap."""
    best = F.col("_overlap")
    shown = F.format_string("%.2f", best)
    first = F.coalesce(*[F.nullif(F.col(f"ev.{c}"), F.lit("")) for c in ("jsonld_name", "og_title", "title")])
    checked = (F.size(distinctive_tokens("name")) >= 2) & first.isNotNull() & (best < V.TITLE_SOFT)
    veto = (best < V.TITLE_HARD) & F.col("ev.kind").isin("jsonld", "opengraph")
    return _list(
        _found(checked & veto, "title_mismatch", "contradiction",
               F.concat(F.lit("page describes something else (overlap="), shown, F.lit(", page='"), F.substring(first, 1, 60), F.lit("')"))),
        _found(checked & ~veto, "weak_title_match", "suspicion", F.concat(F.lit("low title overlap with page (overlap="), shown, F.lit(")"))))


def chk_dates(df: DataFrame, as_of: str) -> Column:
    now = F.lit(as_date(as_of))
    end, start = F.coalesce("ev.valid_through", "ev.end_date"), F.col("ev.start_date")
    due, event = F.col("_due"), F.col("_event")
    drift = F.abs(F.datediff(event, start))
    return _list(
        _found(end < now, "publisher_says_ended", "suspicion", F.concat(F.lit("publisher end date "), day(end), F.lit(" is in the past")), ("status", F.lit("closed"))),
        _found(F.datediff(due, end) > V.DEADLINE_OVERSHOOT, "deadline_overshoots_publisher", "contradiction",
               F.concat(F.lit("claimed deadline "), day(due), F.lit(" is after publisher end "), day(end)), ("deadline", day(end))),
        _found(drift > V.EVENT_DRIFT, "event_date_drift", "contradiction",
               F.concat(F.lit("claimed eventDate "), day(event), F.lit(" vs published "), day(start), F.lit(" ("), drift.cast("string"), F.lit("d drift)")), ("event_date", day(start))),
        _found(start.isNotNull() & event.isNull(), "event_date_enriched", "info", F.concat(F.lit("adopted publisher start date "), day(start)), ("event_date", day(start))),
        _found(end.isNotNull() & due.isNull() & (strip(_has(df, "deadline")) == ""), "deadline_enriched", "info",
               F.concat(F.lit("adopted publisher end date "), day(end)), ("deadline", day(end))))


def chk_closure(df: DataFrame) -> Column:
    status = F.lower(_has(df, "status"))
    shut = F.size("ev.closed_signals") > 0
    return _list(
        _found(shut & (status == "closed"), "closure_confirmed", "info", F.lit("page confirms closed status")),
        _found(shut & (status != "closed"), "closure_detected", "suspicion",
               F.concat(F.lit("page states '"), F.get("ev.closed_signals", F.lit(0)), F.lit("' but record says "),
                        F.when(status == "", "unknown").otherwise(status)), ("status", F.lit("closed"))))


def chk_unreachable(error: Column) -> Column:
    """No evidence: only a definite 404 or 410 counts against a record."""
    e = F.when(text(error) == "", "unknown").otherwise(error)

    def note(code: str, severity: str, before: str, shown: Column, after: str = "") -> Column:
        return _found(F.lit(True), code, severity, F.concat(F.lit(before), shown, F.lit(after)))

    one = (F.when(e.isin("http_404", "http_410"), note("dead_link", "contradiction", "link returns ", F.substring(e, 6, 3)))
           .when(e.startswith("blocked_"), note("bot_walled", "info", "page not readable (", e, ")"))
           .when(e.startswith("challenge_page"), note("bot_challenge", "info", "anti-bot interstitial (", e, ")"))
           .when(e.isin("network_down", "not_captured"), note("not_checked", "info", "evidence skipped (", e, ")"))
           .when(e.isin("no_url", "invalid_url"), note("no_verifiable_url", "suspicion", "no usable URL to verify against", F.lit("")))
           .when(e.startswith("http_5"), note("server_error", "suspicion", "publisher server error (", e, ")"))
           .otherwise(note("unreachable", "suspicion", "could not fetch evidence (", e, ")")))
    return F.array(one).cast(f"array<{FINDING}>")


def findings(joined: DataFrame, as_of: str) -> DataFrame:
    """Add ``findings`` to records that carry ``ev``, ``ev_ok`` and ``ev_error``."""
    df = _dates(joined, as_of).withColumn("_overlap", title_overlap(joined))
    page = F.concat(chk_link(df), chk_title(df), chk_dates(df, as_of), chk_closure(df))
    return (df.withColumn("findings", F.concat(chk_internal(df, as_of), F.when(F.col("ev_ok"), page).otherwise(chk_unreachable(F.col("ev_error")))))
            .drop("_due", "_event", "_overlap"))


# ---- decision ------------------------------------------------------------

def _of(severity: str) -> Column:
    return F.filter("findings", lambda f: f["severity"] == severity)


def _lines(found: Column) -> Column:
    return F.transform(found, lambda f: F.concat(f["code"], F.lit(": "), f["detail"]))


def fix_of(field: str) -> Column:
    """Value of the last correction of a field."""
    return F.try_element_at(F.filter("findings", lambda f: f["fix_field"] == field), F.lit(-1))["fix_value"]


def decide(df: DataFrame) -> DataFrame:
    """Add verdict and reasons from findings, trust and corroboration."""
    wrong, odd = _of("contradiction"), _of("suspicion")
    proven = F.col("ev_ok") & (F.col("ev.kind") != "none")
    trusted = F.col("trust") >= V.TRUST_AUTOPASS
    quorate = F.col("corroboration") >= V.QUORUM
    basis = F.concat(F.lit("(trust="), F.format_string("%.2f", F.col("trust")), F.lit(", sources="), F.col("corroboration").cast("string"), F.lit(")"))
    why = F.when(text("ev_error") == "", "none").otherwise(F.col("ev_error"))
    df = df.withColumn("gate", F.when(F.size(wrong) > 0, "contradiction").when(F.coalesce(fix_of("status") == "closed", F.lit(False)), "over")
                       .when(~proven & (trusted | quorate), "believed").when(~proven, "unproven")
                       .when(F.size(odd) >= V.SUSPICION_LIMIT, "suspicious").otherwise("proven"))
    gate = F.col("gate")
    verdict = (F.when(gate.isin("contradiction", "over"), "reject").when(gate.isin("unproven", "suspicious"), "quarantine").otherwise("accept"))
    reasons = (F.when(gate == "contradiction", _lines(wrong)).when(gate == "over", F.array(F.lit("already closed at time of discovery")))
               .when(gate == "believed", F.array(F.concat(F.lit("unproven but "), F.when(trusted, "trusted source ").otherwise("corroborated "), basis)))
               .when(gate == "unproven", F.array(F.concat(F.lit("no evidence ("), why, F.lit("), low trust "), basis)))
               .when((gate == "suspicious") | (F.size(odd) > 0), _lines(odd)).otherwise(F.array(F.lit("corroborated by publisher metadata"))))
    return df.withColumns({"verdict": verdict, "l2_reasons": reasons})


def apply_fixes(df: DataFrame) -> DataFrame:
    """Correct accepted records; ``corrections`` keeps 'old -> new' per field."""
    changed, updates = [], {}
    for field in ("status", "deadline", "event_date"):
        old, new = _has(df, field), fix_of(field)
        differs = (F.col("verdict") == "accept") & new.isNotNull() & (new != old)
        updates[field] = F.when(differs, new).otherwise(F.col(field) if field in df.columns else F.lit(None).cast("string"))
        changed.append(F.when(differs, F.struct(F.lit(field).alias("k"), F.concat(old, F.lit(" -> "), new).alias("v"))))
    return df.withColumn("corrections", F.map_from_entries(F.array_compact(F.array(*changed)))).withColumns(updates)


def adjudicate(df: DataFrame, evidence: DataFrame, index: DataFrame, as_of: str) -> DataFrame:
    """Verdict, reasons, findings, trust, corroboration and corrections for every record."""
    rich = corroborate(df, index).withColumn("trust", source_trust("source"))
    out = apply_fixes(decide(findings(attach_evidence(rich, evidence), as_of)))
    return (out.withColumn("evidence_kind", F.when(F.col("ev_ok"), F.col("ev.kind")).otherwise("none"))
            .withColumn("evidence_hash", text("ev.content_hash")).drop("ev"))


def l2_stats(adjudicated: DataFrame) -> DataFrame:
    v = F.col("verdict")
    return adjudicated.agg(
        F.count("*").alias("total"), F.count_if(v == "accept").alias("accepted"), F.count_if(v == "quarantine").alias("quarantined"),
        F.count_if(v == "reject").alias("rejected"), F.count_if(F.size("corrections") > 0).alias("corrected"),
        F.coalesce(F.sum(F.size(_of("contradiction"))), F.lit(0)).cast("bigint").alias("contradictions"),
        F.count_if(F.col("gate").isin("believed", "unproven")).alias("unproven"))


def evidence_stats(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("kind", "via", F.substring_index("error", ":", 1).alias("error")).agg(
        F.count("*").alias("n"), F.count_if(F.size("challenge") > 0).alias("challenge_pages"))
