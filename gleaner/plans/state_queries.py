"""Ledger, quarantine and gate queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import vocab as V
from ..operators import gate as G, state as S
from ..session import shared_dir
from . import duck as D
from .fixtures import NOW
from .registry import query

# Seed ledger: decisions before the middle of the stream; the rest are new.
_CUT = "checked_at < timestamp '2024-01-15'"


def _fold(src):
    perm = "case when arg_max(decision, seq) = 'reject' then arg_max(layer, seq) <> 'quarantine-expiry' else false end"
    return (f"select fp, arg_min(name, seq) as name, arg_min(category, seq) as category, arg_min(source, seq) as source, arg_min(link, seq) as link, arg_min(checked_at, seq) as first_seen, "
            f"arg_max(checked_at, seq) as last_checked, count(*) as attempts, arg_max(decision, seq) as decision, arg_max(layer, seq) as layer, arg_max(reason, seq) as reason, arg_max(trust, seq) as trust, {perm} as permanent from {src} group by fp")


def _scratch(t, label):
    """A fresh folder below the shared one."""
    return f"{shared_dir(t.spark)}/{label}-{uuid.uuid4().hex}"


SEED = f"seed as ({_fold(f'(select * from decisions where {_CUT})')})"
ALL = f"whole as ({_fold('decisions')})"
_TS = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def _decisions(t):
    return t.decisions.withColumn("reasons", F.array("reason"))


def _ledger(t):
    """The ledger built from the first half of the decisions."""
    d = _decisions(t).where(_CUT)
    return S.fold_decisions(d, NOW)


def _whole(t):
    """The ledger built from all decisions."""
    return S.fold_decisions(_decisions(t), NOW)


def _text(df, *extra):
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return df.select("fp", "name", "category", "source", "link", fmt("first_seen"), fmt("last_checked"), "attempts", "decision", "layer",
                     F.array_join("reasons", ",").alias("reason"), "trust", "permanent", *extra)


_LCOLS = f"fp, name, category, source, link, {_TS('first_seen')} as first_seen, {_TS('last_checked')} as last_checked, attempts, decision, layer, reason, trust, permanent"


@query("ledger_upsert", f"with {ALL} select {_LCOLS} from whole")
def _(t):
    d = _decisions(t)
    return _text(S.ledger_upsert(_ledger(t), d.where(f"not ({_CUT})"), NOW))


@query("scan_ledger", f"with {ALL} select {_LCOLS} from whole")
def _(t):
    from ..schema import LEDGER
    from ..sources.tables import publish, read_state
    root = _scratch(t, "ledger")
    publish(_whole(t), root, "seed")
    return _text(read_state(t.spark, root, LEDGER))


@query("sink_ledger", f"with {ALL} select count(*) as record_count, 2 as version, '{NOW}' as updated_at from whole where last_checked >= timestamp '{NOW}' - interval 180 day")
def _(t):
    from ..schema import LEDGER
    from ..sources.tables import publish, read_state, state_meta
    root = _scratch(t, "ledger")
    publish(S.ledger_prune(_whole(t), NOW), root, "1")
    return state_meta(read_state(t.spark, root, LEDGER), NOW)


@query("ledger_prune", f"with {ALL} select {_LCOLS} from whole where last_checked >= timestamp '{NOW}' - interval 20 day")
def _(t):
    return _text(S.ledger_prune(_whole(t), NOW, days=20))


@query("ledger_stats", f"with {ALL} select decision, count(*) as n, count(*) filter (permanent) as retired from whole group by decision")
def _(t):
    return S.ledger_stats(_whole(t))


# A ledger over records: what earlier runs decided; they knew the jobs under other names.
_OLD_NAME = "case when category = 'jobs' then name || ' elsewhere' else name end"
RECORDS = f"""book as (select {D.fingerprint(_OLD_NAME)} as fp, arg_max(case status when 'closed' then 'reject' when 'open' then 'accept' else 'quarantine' end, seq) as decision,
  arg_max(timestamp '2024-01-28' + to_hours(cast(seq % 120 as int)), seq) as last_checked, count(*) as attempts from opp group by 1)"""


def _book(t):
    rows = S.with_fingerprint(t.opp.withColumn("name", F.expr(_OLD_NAME))).selectExpr(
        "seq", "fp", "case status when 'closed' then 'reject' when 'open' then 'accept' else 'quarantine' end as decision", "'L2' as layer",
        "timestamp_ntz'2024-01-28 00:00:00' + make_dt_interval(0, cast(seq % 120 as int), 0, 0) as checked_at", "name", "category", "source", "application_link as link")
    return S.fold_decisions(rows, NOW)


@query("ledger_lookup", f"with {RECORDS} select seq, b.decision as known_decision, coalesce(b.attempts, 0) as known_attempts from opp o left join book b on b.fp = {D.fingerprint('o.name', 'o.application_link', 'o.website')}")
def _(t):
    return S.ledger_lookup(t.opp, _book(t)).select("seq", "known_decision", "known_attempts")


@query("suppress_retired", f"with {RECORDS} select seq from opp o where {D.fingerprint('o.name', 'o.application_link', 'o.website')} not in (select fp from book where decision = 'reject')")
def _(t):
    return S.suppress_retired(t.opp, _book(t)).select("seq")


@query("recheck_due", f"with {RECORDS} select seq, not coalesce(b.decision = 'accept' and last_checked > timestamp '{NOW}' - interval 72 hour, false) as due from opp o left join book b on b.fp = {D.fingerprint('o.name', 'o.application_link', 'o.website')}")
def _(t):
    return S.recheck_due(t.opp, _book(t), NOW).select("seq", "due")


@query("fingerprint_counts", f"select {D.fingerprint()} as fp, count(*) as n from opp group by 1")
def _(t):
    return S.with_fingerprint(t.opp).groupBy("fp").agg(F.count("*").alias("n"))


# ---- quarantine ----------------------------------------------------------

HELD = """held as (select category, fp, count(*) as k, arg_max(reason, seq) as reason, arg_max(name, seq) as name from decisions where decision = 'quarantine' group by category, fp),
queue as (select category, fp, k % 5 as attempts, k // 5 as times_retired, reason, name from held)"""


def _items(t):
    return _decisions(t).where("decision = 'quarantine'").withColumn("item", F.struct("seq", "name", "category", "source"))


def _empty_queue(t):
    item = _items(t).schema["item"].dataType.simpleString()
    return t.spark.createDataFrame([], f"category string, fp string, attempts bigint, first_held timestamp_ntz, last_seen timestamp_ntz, reasons array<string>, item {item}")


def _queue(t):
    return S.quarantine_hold(_empty_queue(t), _items(t), NOW)


@query("quarantine_hold", f"with {HELD} select category, fp, attempts, reason from queue where attempts > 0")
def _(t):
    return _queue(t)[0].select("category", "fp", "attempts", F.array_join("reasons", ",").alias("reason"))


@query("quarantine_retire", f"with {HELD} select category, fp, times_retired from queue where times_retired > 0")
def _(t):
    return _queue(t)[1].select("category", "fp", "times_retired")


@query("quarantine_pending", f"with {HELD} select name, category, attempts as held_attempts from queue where attempts > 0 and name <> ''")
def _(t):
    return S.quarantine_pending(_queue(t)[0]).select("name", "category", "held_attempts")


_ACCEPTED = "accepted as (select distinct category, fp from decisions where decision = 'accept' and trust >= 0.9)"


def _accepted(t):
    return t.decisions.where("decision = 'accept' and trust >= 0.9")


@query("quarantine_release", f"with {HELD}, {_ACCEPTED} select category, fp, attempts from queue q where attempts > 0 and not exists (select 1 from accepted a where a.category = q.category and a.fp = q.fp)")
def _(t):
    return S.quarantine_release(_queue(t)[0], _accepted(t)).select("category", "fp", "attempts")


@query("release_join", f"with {HELD}, {_ACCEPTED} select q.category, count(*) as remaining from queue q left join accepted a on a.category = q.category and a.fp = q.fp where attempts > 0 and a.fp is null group by q.category")
def _(t):
    return S.quarantine_release(_queue(t)[0], _accepted(t)).groupBy("category").agg(F.count("*").alias("remaining"))


@query("quarantine_cap", """with r as (select category, seq, row_number() over (partition by category order by checked_at desc, fp) as rk from decisions)
select category, seq from r where rk <= 500""")
def _(t):
    # every single hold as an entry of its own, so that the cap applies
    return S.quarantine_cap(t.decisions.withColumnRenamed("checked_at", "last_seen")).select("category", "seq")


@query("quarantine_stats", f"with {HELD} select coalesce(category, '(all)') as category, count(*) as n from queue where attempts > 0 group by rollup (category)")
def _(t):
    return S.quarantine_stats(_queue(t)[0])


@query("sink_quarantine", f"with {HELD} select count(*) as record_count, 2 as version, '{NOW}' as updated_at from queue where attempts > 0")
def _(t):
    from ..sources.tables import publish, read_state, state_meta
    root = _scratch(t, "quarantine")
    publish(_queue(t)[0], root, "1")
    return state_meta(read_state(t.spark, root, _empty_queue(t).schema), NOW)


@query("scan_quarantine", f"with {HELD} select category, fp, attempts, name from queue where attempts > 0")
def _(t):
    from ..sources.tables import publish, read_state
    root = _scratch(t, "quarantine")
    publish(_queue(t)[0], root, "1")
    return read_state(t.spark, root, _empty_queue(t).schema).select("category", "fp", "attempts", F.col("item.name").alias("name"))


# ---- gate ----------------------------------------------------------------

# Three proposed snapshots, one per kind of category:
#   jobs lose a fifth, hackathons lose their links, the others grow.
AFTER = """before_t as (select *, false as is_new from opp where batch <> 2),
added_t as (select *, true as is_new from opp where batch = 2 and category <> 'jobs'),
after_t as (select * replace (case when category = 'hackathons' and seq % 2 = 0 then '' else application_link end as application_link, case when category = 'hackathons' then '' else website end as website,
  case when category = 'hackathons' then '' else url end as url, case when category = 'hackathons' then '' else link end as link)
  from (select * from before_t where category <> 'jobs' or seq % 5 <> 0 union all select * from added_t))"""


def _snapshots(t):
    opp = t.opp
    before = opp.where("batch <> 2")
    added = opp.where("batch = 2 and category <> 'jobs'")
    after = before.where("category <> 'jobs' or seq % 5 <> 0").unionByName(added)
    hack = F.col("category") == "hackathons"
    after = after.withColumns({"application_link": F.when(hack & (F.col("seq") % 2 == 0), "").otherwise(F.col("application_link")),
                               **{c: F.when(hack, "").otherwise(F.col(c)) for c in ("website", "url", "link")}})
    return before, after, added


_LINKED = "(trim(coalesce(application_link, '')) like 'http%' or trim(coalesce(url, '')) like 'http%' or trim(coalesce(website, '')) like 'http%' or trim(coalesce(link, '')) like 'http%')"
METRICS = f"""{AFTER},
a as (select category, count(*) as after, count(*) filter (trim(name) = '') as blank_names, count(*) filter (not {_LINKED}) as no_link,
  count(*) filter (not list_contains({D.lst(V.VALID_STATUSES)}, status)) as bad_status from after_t group by category),
b as (select category, count(*) as before, count(*) filter ({_LINKED}) as before_linked from before_t group by category),
n as (select category, count(*) as added from added_t group by category),
dn as (select category, sum(c - 1) as dup_names from (select category, {D.norm_title('name')} as k, count(*) as c from after_t group by all) where length(k) > 4 group by category),
dl as (select category, sum(c - 1) as dup_links from (select category, {D.gate_link('application_link')} as k, count(*) as c from after_t group by all) where length(k) > 10 group by category),
metrics as (select category, coalesce(before, 0) as before, coalesce(after, 0) as after, coalesce(added, 0) as added, coalesce(after, 0) - coalesce(before, 0) as delta, coalesce(before, 0) < 10 as bootstrap,
  blank_names, no_link, bad_status, before_linked, after - no_link as after_linked, coalesce(dup_names, 0)::bigint as dup_names, coalesce(dup_links, 0)::bigint as dup_links
  from b full outer join a using (category) full outer join n using (category) left join dn using (category) left join dl using (category))"""

_V = [("after = 0", "'empty_payload'", "'warn'"),
      ("blank_names > 0", "'missing_name'", "case when blank_names / greatest(after, 1) > 0.02 then 'block' else 'warn' end"),
      ("after > 0 and no_link / after > 0.35", "'widespread_missing_links'", "'block'"),
      ("after > 0 and no_link / after <= 0.35 and no_link > 0", "'some_missing_links'", "'warn'"),
      ("bad_status > 0", "'unknown_status'", "'warn'"),
      ("after > 0 and greatest(dup_names, dup_links) / after > 0.12", "'duplicate_flood'", "'block'"),
      ("after > 0 and greatest(dup_names, dup_links) / after <= 0.12 and greatest(dup_names, dup_links) > 0", "'duplicates_present'", "'warn'"),
      ("not bootstrap and after < floor(before * 0.9)", "'mass_deletion'", "'block'"),
      ("not bootstrap and added > greatest(150, floor(before * 0.4))", "'insertion_surge'", "'block'"),
      ("not bootstrap and before_linked >= 20 and after_linked < before_linked * 0.75", "'link_coverage_collapse'", "'block'")]
VIOLATIONS = METRICS + ",\nviolations as (" + "\nunion all ".join(f"select category, {code} as code, {sev} as severity from metrics where {cond}" for cond, code, sev in _V) + ")"
DECIDED = VIOLATIONS + """,
decided as (select m.*, count(v.code) filter (severity = 'block') as blockers, count(v.code) filter (severity = 'warn') as warnings from metrics m left join violations v using (category) group by all)"""

_MCOLS = ["category", "before", "after", "added", "delta", "bootstrap", "blank_names", "no_link", "bad_status", "before_linked", "after_linked", "dup_names", "dup_links"]


@query("gate_metrics", f"with {METRICS} select {', '.join(_MCOLS)} from metrics")
def _(t):
    return G.gate_metrics(*_snapshots(t)).select(_MCOLS)


@query("gate_decide", f"with {DECIDED} select category, blockers, warnings, blockers = 0 as allowed from decided")
def _(t):
    return G.gate_decide(G.gate_metrics(*_snapshots(t))).select("category", "blockers", "warnings", "allowed")


@query("gate_violations", f"with {VIOLATIONS} select * from violations")
def _(t):
    return G.gate_violations(G.gate_metrics(*_snapshots(t))).select("category", "code", "severity")


def _rule(name, codes):
    @query(name, f"with {VIOLATIONS} select m.category, max(v.severity) as severity, count(v.code) as broken from metrics m left join violations v on v.category = m.category and list_contains({D.lst(codes)}, v.code) group by m.category")
    def run(t):
        m = G.gate_metrics(*_snapshots(t))
        v = G.gate_violations(m).where(F.col("code").isin(codes))
        return m.select("category").join(v, "category", "left").groupBy("category").agg(F.max("severity").alias("severity"), F.count("code").alias("broken"))


_rule("gate_container", ["empty_payload"])
_rule("gate_schema", ["missing_name"])
_rule("gate_links", ["widespread_missing_links", "some_missing_links"])
_rule("gate_duplicates", ["duplicate_flood", "duplicates_present"])
_rule("gate_retention", ["mass_deletion"])
_rule("gate_surge", ["insertion_surge"])
_rule("gate_link_loss", ["link_coverage_collapse"])


@query("gate_status", f"with {AFTER} select category, status, count(*) as n from after_t where not list_contains({D.lst(V.VALID_STATUSES)}, status) group by all")
def _(t):
    return G.unknown_statuses(_snapshots(t)[1])


@query("gate_internal_leak", f"with {METRICS} select category, 2 * after as leaked from metrics")
def _(t):
    before, after, added = _snapshots(t)
    leaky = after.withColumn("_adjudication", F.lit("x")).withColumn("_quarantine", F.col("seq"))
    return G.gate_metrics(before, leaky, added).select("category", "leaked")


@query("gate_serializable", f"""with {METRICS} select m.category, count(*) filter (a.seq % 10 = 3) as unserializable, m.after > 0 and count(*) filter (a.seq % 10 = 3) > 0 as blocked
from metrics m left join after_t a on a.category = m.category group by m.category, m.after""")
def _(t):
    before, after, added = _snapshots(t)
    scored = after.withColumn("score", F.when(F.col("seq") % 20 == 3, float("nan")).when(F.col("seq") % 20 == 13, float("inf")).otherwise(F.col("seq") / 2))
    metrics = G.gate_metrics(before, scored, added)
    rule = G.gate_violations(metrics).where("code = 'not_serializable' and severity = 'block'").select("category", F.lit(True).alias("b"))
    return metrics.join(rule, "category", "left").select("category", "unserializable", F.coalesce("b", F.lit(False)).alias("blocked"))


@query("strip_internal", "select seq, name, status from opp")
def _(t):
    return G.public_columns(t.opp.select("seq", "name", "status").withColumn("_adjudication", F.lit("x")).withColumn("_research", F.lit(1)))


@query("gated_snapshot", f"with {DECIDED} select seq, category from after_t where category in (select category from decided where blockers = 0) union all select seq, category from before_t where category in (select category from decided where blockers > 0)")
def _(t):
    before, after, added = _snapshots(t)
    return G.gated_snapshot(before, after, G.gate_decide(G.gate_metrics(before, after, added))).select("seq", "category")


@query("dup_counts", f"""with n as (select category, sum(c - 1)::bigint as dup_names from (select category, {D.norm_title('name')} as k, count(*) as c from opp group by all) where length(k) > 4 group by category),
l as (select category, sum(c - 1)::bigint as dup_links from (select category, {D.gate_link('application_link')} as k, count(*) as c from opp group by all) where length(k) > 10 group by category)
select category, coalesce(dup_names, 0) as dup_names, coalesce(dup_links, 0) as dup_links from n full outer join l using (category)""")
def _(t):
    return G.dup_counts(t.opp)


@query("snapshot_diff", f"""with {AFTER}, b as (select distinct category, {D.fingerprint()} as fp from before_t), a as (select distinct category, {D.fingerprint()} as fp from after_t)
select coalesce(a.category, b.category) as category, count(*) filter (b.fp is null) as added, count(*) filter (a.fp is null) as removed, count(*) filter (a.fp is not null and b.fp is not null) as kept
from a full outer join b on a.category = b.category and a.fp = b.fp group by 1""")
def _(t):
    before, after, _ = _snapshots(t)
    return S.snapshot_diff(before, after)


@query("publish_snapshot", "select seq, name, category, deadline from opp")
def _(t):
    from ..schema import OPPORTUNITY
    from ..sources.tables import publish, read_state
    root = _scratch(t, "published")
    publish(t.opp, root, "1")
    return read_state(t.spark, root, OPPORTUNITY).select("seq", "name", "category", "deadline")


@query("sink_category", "select category, count(*) as n, max(name) as last_name from opp group by category")
def _(t):
    from ..sources.tables import write_category
    path = _scratch(t, "categories")
    write_category(t.opp, path)
    return t.spark.read.parquet(path).groupBy("category").agg(F.count("*").alias("n"), F.max("name").alias("last_name"))


@query("scan_category", "select seq, name, deadline, event_date, array_to_string(tags, ',') as tags from opp")
def _(t):
    from ..schema import JSON_NAMES
    from ..sources.tables import read_category
    path = _scratch(t, "json")
    t.opp.withColumnsRenamed(JSON_NAMES).write.mode("overwrite").json(path)
    return read_category(t.spark, path).select("seq", "name", "deadline", "event_date", F.array_join("tags", ",").alias("tags"))
