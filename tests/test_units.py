"""Rule branches on hand-made rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from gleaner.functions import dates, html, text, urls
from gleaner.operators import facets, gate, location, reminders, state

AS_OF = "2026-09-01"


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("place,mode,country", [
    ("Bengaluru, IN", "onsite", "IN"), ("Fort Wayne, IN", "onsite", "US"), ("Remote (US)", "remote_geo", "US"),
    ("Remote, worldwide", "remote", ""), ("Hybrid - London", "hybrid", "GB"), ("San FranciscoNew York", "onsite", "US"),
    ("", "unknown", ""), ("jammu & kashmir", "onsite", "IN"), ("onlinemart", "unknown", ""), ("Remote - UK", "remote_geo", "GB"),
    ("St. Louis", "unknown", ""), ("st louis", "onsite", "US"), ("Toronto / London", "onsite", "CA")])
def test_location(spark, place, mode, country):
    df = spark.createDataFrame([(place,)], "location string")
    row = location.classify_location(df).select("loc.mode", "loc.country").first()
    assert (row["mode"], row["country"]) == (mode, country)


def test_geo_policy_rules(spark):
    rows = [("jobs", "New York, NY"), ("jobs", "Pune"), ("jobs", "Remote"), ("hackathons", "New York, NY"), ("jobs", "on-site")]
    df = location.classify_location(spark.createDataFrame(rows, "category string, location string"))
    got = {(r["category"], r["location"]): r["keep"] for r in location.geo_policy(df).collect()}
    assert got == {("jobs", "New York, NY"): False, ("jobs", "Pune"): True, ("jobs", "Remote"): True,
                   ("hackathons", "New York, NY"): True, ("jobs", "on-site"): True}
    dropped = location.geo_policy(df, {"onsite": "drop", "remote": "keep"}).where("keep").count()
    assert dropped == 2


@pytest.mark.parametrize("value,want", [
    ("2026-09-08", "2026-09-08"), ("2026-02-30", None), ("Rolling", None), ("Jul 31 - Oct 01, 2026", "2026-10-01"),
    ("September 30, 2026", "2026-09-30"), ("5 Sep 2026", "2026-09-05"), ("Sep 4", "2026-09-04"), ("09/15/2026", "2026-09-15"),
    ("Aug 1 to Nov 2, 2026", "2026-11-02"), ("no date here", None), ("Oct 3rd, 2026", "2026-10-03")])
def test_claimed_date(spark, value, want):
    got = one(spark, dates.parse_claimed_date("s", AS_OF), s=value)
    assert got == (datetime.date.fromisoformat(want) if want else None)


@pytest.mark.parametrize("value,want", [
    ("", False), ("Rolling 2020", False), ("Summer 2025", True), ("Entries ended", True), ("extended", True),
    ("2026-08-31", True), ("2026-09-01", False), ("Jul 31 - Oct 01, 2026", False), ("Aug 1 - Aug 9, 2026", True)])
def test_is_past(spark, value, want):
    assert one(spark, dates.is_past("s", AS_OF), s=value) is want


def test_names_keep_unicode_and_hyphens(spark):
    assert one(spark, text.normalize_name("s"), s="  Café-Été!  2026 🚀 ") == "café-été 2026"
    assert one(spark, text.normalize_title("s"), s="Open-Source  Day") == "opensource day"


def test_links(spark):
    assert one(spark, urls.normalize_link("s"), s=" HTTPS://www.A.io/x/?utm_source=q&ref=2#f ") == "a.io/x"
    assert one(spark, urls.canonical_url("s"), s="http://www.A.io/x/?b=2&a=1&utm_z=3&e=#f") == "https://a.io/x?a=1&b=2"


def test_trust_takes_longest_key(spark):
    assert one(spark, text.source_trust("s"), s="reddit:r/leetcode") == 0.90
    assert one(spark, text.source_trust("s"), s="unheard-of") == 0.50


def test_html(spark):
    page = "<style>x</style><p>A &amp; B&#39;s &#x20AC;&nbsp;5</p><script>no</script>"
    assert one(spark, html.visible_text("s"), s=page).strip() == "A & B's € 5"
    assert one(spark, html.strip_html("s"), s="<p>one</p><div>two</div>") == "one\n two"


def test_references_decode_once_by_the_whole_table(spark):
    import html as standard
    import random
    from html.entities import html5
    rng = random.Random(2)
    texts = [f"x&{n}y&{n}" for n in html5] + [f"&#{n};" for n in (0, 9, 13, 65, 127, 128, 150, 159, 233, 8364, 55296, 64976, 65534, 128512, 1114111, 1114112, 10 ** 12)]
    texts += ["&#x20AC;&#xe9&#233", "&am", "&amp", "&ampx;", "&notit;", "&", "&&", "&;", "& b", "&#;", "&#x;", "&unknown;", "&AMP", "a&b;c&lt", "&iacute; &Eacute;"]
    texts += ["".join(rng.choices(["&", "amp", "lt", ";", "#", "38", "x", " ", "copy", "not", "in"], k=8)) for _ in range(500)]
    got = spark.createDataFrame([(t,) for t in texts], "s string").select("s", html.unescape(F.col("s")).alias("v")).collect()
    assert [r for r in got if r.v != standard.unescape(r.s)] == []
    assert one(spark, html.visible_text("s"), s="&#38;lt;b&#38;gt; &amp;amp;") == "&lt;b&gt; &amp;"


def test_corrupt_json_array_gives_no_rows(spark, tmp_path):
    from gleaner.sources.tables import read_category
    (tmp_path / "a.json").write_text('[{"name": "x", broken')
    (tmp_path / "b.json").write_text('[{"name": "x"}, {"name": "y"}]')
    assert read_category(spark, str(tmp_path / "a.json")).collect() == []
    assert sorted(r["name"] for r in read_category(spark, str(tmp_path / "b.json"), "jobs").collect()) == ["x", "y"]


def test_rescued_page_keeps_the_direct_answer(spark):
    from gleaner.operators.evidence import build_evidence
    page = "<html><head><title>Harbour Hackathon</title></head><body>text</body></html>"
    rows = [(1, 0, "https://a.io/x", "https://other.io/", 403, "", ""), (2, 1, "https://a.io/x", "https://a.io/x", 200, "", page)]
    caps = spark.createDataFrame(rows, "capture_id bigint, tier int, url string, final_url string, status int, error string, body string")
    row = build_evidence(caps, AS_OF).first()
    assert (row["status"], row["final_url"], row["via"], row["ok"], row["title"]) == (403, "https://other.io/", "reach", True, "Harbour Hackathon")


def test_linkedin_card_sets_only_its_url(spark):
    from gleaner.sources import cards
    landed = spark.createDataFrame([("linkedin", "Data Intern", "https://l.io/1?x=2"), ("unstop-competitions", "Case Cup", "/c/1")], "site string, name string, link string")
    rows = {r["site"]: r for r in cards.apply_source_defaults(landed, cards.defaults_table(spark)).collect()}
    card = rows["linkedin"]
    assert (card["url"], card["application_link"], card["website"], card["status"], card["category"]) == ("https://l.io/1", None, None, None, "internships")
    cup = rows["unstop-competitions"]
    assert (cup["category"], cup["application_link"], cup["description"], cup["tags"]) == ("competitions", "https://unstop.com/c/1", "Competitions on Unstop", ["unstop", "competitions"])


def test_pointer_moves_in_one_step(spark, tmp_path):
    from gleaner.sources.tables import current_version, publish
    root = str(tmp_path / "t")
    for v in ("1", "2", "3"):
        publish(spark.range(int(v)), root, v)
        assert current_version(spark, root) == v
    assert [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith(".pointer")] == []


def test_numbers_of_sources_never_collide(spark):
    """Captures 70,000 and 3e9 of one source before any record of the next."""
    from gleaner.sources.registry import route, union_sources
    table = "| Name | Link |\n|---|---|\n" + "".join(f"| Program {{0}} {i} | https://{{0}}.io/{i} |\n" for i in range(5))
    caps = spark.createDataFrame([(c, "t", table.replace("{0}", f"c{c}")) for c in (1, 70_000, 3_000_000_000)], "capture_id bigint, url string, body string")
    cat = spark.createDataFrame([("T", "t", "markdown_table", "jobs", None, None, True)], "name string, url string, parser string, category string, limit int, filter string, enabled boolean")
    later = lambda c: spark.createDataFrame([(0, "Later one"), (1, "Later two")], "seq bigint, name string")
    rows = union_sources(caps, {"first": (None, lambda c: route(c, cat)), "second": ("jobs", later)})[0].orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(1, 18))
    assert [r["name"] for r in rows] == [f"Program c{c} {i}" for c in (1, 70_000, 3_000_000_000) for i in range(5)] + ["Later one", "Later two"]


def test_sort_uses_locale_order(spark):
    df = spark.createDataFrame([(1, "banana", "open"), (2, "Apple", "closed"), (3, "éclair", "open"), (4, "zoo", "open")], "seq bigint, name string, status string")
    assert [r["name"] for r in facets.order_by(df, "company-asc").collect()] == ["Apple", "banana", "éclair", "zoo"]
    assert [r["seq"] for r in facets.order_by(df, "default").collect()] == [1, 3, 4, 2]


def test_numbering_over_stretches(spark):
    from gleaner.operators.ranking import numbered
    df = spark.range(0, 50).select((F.col("id") * 7 % 50).alias("seq"), (F.col("id") % 3).alias("g"))
    rows = numbered(df, "n", "g", "seq").orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(1, 51))
    assert [(r["g"], r["seq"]) for r in rows] == sorted((r["g"], r["seq"]) for r in rows)


def test_quarantine_cycle(spark):
    """Four holds stay, the fifth retires, the sixth starts again."""
    items = spark.createDataFrame([("c", "x", i, ["r"], "n") for i in range(6)] + [("c", "y", i, ["r"], "n") for i in range(4)],
                                  "category string, fp string, seq bigint, reasons array<string>, name string")
    items = items.select("category", "fp", "seq", "reasons", F.struct("name").alias("item"))
    empty = spark.createDataFrame([], "category string, fp string, attempts bigint, first_held timestamp_ntz, last_seen timestamp_ntz, reasons array<string>, item struct<name:string>")
    queue, retired = state.quarantine_hold(empty, items, "2026-01-01 00:00:00")
    assert {(r["fp"], r["attempts"]) for r in queue.collect()} == {("x", 1), ("y", 4)}
    assert [(r["fp"], r["times_retired"]) for r in retired.collect()] == [("x", 1)]
    again, retired = state.quarantine_hold(queue, items.where("fp = 'y' and seq = 0"), "2026-01-02 00:00:00")
    assert {(r["fp"], r["attempts"]) for r in again.collect()} == {("x", 1)}
    assert [(r["fp"], r["times_retired"]) for r in retired.collect()] == [("y", 1)]


def test_gate_blocks_and_keeps_old_rows(spark):
    cols = "category string, name string, application_link string, status string"
    before = spark.createDataFrame([("a", f"name {i}", f"https://x.io/page{i}", "open") for i in range(40)] + [("b", f"b name {i}", f"https://y.io/page{i}", "open") for i in range(40)], cols)
    after = before.where("category = 'b' or name < 'name 2'")
    decision = gate.gate_decide(gate.gate_metrics(before, after, before.limit(0)))
    assert {r["category"]: r["allowed"] for r in decision.collect()} == {"a": False, "b": True}
    out = gate.gated_snapshot(before, after, decision).groupBy("category").count().collect()
    assert {r["category"]: r["count"] for r in out} == {"a": 40, "b": 40}


def test_upcoming_days(spark):
    rows = [("open", "2026-09-08"), ("open", "2026-09-04"), ("open", "2026-09-02"), ("open", "2026-09-03"), ("closed", "2026-09-02"), ("open", "check 2026-09-02")]
    df = spark.createDataFrame(rows, "status string, deadline string")
    assert sorted(r["days_left"] for r in reminders.upcoming_deadlines(df, AS_OF).collect()) == [1, 3, 7]


def test_digest_lines_stand_together(spark):
    # person by person, every row of a written digest repeats a whole name
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")   # as for many people
    try:
        upcoming = spark.createDataFrame([(i, "jobs", f"name {i}", "2026-09-02", 1, "") for i in range(20)], "seq long, category string, name string, deadline string, days_left int, application_link string")
        people = spark.createDataFrame([(f"p{i}@x.org", "", "jobs") for i in range(50)], "email string, whatsapp string, categories string")
        got = [(r.seq, r.email) for r in reminders.digest_items(upcoming, people).collect()]
    finally:
        spark.conf.set(key, before)
    assert sorted(got) == sorted((i, f"p{j}@x.org") for i in range(20) for j in range(50))
    assert sum(a[0] != b[0] for a, b in zip(got, got[1:])) < 20


@pytest.mark.parametrize("how", ["left", "inner", "left_anti"])
def test_lookup_with_hot_and_missing_keys(spark, how):
    from gleaner.operators import joins
    left = spark.range(60).select(F.col("id").alias("seq"), F.when(F.col("id") < 30, "hot").when(F.col("id") < 40, F.concat(F.lit("k"), "id")).alias("key"))
    right = spark.createDataFrame([("hot", 1), ("k31", 2), ("unused", 3)], "key string, v int")
    want = sorted(map(str, left.join(right, "key", how).select("seq", *([] if how == "left_anti" else ["v"])).collect()))
    got = joins.lookup(left, right, ["key"], how=how)
    assert sorted(map(str, got.select("seq", *([] if how == "left_anti" else ["v"])).collect())) == want


def test_routing_by_catalogue(spark):
    """Parsers by catalogue entry, disabled entries skipped, duplicates dropped."""
    from gleaner.sources.registry import route
    feed = "<rss><item><title>Harbour hackathon opens</title><link>https://f.io/1</link></item><item><title>Plain company news</title><link>https://f.io/2</link></item></rss>"
    table = "| Name | Link |\n|---|---|\n| Alpha Program | https://a.io/1 |\n| Alpha  program | https://a.io/2 |\n"
    caps = spark.createDataFrame([(1, "t", table), (2, "l", "- [Beta Fellows](https://b.io/1) - paid\n"), (3, "f", feed), (4, "x", table)],
                                 "capture_id bigint, url string, body string")
    cat = spark.createDataFrame([("T", "t", "markdown_table", "open-source-programs", None, None, True), ("L", "l", "markdown_list", "fellowships", None, None, True),
                                 ("F", "f", "feed", "hackathons", 30, "keywords", True), ("X", "x", "markdown_table", "jobs", None, None, False)],
                                "name string, url string, parser string, category string, limit int, filter string, enabled boolean")
    assert {(r["origin"], r["category"], r["name"]) for r in route(caps, cat).collect()} == {
        ("T", "open-source-programs", "Alpha Program"), ("L", "fellowships", "Beta Fellows"), ("F", "hackathons", "Harbour hackathon opens")}


def test_all_builtin_sources_are_registered_and_run(spark):
    import json
    from gleaner.sources import builtin, registry
    builtin.register_builtin(1_700_000_000)
    assert list(registry.registered()) == registry.ORDER
    card = json.dumps([{"name": "Campus Hack Night", "link": "/e/1", "organizer": "Org"}])
    table = "<table><tbody><tr><td>Acme</td><td>Engineer</td><td>Pune</td><td><a href='https://a.io/1'>x</a></td></tr></tbody></table>"
    bodies = [("codeforces", "c", json.dumps({"status": "OK", "result": [{"id": i, "name": f"Round {i}", "phase": "BEFORE"} for i in range(20)]})),
              ("leetcode", "l", json.dumps({"data": {"allContests": [{"title": f"W{i}", "titleSlug": f"w{i}", "startTime": 1_800_000_000 + i, "duration": 60} for i in range(12)]}})),
              ("gsoc", "g", "{}"), ("jobspy", "j", json.dumps({"jobs": [{"title": "Software Engineer Intern", "companyName": "A"}]})),
              ("kontests", "k", json.dumps({"future_contests": [{"contest_name": "S", "contest_code": "S1"}]})),
              ("github", builtin.CATALOGUE[0][1], table), ("devpost", "d", json.dumps({"hackathons": [{"title": "H", "url": "https://h.io"}]})),
              *[(name, "u", card) for name in builtin.CARD_SITES]]
    caps = spark.createDataFrame([(i, *b) for i, b in enumerate(bodies)], "capture_id bigint, source string, url string, body string")
    out, errors = registry.union_sources(caps)
    rows = out.orderBy("seq").collect()
    assert errors == [] and [r["seq"] for r in rows] == list(range(1, len(rows) + 1))
    counts = {r["origin"]: sum(x["origin"] == r["origin"] for x in rows) for r in rows}
    assert counts == {"github": 1, "codeforces": 20, "leetcode": 12, "gsoc": 1, "company": 5, "jobspy": 1, "kontests": 1, "devpost": 1, **{n: 1 for n in builtin.CARD_SITES}}
    ranks = [registry.ORDER.index(r["origin"]) for r in rows]
    assert ranks == sorted(ranks)
    registry._SOURCES.clear()


def test_probe_answers(spark):
    """405 asks a second capture; other answers are typed by hand."""
    from gleaner.operators.plausibility import record_scores
    records = spark.createDataFrame([(i, "jobs", "Harbour engineering role", f"https://a.io/{i}") for i in range(7)], "seq bigint, category string, name string, application_link string")
    page = "<p>harbour engineering</p>"
    answers = [(0, 0, 200), (1, 0, 403), (2, 0, 405), (2, 1, 200), (3, 0, 405), (4, 0, 405), (4, 1, 500), (5, 0, 404)]
    caps = spark.createDataFrame([(f"https://a.io/{i}", tier, status, page) for i, tier, status in answers], "url string, tier int, status int, body string")
    got = {r["seq"]: r["s_url"] for r in record_scores(records, caps, AS_OF).collect()}
    assert got == {0: 1.0, 1: 0.7, 2: 1.0, 3: 0.4, 4: 0.2, 5: 0.2, 6: 0.2}


@pytest.mark.parametrize("body,rows", [
    ("<table><tr><td>a</td><td>b</td><th>c</th></tr><tr><td>d</td><td>e</td></tr></table>", ["a b c"]),
    ("<tr><td>1</td><td>2</td><td>3</td><tr><td>4</td><td>5</td><td>6</td></tr><tr><td>7</td><td>8</td><td>9</td>", ["4 5 6"]),
    ("<tr><td>A</td><td>in <table><tr><td>x</td><td>y</td><td>z</td></tr></table></td><td>B</td></tr>", ["x y z B", "x y z B"]),
    ("<tr><td>A</td><td><table><tr><td>x</td></tr></table></td><td>B</td><td>C</td></tr>", ["x B C"]),
    ("<tr><td>a<td>b</td><td>c</td><td>d &amp; e</td></tr>", ["b c d & e"]),
    ("<tr><td>a</td><td>b</td><td>c</td></tr><!-- <tr><td>1</td><td>2</td><td>3</td></tr> --><tr><td>d</td><td>e</td><td>f</td></tr>", ["a b c", "d e f"]),
    ("<tr><td>a</td><td>b</td><td>c</td></tr><!-- <tr><td>1</td><td>2</td><td>3</td></tr>", ["a b c"]),
    ("<td>a</td><td>b</td><td>c</td></tr>", ["a b c"]),
    ("<TR class='x'><TD>a</TD ><td>b</td><td>" + "long " * 40_000 + "</td></TR>", ["a b " + ("long " * 40_000).strip()]),
    ("<tr>" * 3000 + "<td>a" * 3000, []), ("", []), (None, [])])
def test_html_rows(spark, body, rows):
    from gleaner.sources.documents import html_rows
    got = html_rows(spark.createDataFrame([(1, body)], "doc_id int, body string"), "doc_id").orderBy("pos").collect()
    assert [" ".join(c["text"] for c in r["cells"]) for r in got] == rows


def test_location_summary_reads_the_records_once(spark):
    from gleaner.operators import location
    from gleaner.plans.fixtures import Inputs
    out = location.location_summary(location.geo_policy(location.classify_location(Inputs(spark, "/root/testdata/sf0.001").opp)))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation ") == 1


def test_clean_location_of_mixed_separators(spark):
    import re
    from gleaner.operators.location import clean_location
    rows = [" a  b ", "a |b", "x\t\ty z", "San FranciscoNew York", "a  b", "p > q/r \\ s", "aB cD EF", "\n a\n", "x - y – z", "  ", "a →"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(clean_location("t")).collect()]
    assert got == [re.sub(r"[\s–—→↳>|/\\]+", " ", re.sub(r"(?<=[a-z])([A-Z])", r" \1", r)).strip(" ") for r in rows]


def test_token_shares_compute_each_side_once(spark):
    df = spark.createDataFrame([("b a c", "a b x"), ("", "a"), (None, "a"), ("a", "a a")], "p string, q string")
    sides = [F.array_distinct(F.filter(F.split(c, " "), lambda w: w != "")) for c in ("p", "q")]
    out = df.select(text.jaccard(*sides).alias("j"), text.containment(*sides).alias("c"))
    assert [tuple(r) for r in out.collect()] == [(0.5, 2 / 3), (0.0, 0.0), (0.0, 0.0), (1.0, 1.0)]
    for share in (text.jaccard, text.containment):
        plan = df.select(share(*sides).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("array_distinct(") == 2


def test_route_parses_before_it_sorts(spark, monkeypatch):
    from gleaner.sources import registry
    plans, numbered = [], registry.numbered

    def seen(df, *args):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return numbered(df, *args)

    monkeypatch.setattr(registry, "numbered", seen)
    caps = spark.createDataFrame([(1, "u", "- [Name one](https://a.example.org/1) - note")], "capture_id bigint, url string, body string")
    cat = spark.createDataFrame([("L", "u", "markdown_list", "fellowships", None, None, True)], "name string, url string, parser string, category string, limit int, filter string, enabled boolean")
    assert [r["name"] for r in registry.route(caps, cat).collect()] == ["Name one"]
    assert len(plans) == 1 and "Generate" not in plans[0]
