"""Publication and incremental runs."""

import uuid

from pyspark.sql import functions as F

from gleaner.plans.fixtures import AS_OF, NOW
from gleaner.schema import OPPORTUNITY, conform
from gleaner.session import shared_dir
from gleaner.sources.tables import current_version, publish, read_category, read_state, write_category


def folder(spark, label):
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def test_publish_moves_the_pointer_and_is_idempotent(spark):
    root = folder(spark, "pub")
    assert current_version(spark, root) is None
    publish(spark.range(3), root, "1")
    publish(spark.range(9), root, "1")     # a replay does not rewrite
    assert read_state(spark, root, "id bigint").count() == 3
    publish(spark.range(5), root, "2")
    assert current_version(spark, root) == "2" and read_state(spark, root, "id bigint").count() == 5


def test_unfinished_version_is_not_read(spark):
    root = folder(spark, "pub")
    publish(spark.range(3), root, "1")
    spark.range(7).write.parquet(f"{root}/v-2/part")     # no marker of completion at its root
    assert read_state(spark, root, "id bigint").count() == 3


def test_category_files(spark):
    assert read_category(spark, "/tmp/absent-" + uuid.uuid4().hex).count() == 0
    path = folder(spark, "cat")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "category string, n int")
    write_category(df, path)
    write_category(spark.createDataFrame([("b", 3)], "category string, n int"), path)
    assert {(r["category"], r["n"]) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}


def records(spark, rows):
    return conform(spark.createDataFrame(rows, "seq bigint, category string, name string, application_link string, source string, deadline string, status string"))


def test_incremental_run_and_replay(spark):
    from gleaner.streaming.incremental import ledger_table, run_incremental
    root = folder(spark, "inc")
    good = "<html><head><title>Aurora Robotics Sprint Challenge</title></head><body>Aurora robotics sprint</body></html>"
    pages = [("https://a.io/events/aurora", 200, good), ("https://b.io/gone/x", 404, "")]
    captures = lambda s: s.createDataFrame([(u, u, st, "", b) for u, st, b in pages], "url string, final_url string, status int, error string, body string")
    first = records(spark, [
        (1, "hackathons", "Aurora Robotics Sprint", "https://a.io/events/aurora", "devfolio", "2026-10-01", "open"),
        (2, "hackathons", "Aurora Robotics Sprint", "https://a.io/events/other", "devfolio", "2026-10-01", "open"),
        (3, "hackathons", "Borealis Data Marathon", "https://b.io/gone/x", "devfolio", "2026-10-01", "open"),
        (4, "hackathons", "Cygnus Chess Gathering", "https://c.io/not/landed", "reddit:r/x", "2026-10-01", "open")])
    first.write.mode("append").parquet(f"{root}/landing")
    out = run_incremental(spark, f"{root}/landing", captures, root, AS_OF, NOW)
    assert [r["name"] for r in out.collect()] == ["Aurora Robotics Sprint"]
    # nothing new: the snapshot stays as it is
    assert run_incremental(spark, f"{root}/landing", captures, root, AS_OF, NOW).count() == 1
    ledger = ledger_table(spark, root).read()
    assert {r["decision"]: r["permanent"] for r in ledger.collect()} == {"accept": False, "reject": True, "quarantine": False}
    # a second, independent source for the held title releases it; the dead one stays suppressed
    records(spark, [(11, "hackathons", "Cygnus Chess Gathering", "https://c.io/second/copy", "hackerearth", "2026-10-01", "open"),
                    (12, "hackathons", "Borealis Data Marathon", "https://b.io/gone/x", "devfolio", "2026-10-01", "open")]
            ).write.mode("append").parquet(f"{root}/landing")
    out = run_incremental(spark, f"{root}/landing", captures, root, AS_OF, NOW)
    assert sorted(r["name"] for r in out.collect()) == ["Aurora Robotics Sprint", "Cygnus Chess Gathering"]
    metrics = {r["stage"]: r["n"] for r in read_state(spark, f"{root}/metrics", "n bigint").collect()}
    assert metrics["suppressed"] == 1 and metrics["requeued"] == 1
    assert set(out.columns) == set(OPPORTUNITY.names) and out.where(F.col("status") != "open").count() == 0


def test_ledger_does_not_wait_for_publication(spark, monkeypatch):
    from gleaner.plans import run
    from gleaner.plans.fixtures import Inputs
    made, write = [], run.materialize
    monkeypatch.setattr(run, "materialize", lambda df, label: made.append(label) or write(df, label))
    t = Inputs(spark, "/root/testdata/sf0.001")
    pages = t.opp_pages
    out = run.batch_run(pages.where("batch = 0"), pages.where("batch <> 0"), t.captures_all, run.empty_ledger(spark), run.empty_queue(spark), AS_OF, NOW)
    assert out.ledger.count() > 0 and "proposed" not in made
    assert out.snapshot.count() > 0 and out.metrics.count() > 0 and out.gate.count() > 0 and made.count("proposed") == 1


def test_landed_documents_are_parsed_by_all_cores(spark):
    from gleaner.plans.fixtures import SPREAD, Inputs
    for name in sorted(SPREAD):
        docs = getattr(Inputs(spark, "/root/testdata/sf0.001"), name)
        assert docs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism, name
