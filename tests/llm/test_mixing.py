"""Targets, schedule and what is taken, against plain sequential versions."""

import random
import re

import pytest

from gleaner.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        rest = total - sum(fixed.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed.update({s: most * sizes[s] for s in over})


def mixed(spark, rows, **options):
    df = spark.createDataFrame([(d, t, s, 1, 2) for d, t, s in rows], "doc_id long, text string, source string, size int, target int")
    return [r.asDict() for r in mixing.mix(df, **options).collect()]


def corpus(n=300, seed=2):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", "Z", "é", "10", "9", None])) for i in range(n)]
    return rows + [(n, None, "b"), (n + 1, " \t\n", "empty"), (n + 2, "x\x0by z " * 3000, "b"), (None, "one two", "tiny")] + [(5, "rep eat", "a")] * 40


@pytest.mark.parametrize("block", [7, 128])
def test_taken_meets_targets(spark, block, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 16)
    monkeypatch.setattr(mixing, "STRETCH", 32)
    rows = corpus()
    out = mixed(spark, rows, block=block)
    assert sorted(((r["id"], r["source"], r["size"]) for r in out), key=str) == sorted(
        ((d, s, len(re.findall(r"[^ \t-\r]+", t or ""))) for d, t, s in rows), key=str)
    sizes = {}
    for r in out:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = plain_targets(sizes)
    for s in sizes:
        mine = [r for r in out if r["source"] == s]
        assert {r["source_size"] for r in mine} == {sizes[s]}
        assert all(r["target"] == pytest.approx(want[s], rel=1e-12) for r in mine)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in mine)
        assert sum(r["taken"] for r in mine) == pytest.approx(want[s], abs=0.5001)


def test_reruns_agree(spark):
    rows = corpus(100, 9)
    digest = lambda out: sorted(((r["id"], r["source"], r["size"], r["taken"]) for r in out), key=str)
    assert digest(mixed(spark, rows)) == digest(mixed(spark, rows[::-1]))


def test_empty_and_blank_tables(spark):
    assert mixed(spark, []) == []
    assert [(r["size"], r["target"], r["taken"]) for r in mixed(spark, [(1, None, None), (2, " ", "a")])] == [(0, 0.0, 0)] * 2


def test_one_source_takes_everything_once(spark):
    out = mixed(spark, [(i, "a b c d e", "s") for i in range(50)])
    assert all(r["taken"] == 5 and r["target"] == 250.0 for r in out)


def test_schedule_spreads_the_sources(spark):
    plan = spark.createDataFrame([("a", 10, 9000, 5.0, 6000.0), ("b", 10, 9000, 2.0, 3000.0)], "source string, n_docs long, source_size long, weight double, target double")
    slots = [r.source for r in mixing.schedule(plan, 30).orderBy("slot").collect()]
    assert slots.count("a") == 200 and slots.count("b") == 100
    for i in range(0, 270, 30):  # every stretch holds the sources by weight
        assert 18 <= slots[i:i + 30].count("a") <= 22


def test_mixed_documents_repeat_as_taken(spark):
    rows = corpus(200, 3)
    df = spark.createDataFrame([(d, t, s, 1) for d, t, s in rows], "doc_id long, text string, source string, __x int")
    out = mixing.mixed(df)
    assert out.columns == df.columns
    found = out.collect()
    takes = mixed(spark, rows)
    for s in {r["source"] for r in takes}:
        words = sum(len(re.findall(r"[^ \t-\r]+", r.text)) for r in found if r.source == s)
        largest = max(r["size"] for r in takes if r["source"] == s)
        copies = 80 if s == "a" else 0  # the repeated row's copies are shared at random
        assert abs(words - sum(r["taken"] for r in takes if r["source"] == s)) <= largest + copies
    counts = {}
    for r in found:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert max(n for d, n in counts.items() if d != 5) <= 3
    assert mixing.mixed(df.limit(0)).collect() == []


def test_texts_are_not_shuffled_to_be_repeated(spark):
    """The number of times comes with a row per source, also if a row per document is too many to broadcast."""
    rows = [(i, f"{i} " + "w " * (i % 90), "abcde"[i % 11 % 5]) for i in range(4000)] + [(9000 + i, " ", None) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "16k")
    try:
        out = mixing.mixed(df)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        counts = {}
        for r in out.collect():
            counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    finally:
        spark.conf.set(key, before)
    want = {r["id"]: int(r["taken"] / r["size"] + 0.5) for r in mixed(spark, rows) if r["size"]}
    assert counts == {d: n for d, n in want.items() if n}
    assert {0, 1, 2, 3} & set(want.values()) and len({want[i] for i in range(4000)}) > 1


@pytest.mark.parametrize("n", [1, 3, 300])
def test_grid_of_cells_follows_the_sources(spark, n):
    # the cells are broadcast: 65,536 of them for three sources took the driver's memory
    weight = [1 + (i * 7919) % 97 for i in range(n)]
    rows = spark.createDataFrame([(f"s{i:03}", 1000, float(w)) for i, w in enumerate(weight)], "source string, source_size long, target double")
    cells, grid = mixing._cells(rows, n, float(sum(weight)))
    found = cells.collect()
    assert len(found) <= 130 * n
    at = {}
    for c in found:
        at.setdefault(c.cell, []).append(c)
    edges = [x for c in found for x in (c.low, c.high - 1e-9)]
    for point in [i / 1009 for i in range(1009)] + [x for x in edges if 0 <= x < 1]:
        hits = [c for c in at[int(point * grid)] if c.low <= point and (point < c.high or c.next is None)]
        assert len(hits) == 1


def test_plans_of_the_mix_stay_short(spark):
    # every finished stage plans the rest of a query anew, so one plan of the whole mix filled the driver's heap
    df = spark.createDataFrame([(d, t, s) for d, t, s in corpus(60)], "doc_id long, text string, source string")
    plan = mixing.mix(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") < 10
