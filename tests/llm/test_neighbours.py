"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from gleaner.llm import neighbours as nb

SCHEMA = "vec_id long, embedding array<float>, label int, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v], 1, 0.0) for i, v in rows], SCHEMA)


def brute(rows, every=50, k=5):
    good = [(i, np.float32(v).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(np.float32(v))]
    out = {}
    for q, v in good:
        if q % every == 0:
            near = [(-float(v @ w) / np.sqrt(float(v @ v) * float(w @ w)), i) for i, w in good if i != q and len(w) == len(v)]
            out[q] = [(i, -s) for s, i in sorted(near)[:k]]
    return out


def got(spark, rows, **options):
    out = {}
    for r in sorted(nb.nearest(frame(spark, rows), **options).collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(found, want):
    return sum(len({i for i, _ in found.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_recall_on_random_and_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(nb, "SHARD", 400)
    monkeypatch.setattr(nb, "BLOCK", 8)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((5, 32))
    rows = [(i, rng.standard_normal(32) if i % 2 else centres[i % 5] + 0.1 * rng.standard_normal(32)) for i in range(1500)]
    found, want = got(spark, rows), brute(rows)
    assert recall(found, want) >= 0.9 and {len(v) for v in found.values()} == {5}
    for q, near in found.items():
        exact = dict(brute([(q, dict(rows)[q])] + [(i, dict(rows)[i]) for i, _ in near])[q])
        assert all(s == pytest.approx(exact[i], abs=1e-12) for i, s in near)


def test_ties_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal(8)
    rows = [(i, v) for i in range(0, 120)] + [(200 + i, rng.standard_normal(8)) for i in range(30)]
    rows += [(1000, None), (1050, [0.0] * 8), (1100, [float("nan")] + [1.0] * 7), (1150, [float("inf")] + [1.0] * 7), (1200, [None] + [1.0] * 7), (None, v), (1250, [1.0, 2.0, 3.0])]
    found = got(spark, rows)
    assert [i for i, _ in found[0]] == [1, 2, 3, 4, 5] and [i for i, _ in found[50]] == [0, 1, 2, 3, 4]
    assert set(found) == {0, 50, 100, 200}
    assert {i for near in found.values() for i, _ in near} <= set(range(120)) | set(range(200, 230))


def test_few_candidates_repeated_ids_and_empty_table(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [3.0, 3.0])]
    assert got(spark, rows) == {0: [(2, pytest.approx(0.5 ** 0.5)), (1, 0.0)]}
    assert got(spark, []) == {}
    assert got(spark, [(50, [1.0])]) == {}


def test_extreme_components(spark):
    """A common factor of a vector, however large or small, changes nothing."""
    rng = np.random.default_rng(6)
    plain = [(i, rng.standard_normal(8)) for i in range(150)]
    wild = [(i, v * 2.0 ** float(rng.choice([-900, -600, 0, 600, 900]))) for i, v in plain]
    df = [spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>") for rows in (plain, wild)]
    a, b = (sorted(map(tuple, nb.nearest(d).collect())) for d in df)
    assert a == b and len(a) == 15
