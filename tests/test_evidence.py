"""The network breaker against a plain loop over the run."""

import random

import pytest

from gleaner.operators import evidence as E

SCHEMA = "capture_id bigint, tier int, status int, error string"


def loop(rows, least=6, rate=0.75):
    attempts = failures = 0
    for capture_id, tier, status, error in sorted((r for r in rows if r[1] == 0), key=lambda r: r[0]):
        attempts += 1
        failures += bool(error.startswith(("network:", "unexpected:")) or not error and status is None)
        if attempts >= least and failures >= rate * attempts:
            return attempts, failures, capture_id, True
    return attempts, failures, None, False


def made(rng, n, bad):
    ids = rng.sample(range(10 * n), n)
    return [(i, int(rng.random() < 0.1), *(rng.choice([(None, ""), (None, "network:reset"), (500, "unexpected:x")]) if rng.random() < bad(i / n / 10) else rng.choice([(200, ""), (404, ""), (403, "")])))
            for i in ids]


@pytest.mark.parametrize("bad", [lambda x: 0.1, lambda x: 0.95 if x < 0.1 else 0.2, lambda x: 0.2 if x < 0.1 else 0.95, lambda x: 0.74, lambda x: 1.0])
def test_breaker_follows_the_run(spark, monkeypatch, bad):
    monkeypatch.setattr(E, "_STRETCH", 4)   # several groups of stretches
    rows = made(random.Random(6), 300, bad)
    got = E.network_health(spark.createDataFrame(rows, SCHEMA).repartition(7)).first()
    assert tuple(got) == loop(rows)


def test_early_cluster_trips_though_the_run_recovers(spark):
    rows = [(i, 0, None, "network:down") for i in range(6)] + [(i, 0, 200, "") for i in range(6, 60)]
    assert tuple(E.network_health(spark.createDataFrame(rows, SCHEMA)).first()) == (6, 6, 5, True)


def test_no_captures_and_equal_ids(spark):
    assert tuple(E.network_health(spark.createDataFrame([], SCHEMA)).first()) == (0, 0, None, False)
    rows = [(None, 0, 200, "")] + [(3, 0, None, "network:x")] * 3 + [(3, 0, 200, "")] * 2
    assert tuple(E.network_health(spark.createDataFrame(rows, SCHEMA)).first()) == (6, 3, None, False)
