"""Micro-batches cut and shuffled at will give what the batch jobs give."""

from __future__ import annotations

import random

import pytest

from clickloom.operators import security, stats
from clickloom.plans.keyed import latest_per_key
from clickloom.plans.swap import TableFiles
from clickloom.sources import derived
from clickloom.streaming import jobs, limits, sinks, stores

REQUEST = "ip string, id bigint, ts bigint"


def _cuts(rng, rows, parts):
    out = [[] for _ in range(parts)]
    for r in rows:
        out[rng.randrange(parts)].append(r)
    return out


@pytest.mark.parametrize("parts", [1, 4])
def test_limits_for_any_cut_and_order(spark, tmp_path, parts):
    """One address has a third of the requests, and many seconds hold several; windows reach over midnight."""
    rng = random.Random(parts)
    rows = [("hot" if i % 3 == 0 else f"a{i % 5}" if i % 7 else None, i, 86_400 - 300 + rng.randrange(600)) for i in range(400)]
    expected = security.rate_limit(spark.createDataFrame([r for r in rows if r[0]], REQUEST), 4, 20)
    carried = limits.CarriedLimits(str(tmp_path / "t"), 4, 20, delay=10_000)
    for number, part in enumerate(_cuts(rng, rows, parts)):
        for _ in range(2 if number == 1 else 1):  # the engine may repeat a micro-batch
            carried.take(spark.createDataFrame(part, REQUEST), number)
    carried.flush(spark)
    found = sorted(map(tuple, carried.decisions(spark).select("ip", "id", "ts", "allowed").collect()))
    assert found == sorted(map(tuple, expected.select("ip", "id", "ts", "allowed").collect()))
    assert {r[3] for r in found} == {True, False}


def test_limits_decide_while_the_stream_runs(spark, tmp_path):
    """With a short delay most requests are decided before the end, idle addresses leave no state, late ones are told."""
    rng = random.Random(9)
    rows = sorted(((f"a{i % 4}", i, i * 2 + rng.randrange(5)) for i in range(300)), key=lambda r: r[1])
    carried = limits.CarriedLimits(str(tmp_path / "t"), 3, 15, delay=10)
    for number in range(3):
        carried.take(spark.createDataFrame(rows[number * 100:number * 100 + 100], REQUEST), number)
    assert carried.decisions(spark).count() > 280
    carried.take(spark.createDataFrame([("a1", 1000, 5), ("new", 1001, 5000)], REQUEST), 3)
    state = spark.read.parquet(f"{tmp_path}/t/state/3/carried")
    assert state.count() == 0  # all windows have ended by second 4990
    carried.flush(spark)
    found = {r.id: r.allowed for r in carried.decisions(spark).collect()}
    expected = security.rate_limit(spark.createDataFrame([*rows, ("new", 1001, 5000)], REQUEST), 3, 15).collect()
    assert found == {**{r.id: r.allowed for r in expected}, 1000: None}
    assert len(TableFiles(spark, f"{tmp_path}/t").names("state")) <= 2


def test_empty_stream(spark, tmp_path):
    carried = limits.CarriedLimits(str(tmp_path / "t"))
    carried.take(spark.createDataFrame([], REQUEST), 0)
    carried.flush(spark)
    assert carried.decisions(spark).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_latest_store(spark, tmp_path, seed):
    rng, schema = random.Random(seed), "k string, ts bigint, id bigint, v string"
    rows = [(rng.choice(["hot", None, *map(str, range(30))]), rng.randrange(1000), i, rng.choice(["x", None])) for i in range(300)]
    store = stores.LatestStore(str(tmp_path / "t"), schema, "k", ["ts", "id"], buckets=4)
    for part in _cuts(rng, rows, 3):
        for _ in range(2):
            store.merge(spark.createDataFrame(part, schema))
    store.merge(spark.createDataFrame([], schema))
    expected = latest_per_key(spark.createDataFrame(rows, schema), ["k"], ["ts", "id"]).select("k", "ts", "id", "v")
    assert sorted(map(tuple, store.read(spark).collect())) == sorted(map(tuple, expected.collect()))
    plan = store.read(spark)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_expired_keys_go(spark, tmp_path):
    schema = "k string, ts bigint, id bigint"
    store = stores.LatestStore(str(tmp_path / "t"), schema, "k", ["ts", "id"], buckets=4, keep_seconds=100)
    store.merge(spark.createDataFrame([(str(i), i, i) for i in range(20)], schema))
    assert store.read(spark).count() == 20
    store.merge(spark.createDataFrame([("new", 110, 1), ("5", 115, 2)], schema))
    assert sorted(r.k for r in store.read(spark).collect()) == sorted(["new", *map(str, range(5, 6)), *map(str, range(15, 20))])
    store.merge(spark.createDataFrame([("late", 3, 1)], schema))
    assert "late" not in [r.k for r in store.read(spark).collect()]
    store.merge(spark.createDataFrame([("far", 10_000, 1)], schema))
    assert [r.k for r in store.read(spark).collect()] == ["far"]
    assert len(list((tmp_path / "t").rglob("*.parquet"))) == 1


def test_exact_distincts_in_two_steps(spark, sf_dir, tmp_path):
    received = derived.received(spark, sf_dir)
    last = received.selectExpr("max(ts)").first()[0]
    recent = received.where(received.ts > last - 200 * 86400)
    edges = recent.approxQuantile("ts", [0.3, 0.6], 0.001)
    for low, high in zip([0, *edges], [*edges, last], strict=True):
        recent.where((recent.ts > low) & (recent.ts <= high)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(recent.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    store = stores.LatestStore(str(tmp_path / "t"), jobs.COMBINATIONS, "combination", ["n"], buckets=4)
    sinks.run_batches(jobs.payout_combinations_stream(source, "weekly", "400 days"), "t", store.save, "update")
    found = jobs.payout_stats_of(store.read(spark), "weekly")
    exact = stats.payout_stats(recent, 365, last, "weekly").select(*found.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, exact.collect()))
