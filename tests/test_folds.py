"""Folds split over shards against a plain loop; places; greedy pairs."""

import random

import pytest
from pyspark.sql import functions as F

from claimlens.operators import folds
from claimlens.operators.ranking import medians, ranked


def blocks_by_hand(rows, cap):
    out = {}
    for k, a, s, b in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2], r[3])):
        held = out.setdefault(k, [])
        if held and b - held[-1][0] < cap:
            held[-1][1:] = [b, held[-1][2] + 1]
        else:
            held.append([a, b, 1])
    return sorted((k, i, *x) for k, held in out.items() for i, x in enumerate(held))


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize(("shard", "fan"), [(1, 1), (3, 1), (2, 3), (12, 6)])
def test_capped_blocks(spark, seed, shard, fan):
    rng = random.Random(seed)
    rows = []
    for k in range(4 if seed else 1):
        t = 0.0
        for s in range(rng.choice([1, 5, 60])):
            t += rng.choice([0.0, 0.25, 1.0, 3.0, 11.0])
            rows.append((k, t, s, t + rng.choice([0.0, 0.5, 2.0, 12.0, 40.0])))  # some longer than the cap
    df = spark.createDataFrame(rows, "k int, a double, s int, b double").repartition(3)
    got = folds.capped_blocks(df, ["k"], "a", "b", "s", 10.0, shard=shard, fan=fan)
    assert sorted(tuple(r[c] for c in ("k", "block", "start", "stop", "n")) for r in got.collect()) == blocks_by_hand(rows, 10.0)


def test_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None, 1.0, 1, 2.0), (None, 3.0, 2, 50.0), (1, None, 1, 2.0), (1, 5.0, 2, None)], "k int, a double, s int, b double")
    assert [tuple(r) for r in folds.capped_blocks(df, ["k"], "a", "b", "s", 10.0).orderBy("block").collect()] == [(None, 0, 1.0, 2.0, 1), (None, 1, 3.0, 50.0, 1)]
    assert folds.capped_blocks(df.filter("k = 7"), ["k"], "a", "b", "s").count() == 0


def test_a_million_rows_of_one_key(spark):
    n = 1_000_000
    df = spark.range(n, numPartitions=8).select(F.lit("u").alias("k"), (F.col("id") * 0.25).alias("t"))
    r = folds.spaced(df, ["k"], "t", 30.0).first()
    assert (r["n"], r["first"]) == (-(-n // 120), 0.0)


def test_places(spark):
    rows = [(random.Random(i).randrange(20), i) for i in range(500)] + [(None, 500), (3, 501)]
    df = spark.createDataFrame(rows, "v int, id int").repartition(7)
    got = ranked(df, [F.col("v").desc_nulls_last(), F.col("id").asc()]).collect()
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r["v"], r["id"]) for r in sorted(got, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in got) == list(range(1, 503))
    assert ranked(df.filter("id < 0"), [F.col("v")]).count() == 0
    assert "SinglePartition" not in ranked(df, [F.col("v")])._jdf.queryExecution().toString()


def test_medians(spark):
    for values, want in (([], (None, None, None)), ([5.0], (5.0, 5.0, 1)), ([1.0, 9.0, None, 4.0], (4.0, 4.0, 3)), ([2.0, 2.0, 8.0, 9.0], (2.0, 8.0, 4))):
        assert tuple(medians(spark.createDataFrame([(v,) for v in values], "x double"), "x").first()) == want
