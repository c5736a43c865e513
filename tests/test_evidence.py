"""Corroboration with its evidence, and greedy pairs, against plain loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from claimlens.operators.joins import HEARD, evidence, greedy_nearest, nearest_free, settings_sweep


def pairs_by_hand(left, right, reach):
    free, out = set(range(len(right))), []
    for t in left:
        j = min((j for j in free if abs(right[j] - t) <= reach), key=lambda j: (abs(right[j] - t), right[j], j), default=None)
        free.discard(j)
        out.append(j)
    return out


def test_nearest_free():
    for seed in range(400):
        rng = random.Random(seed)
        step = rng.choice([0.5, 1.0, 7.0])
        left, right = (sorted(rng.randrange(30) * step for _ in range(rng.randrange(25))) for _ in range(2))
        for reach in (0.0, 2.0, 6.0, 100.0):
            assert nearest_free(left, right, reach) == pairs_by_hand(left, right, reach)


def test_nearest_free_on_a_long_run():
    n = 200_000
    got = nearest_free([float(n)] * n, [float(i) for i in range(2 * n)], 1e9)
    assert len(set(got)) == n and got[:4] == [n, n - 1, n + 1, n - 2]


def test_greedy_pairs_keep_ids(spark):
    rng = random.Random(2)
    big = 2**60
    rows = [(rng.choice("ab"), big + i, float(rng.randrange(400)) / 2) for i in range(240)]
    a, b = (spark.createDataFrame(x, "g string, id long, t double") for x in (rows[:120], rows[120:]))
    want = set()
    for g in "ab":
        x, y = (sorted((t, i) for k, i, t in part if k == g) for part in (rows[:120], rows[120:]))
        taken = pairs_by_hand([t for t, _ in x], [t for t, _ in y], 3.0)
        want |= {(i, None if j is None else y[j][1]) for (_, i), j in zip(x, taken)} | {(None, y[j][1]) for j in set(range(len(y))) - set(taken)}
    assert {tuple(r) for r in greedy_nearest(a, b, "g", 3.0).collect()} == want
    assert greedy_nearest(a.filter("g = 'z'"), b.filter("g = 'z'"), "g").count() == 0


def evidence_by_hand(req, heard, witnesses, pad, least):
    out = []
    for sid, family, start, stop, figures, words in req:
        want = [raw for _, _, raw in figures]
        if not figures:
            out.append((sid, "no_quantity", None, (), (), (), ()))
            continue
        others = [w for w in sorted(witnesses, key=lambda w: (w[1], w[0])) if w[2] != family]
        if not others:
            out.append((sid, "no_witness", None, (), tuple(want), (), ()))
            continue
        best = None
        for name, _, _ in others:
            said = sorted((h for h in heard if h[0] == name and start - pad <= h[3] <= stop + pad), key=lambda h: (h[3], h[7]))
            matched, missing, unanchored = [], [], []
            for kind, value, raw in figures:
                equal = [h for h in said if h[4] == kind and abs(h[5] - value) <= 1e-9 * max(abs(value), 1.0)]
                anchor = lambda h: 1.0 if len(words) < 3 else len(set(words) & set(h[8][max(0, h[9] - 12) : h[9] + 12])) / len(words)
                if any(anchor(h) >= least for h in equal):
                    matched.append(raw)
                else:
                    missing.append(raw)
                    unanchored += [raw] if equal else []
            status = "confirmed" if not missing else "divergent" if said else "absent"
            found = (sid, status, name, tuple(matched), tuple(missing), tuple(unanchored), tuple(h[6] for h in said[:HEARD]) if status == "divergent" else ())
            if status == "confirmed":
                best = found
                break
            if best is None or (best[1] == "absent" and status == "divergent"):
                best = found
        out.append(best)
    return sorted(out)


@pytest.mark.parametrize(("seed", "pad", "least", "families"), [(1, 3.0, 0.2, "AAB"), (2, 20.0, 0.5, "ABC"), (3, 0.0, 0.0, "AAA"), (4, 5.0, 0.3, "BAB")])
def test_evidence(spark, seed, pad, least, families):
    rng = random.Random(seed)
    words, kinds, values = ["dette", "emploi", "budget", "impot", "taux"], ["percentage", "magnitude"], [0.0, 0.5, -3.0, 2.7e6]
    figure = lambda: (rng.choice(kinds), v := rng.choice(values), f"{v:g}")
    req = [(k, rng.choice("ABD"), s := float(rng.randrange(150)), s + rng.choice([0.0, 0.5, 9.0, 60.0]), [figure() for _ in range(rng.randrange(4))], rng.sample(words, rng.randrange(5))) for k in range(60)]
    witnesses = [(f"w{i}", i, f) for i, f in enumerate(families)]
    heard = [(*(witnesses[rng.randrange(2)]), float(rng.randrange(150)), k, v * (1 + rng.choice([0, 1e-10, 1e-8])), f"{raw}'{n}", n, rng.sample(words, 4), rng.randrange(4)) for n in range(120) for k, v, raw in [figure()]]
    r = spark.createDataFrame(req, "statement_id int, family string, start double, stop double, figures array<struct<kind:string,value:double,raw:string>>, words array<string>")
    h = spark.createDataFrame(heard, "witness string, witness_seq int, w_family string, t double, kind string, value double, raw string, place int, around array<string>, position int")
    w = spark.createDataFrame(witnesses, "witness string, witness_seq int, w_family string")
    got = sorted(tuple(tuple(x) if isinstance(x, list) else x for x in row) for row in evidence(r, h, w, pad, least).collect())
    assert got == evidence_by_hand(req, heard, witnesses, pad, least)


def test_evidence_without_anything(spark):
    r = spark.createDataFrame([(1, "A", 0.0, 1.0, [("percentage", 1.0, "1 %")], ["a"])], "statement_id int, family string, start double, stop double, figures array<struct<kind:string,value:double,raw:string>>, words array<string>")
    h = spark.createDataFrame([], "witness string, witness_seq int, w_family string, t double, kind string, value double, raw string, place int, around array<string>, position int")
    w = spark.createDataFrame([], "witness string, witness_seq int, w_family string")
    assert tuple(evidence(r, h, w).first()) == (1, "no_witness", None, [], ["1 %"], [], [])
    assert evidence(r.filter("statement_id = 2"), h, w).count() == 0


def _asked(spark, rows):
    return spark.createDataFrame(rows, "statement_id long, family string, start double, stop double, figures array<struct<kind:string,value:double,raw:string>>, words array<string>")


def _said(spark, rows):
    return spark.createDataFrame(rows, "witness string, witness_seq int, w_family string, t double, kind string, value double, raw string, place long, around array<string>, position int")


@pytest.mark.parametrize("pads, anchors", [([1.0, 2.0, 12.0], [0.0, 0.3, 0.6]), ([0.0, 0.5, 40.0], [0.0, 0.7]), ([3.0], [0.4])])
def test_sweep_equals_loops(spark, pads, anchors):
    rng = random.Random(5)
    words = lambda: [w + str(rng.randrange(3)) for w in "abc"]
    figure = lambda: ("n", float(rng.randrange(3)), "")
    req = []
    for i in range(60):
        at = rng.randrange(160) / 2
        req.append((i, rng.choice("AB"), at, at + rng.choice([0.0, 0.5, 7.0]), [figure() for _ in range(rng.randrange(3))], words()))
    heard = [(w, s, f, rng.randrange(200) / 2, "n", float(rng.randrange(3)), "", i, words(), 0) for i in range(150) for w, s, f in [rng.choice([("x", 1, "A"), ("y", 2, "B"), ("z", 3, "B")])]]
    want = set()
    for p in pads:
        for a in anchors:
            n = 0
            for _, family, lo, hi, figures, mine in req:
                hit = lambda v, w: any(h[0] == w and h[5] == v and lo - p <= h[3] <= hi + p and len(set(mine) & set(h[8])) / 3 >= a for h in heard)  # noqa: B023, E731
                n += bool(figures) and any(all(hit(v, w) for _, v, _ in figures) for w, f in (("x", "A"), ("y", "B"), ("z", "B")) if f != family)
            asks = sum(bool(r[4]) for r in req)
            want.add((p, a, len(req), asks, n, round(n / asks + 1e-12, 3)))
    assert {tuple(r)[:-1] for r in settings_sweep(_asked(spark, req), _said(spark, heard), pads, anchors).collect()} == want


def test_crowded_windows_do_not_pair_up(spark):
    """Many statements and rows of one figure in one window: 3.6 thousand million pairs, and as many again for what is heard instead."""
    n, words = 60_000, ["a", "b", "c"]
    at = (F.col("id") % 977).cast("double")
    array = lambda x: F.array(*map(F.lit, x))
    figure = F.struct(F.lit("n").alias("kind"), F.lit(1.0).alias("value"), F.lit("1").alias("raw"))
    other = F.struct(F.lit("n").alias("kind"), F.lit(9.0).alias("value"), F.lit("9").alias("raw"))
    req = spark.range(n).select(F.col("id").alias("statement_id"), F.lit("A").alias("family"), at.alias("start"), at.alias("stop"), F.array(figure, other).alias("figures"), array(words).alias("words"))
    heard = spark.range(n).select(F.lit("w").alias("witness"), F.lit(1).alias("witness_seq"), F.lit("B").alias("w_family"), at.alias("t"), F.lit("n").alias("kind"), F.lit(1.0).alias("value"), F.concat(F.lit("r"), F.col("id")).alias("raw"), F.col("id").alias("place"), array(words).alias("around"), F.lit(0).alias("position"))
    began = time.time()
    out = evidence(req, heard, heard.select("witness", "witness_seq", "w_family").distinct(), 300.0, 0.3)
    got = {r["statement_id"]: r for r in out.filter("statement_id in (0, 500, 976)").collect()}
    assert {(tuple(r["matched"]), tuple(r["missing"]), r["status"]) for r in got.values()} == {(("1",), ("9",), "divergent")}
    assert {k: r["heard"] for k, r in got.items()} == {k: [f"r{max(k - 300, 0) + 977 * i}" for i in range(6)] for k in got}
    sweep = settings_sweep(req.withColumn("figures", F.array(figure)), heard, [100.0, 300.0], [0.0, 0.3]).collect()
    assert [r["corroborated"] for r in sweep] == [n] * 4
    assert time.time() - began < 120
