"""Nearest prints and separation: one matrix and pivot cells give what all pairs give."""

import numpy as np
import pytest

from claimlens.operators.vectors import identify, separated, two_nearest


def vectors(seed, rows=300, prints=90, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    p = [(f"s{i:03}", (centres[i % 9] + 0.25 * rng.normal(size=dim)).tolist()) for i in range(prints)]
    p[7] = ("s007", p[5][1])  # equal prints: the smaller id is nearer
    w = [(i, (centres[i % 9] + 0.3 * rng.normal(size=dim)).tolist()) for i in range(rows)]
    return w + [(900, None), (901, [0.0] * dim), (902, [float("nan")] * dim), (903, p[5][1])], p


def frames(spark, w, p):
    return spark.createDataFrame(w, "k int, v array<double>").repartition(3), spark.createDataFrame(p, "speaker_id string, centroid array<double>").repartition(2)


def by_hand(w, p):
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
    out = {}
    for k, v in w:
        if v is None or not np.isfinite(v).all():
            out[k] = []
            continue
        out[k] = sorted((-round(float(unit(v) @ unit(c)), 9) + 0.0, i) for i, c in p)[:2]
    return out


@pytest.mark.parametrize(("register", "block"), [(None, 1024), (0, 8), (0, 30), (0, 1000)])
def test_two_nearest(spark, register, block):
    w, p = vectors(1)
    rows, prints = frames(spark, w, p)
    got = two_nearest(rows, prints, "k", "v", block, register).collect()
    assert {r["k"]: [(round(x["n"], 9) + 0.0, x["id"]) for x in r["s"]] for r in got} == by_hand(w, p)
    if block == 8:
        assert sum(r["compared"] for r in got) < 0.7 * len(w) * len(p)  # the pivots leave most cells out


def test_identify_and_reasons(spark):
    w, p = vectors(2)
    rows, prints = frames(spark, w, p)
    want = by_hand(w, p)
    for register in (None, 0):
        for r in identify(rows, prints, "k", "v", 0.5, 0.05, 16, register).collect():
            best = want[r["k"]]
            reason = "below threshold" if not best or -best[0][0] < 0.5 else "margin" if best[1][0] - best[0][0] < 0.05 else "accepted"
            assert (r["reason"], r["speaker_id"]) == (reason, best[0][1] if reason == "accepted" else None)
    none = identify(rows, prints.limit(0), "k", "v").collect()
    assert len(none) == len(w) and {(r["reason"], r["speaker_id"]) for r in none} == {("no prints", None)}
    assert identify(rows.limit(0), prints, "k", "v", register=0).count() == 0


def test_separated(spark):
    _, p = vectors(3, prints=40)
    _, prints = frames(spark, [(1, [0.0])], p)
    unit = {i: np.array(c) / np.linalg.norm(c) for i, c in p}
    for threshold in (0.2, 0.97, 0.999):
        want = {i for i in unit if not any(j != i and unit[i] @ unit[j] > threshold for j in unit)}
        for register, block in ((None, 1), (0, 4), (0, 100)):
            assert {r["speaker_id"] for r in separated(prints, threshold, block, register).collect()} == want
