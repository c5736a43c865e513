"""Average linkage against brute force on the full matrix."""

import numpy as np
import pytest

from claimlens.operators.clusters import average_clusters, best_distance, cluster_sweep, hierarchy


def brute(v, distance):
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    groups = [[i] for i in range(len(v))]
    while len(groups) > 1:
        d, a, b = min((float(np.mean(1 - v[x] @ v[y].T)), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        if d >= distance:
            break
        groups[a] += groups.pop(b)
    return {i: min(g) for g in groups for i in g}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 6))
    return np.concatenate([c + rng.normal(size=(9, 6)) * s for c, s in zip(centres, (0.1, 0.3, 0.5, 0.7, 1.5))])


def test_clusters_equal_brute_force(spark, vectors):
    rows = [("a", i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [("b", i, [float(x) for x in v]) for i, v in enumerate(vectors[:1])]
    rows += [("c", 1, None), ("c", 2, [0.0] * 6), ("c", 3, [float("nan")] * 6), ("a", 100, [None] * 6)]
    df = spark.createDataFrame(rows, "rec string, id long, v array<double>")
    out = average_clusters(df, "rec", "id", "v")
    got = {}
    for r in out.collect():
        got.setdefault((r["rec"], r["distance"]), {})[r["id"]] = r["cluster"]
    assert set(got) == {(k, d) for k in "ab" for d in (0.3, 0.4, 0.5, 0.6, 0.7)}
    for d in (0.3, 0.4, 0.5, 0.6, 0.7):
        assert got["a", d] == brute(vectors, d)
        assert got["b", d] == {0: 0}
    sweep = cluster_sweep(out, "rec", 5)
    assert {(r["rec"], r["distance"]): r["clusters"] for r in sweep.collect()} == {k: len(set(c.values())) for k, c in got.items()}
    assert [r["rec"] for r in best_distance(sweep, "rec", 4).collect()] == ["a"]


def test_equal_vectors_and_no_rows(spark):
    assert [round(d, 9) for *_, d in hierarchy(np.tile([[0.6, 0.8]], (4, 1)))] == [0, 0, 0]
    empty = spark.createDataFrame([], "rec string, id long, v array<double>")
    assert average_clusters(empty, "rec", "id", "v").count() == 0
