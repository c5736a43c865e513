"""Average-linkage clustering of vectors by cosine distance, one hierarchy per recording.

The mean cosine between two clusters of unit vectors is the dot product of their mean vectors, so a
hierarchy needs the clusters' sums alone and no matrix of distances: memory grows with the vectors of one recording,
time with their square. One hierarchy answers every distance of a sweep.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hierarchy(vectors: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (a, b, distance) of row numbers standing for their clusters, by chains of nearest neighbours.

    Average linkage never brings a merged cluster nearer than its parts, so neighbours that choose each other may
    merge at once, in whatever order the chains find them.
    """
    sums, sizes = vectors.astype(float).copy(), np.ones(len(vectors))
    alive, merges, chain = np.ones(len(vectors), bool), [], []
    for _ in range(len(vectors) - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            at = chain[-1]
            d = 1 - sums @ sums[at] / (sizes * sizes[at])
            d[~alive] = np.inf
            d[at] = np.inf
            near = int(d.argmin())
            if len(chain) > 1 and d[chain[-2]] <= d[near]:
                near = chain[-2]
                break
            chain.append(near)
        merges.append((at, near, float(d[near])))
        del chain[-2:]
        keep, gone = min(at, near), max(at, near)
        sums[keep] += sums[gone]
        sizes[keep] += sizes[gone]
        alive[gone] = False
    return merges


def cut(merges: list[tuple[int, int, float]], n: int, distance: float) -> np.ndarray:
    """Smallest row number of each row's cluster, with every merge below the distance made."""
    of = list(range(n))
    for a, b, d in merges:
        if d < distance:
            while of[a] != a:
                a = of[a]
            while of[b] != b:
                b = of[b]
            of[max(a, b)] = min(a, b)
    for i in range(n):  # parents have smaller numbers, so theirs are settled
        of[i] = of[of[i]]
    return np.array(of, np.int64)


def average_clusters(rows: DataFrame, by: str, key: str, vector: str, distances: tuple[float, ...] = (0.3, 0.4, 0.5, 0.6, 0.7)) -> DataFrame:
    """(by, key, distance, cluster): cluster is the smallest key in it.

    Null, zero and non-finite vectors take no part. Keys are expected to be unique in a recording; equal keys are separate rows.
    """
    kind = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([T.StructField(by, kind[by]), T.StructField(key, kind[key]), T.StructField("distance", T.DoubleType()), T.StructField("cluster", kind[key])])
    x = F.col(vector).cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    usable = rows.filter(sound).select(by, key, x.alias("__cl_v"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key, kind="stable", ignore_index=True)
        v = np.stack(group["__cl_v"].to_numpy())
        v /= np.abs(v).max(1, keepdims=True)
        v /= np.sqrt((v * v).sum(1, keepdims=True))
        merges = hierarchy(v)
        return pd.concat([pd.DataFrame({by: group[by], key: group[key], "distance": d, "cluster": group[key].to_numpy()[cut(merges, len(v), d)]}) for d in distances], ignore_index=True)

    return usable.groupBy(by).applyInPandas(run, schema)


def cluster_sweep(clusters: DataFrame, by: str, least: int = 10) -> DataFrame:
    """(by, distance, clusters, large, largest): how many clusters, how many of at least ``least`` members, the largest size."""
    sizes = clusters.groupBy(by, "distance", "cluster").agg(F.count("*").alias("n"))
    return sizes.groupBy(by, "distance").agg(F.count("*").alias("clusters"), F.count_if(F.col("n") >= least).alias("large"), F.max("n").alias("largest"))


def best_distance(sweep: DataFrame, by: str, least_clusters: int = 8) -> DataFrame:
    """(by, distance): most large clusters, of equal ones the smallest distance, among cuts into enough clusters."""
    return sweep.filter(F.col("clusters") >= least_clusters).groupBy(by).agg(F.max_by("distance", F.struct("large", -F.col("distance"))).alias("distance"))
