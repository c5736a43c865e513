"""Approximate nearest neighbours by stable projections and kd-trees.

Vectors are scaled to length one, where the largest cosine is the smallest
Euclidean distance, and projected to ``dims`` dimensions by Gaussian (2-stable)
vectors: projected over true squared distance is chi-square with ``dims`` degrees of freedom. Every row is
indexed: rows are dealt to blocks, and each block has a kd-tree over its projections. A query takes a block's leaves by
ascending projected distance and verifies their rows with the true measure,
until a row as near as the k-th best found would have been met already with
probability ``confidence``: Psi((next projected distance)^2 / (k-th distance)^2) >= confidence.
The blocks' bests are then merged.

Queries meet the index block by block, as packed blocks of rows; neither side is
broadcast or gathered.

Cases: vectors that are null, zero, of another dimension than most, or hold null or non-finite components
take no part; ties go to the smaller id; rows repeating an id are each
candidates unless it is the query's own; queries with fewer candidates return them all; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.storage import materialise

LEAF = 64


def chi_square_cdf(x: np.ndarray | float, dims: int) -> np.ndarray:
    """For even degrees of freedom."""
    h = np.asarray(x, float) / 2
    term, total = np.ones_like(h), np.ones_like(h)
    for i in range(1, dims // 2):
        term = term * h / i
        total = total + term
    return 1 - np.exp(-h) * total


def projection(width: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, width, dims]).standard_normal((width, dims))


class Tree:
    """kd-tree leaves over projected points, kept as an order of the rows, leaf bounds and boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        order, bounds = np.arange(len(points)), [0]
        stack = [(0, len(points))]
        while stack:
            a, b = stack.pop()
            if b - a <= leaf:
                bounds.append(b)
                continue
            part = points[order[a:b]]
            axis = int(np.ptp(part, axis=0).argmax())
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, axis], mid)]
            stack += [(a + mid, b), (a, a + mid)]
        self.order, self.bounds = order, np.array(sorted(bounds))
        starts = self.bounds[:-1]
        self.low = np.minimum.reduceat(points[order], starts, axis=0)
        self.high = np.maximum.reduceat(points[order], starts, axis=0)

    def leaf_distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of every query (row) to every leaf's box (column)."""
        out = np.zeros((len(q), len(self.low)))
        for axis in range(q.shape[1]):
            x = q[:, axis : axis + 1]
            gap = np.maximum(0, np.maximum(self.low[:, axis] - x, x - self.high[:, axis]))
            out += gap * gap
        return out


def search(tree: Tree, ids: np.ndarray, unit: np.ndarray, points: np.ndarray, query_ids: np.ndarray, q: np.ndarray, projected: np.ndarray, k: int, confidence: float, dims: int) -> tuple[list[np.ndarray], int]:
    """Per query the rows of a block's best k (and some more), and how many rows were verified. Rows are in tree order.

    Projected neighbours come in shells: a shell's radius is a quantile of the query's leaf distances, only leaves that the
    ball touches are opened, and only rows whose projection lies in the shell are verified.
    """
    near = tree.leaf_distances(projected)
    ranked = np.sort(near, axis=1)
    norm_q, norm_p = (projected**2).sum(1), (points**2).sum(1)
    found = [(np.zeros(0), np.zeros(0, np.int64)) for _ in query_ids]
    inner = np.full(len(query_ids), -1.0)
    active, verified = np.arange(len(query_ids)), 0
    for share in (1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 1, None):
        outer = np.full(len(active), np.inf) if share is None else ranked[active, min(near.shape[1] - 1, int(near.shape[1] * share))]
        outer = np.maximum(outer * (1 + 1e-9) + 1e-9, inner[active])  # rounding may move a point off its own leaf's box
        fresh: list[list[np.ndarray]] = [[] for _ in active]
        for leaf in range(near.shape[1]):
            at = np.flatnonzero(near[active, leaf] <= outer)
            if not len(at):
                continue
            rows = np.arange(tree.bounds[leaf], tree.bounds[leaf + 1])
            gap = np.maximum(0, norm_q[active[at]][:, None] + norm_p[rows][None, :] - 2 * projected[active[at]] @ points[rows].T)
            inside = (gap > inner[active[at]][:, None]) & (gap <= outer[at][:, None]) & (ids[rows][None, :] != query_ids[active[at]][:, None])
            d = np.round(2 - 2 * q[active[at]] @ unit[rows].T, 11)  # equal vectors must tie, whatever the order of the sums
            verified += int(inside.sum())
            for i in np.flatnonzero(inside.any(1)):
                fresh[at[i]].append(np.stack([d[i, inside[i]], rows[inside[i]].astype(float)]))
        going = []
        for j, a in enumerate(active):
            best_d, best_i = found[a]
            if fresh[j]:
                new = np.concatenate(fresh[j], axis=1)
                best_d, best_i = np.concatenate([best_d, new[0]]), np.concatenate([best_i, new[1].astype(np.int64)])
                best_i, once = np.unique(best_i, return_index=True)  # a row on a shell's edge may come twice
                best_d = best_d[once]
                if len(best_d) > 4 * k + 64:
                    few = best_d <= np.partition(best_d, k + 8)[k + 8]
                    best_d, best_i = best_d[few], best_i[few]
                keep = np.lexsort((ids[best_i], best_d))[: k + 8]
                found[a] = best_d, best_i = best_d[keep], best_i[keep]
            inner[a] = outer[j]
            if share is not None and (len(best_d) < k or chi_square_cdf(outer[j] / max(best_d[k - 1], 1e-12), dims) < confidence):
                going.append(a)
        active = np.array(going, np.int64)
        if not len(active):
            break
    return [i for _, i in found], verified


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    x = F.col(vector).cast("array<double>")
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), x.alias("x")).filter(fine)


def nearest(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, dims: int = 8, confidence: float = 0.97, block: int | None = None, queries: int = 2048, seed: int = 11) -> DataFrame:
    """(query_id, rank, <key>, score) of each query's k nearest by cosine. is_query: condition on ``id``.

    block: rows of one index block; None: a sixteenth of the rows, between 8192 and 131072.
    """
    spark = vectors.sparkSession
    rows = materialise(usable(vectors, key, vector), "vectors")
    width = rows.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()  # the dimension
    schema = f"query_id long, rank int, `{key}` long, score double"
    if not width:
        return spark.createDataFrame([], schema)
    w = width[0]["w"]
    rows = rows.filter(F.size("x") == w)
    n = rows.count()
    block = block or min(131_072, max(8192, n // 16))
    n_blocks = -(-n // block)
    n_query_blocks = max(1, -(-rows.filter(is_query).count() // queries))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of a task by block, as one packed row each."""
        for f in frames:
            for b, g in f.groupby("b", sort=False):
                yield pd.DataFrame({"b": [b], "n": [len(g)], "ids": [g["id"].to_numpy("<i8").tobytes()], "xs": [np.stack(g["x"].to_list()).astype("<f8").tobytes()]})

    packed = "b int, n int, ids binary, xs binary"
    index = rows.select("id", "x", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int").alias("b")).mapInPandas(pack, packed)
    asked = rows.filter(is_query).select("id", "x", F.pmod(F.xxhash64("id"), F.lit(n_query_blocks)).cast("int").alias("b")).mapInPandas(pack, packed)
    # every query block meets every index block
    index = index.select(F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))).alias("qb"), F.col("b").alias("ib"), "n", "ids", "xs")
    asked = asked.select(F.col("b").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("ib"), "n", "ids", "xs")

    def unpack(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        ids = np.concatenate([np.frombuffer(x, "<i8") for x in f["ids"]])
        xs = np.concatenate([np.frombuffer(x, "<f8").reshape(-1, w) for x in f["xs"]])
        order = np.argsort(ids, kind="stable")
        return ids[order], xs[order]

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "id": [], "score": []}
        if len(left) and len(right):
            ids, xs = unpack(right)
            scale = np.abs(xs).max(1, keepdims=True)  # keeps very large and small vectors finite
            unit = xs / scale
            unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
            matrix = projection(w, dims, seed)
            points = unit @ matrix
            tree = Tree(points)
            ids, xs, unit, points = ids[tree.order], xs[tree.order], unit[tree.order], points[tree.order]
            q_ids, qs = unpack(left)
            us = qs / np.abs(qs).max(1, keepdims=True)
            us /= np.sqrt((us * us).sum(1, keepdims=True))
            found, _ = search(tree, ids, unit, points, q_ids, us, us @ matrix, k, confidence, dims)
            for qid, q, u, at in zip(q_ids, qs, us, found):
                with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                    score = (xs[at] * q).sum(1) / (np.sqrt((xs[at] * xs[at]).sum(1)) * np.sqrt((q * q).sum()))
                score = np.where(np.isfinite(score), score, (unit[at] * u).sum(1))
                top = np.lexsort((ids[at], -score))[:k]
                out["query_id"] += [qid] * len(top)
                out["id"] += ids[at][top].tolist()
                out["score"] += score[top].tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "id": "int64", "score": "float64"})

    parts = asked.groupBy("qb", "ib").cogroup(index.groupBy("qb", "ib")).applyInPandas(cell, "query_id long, id long, score double")

    # each block sends at most k rows a query, so a query's rows are few: sort an array, not a window over a hot key
    best = parts.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("id").alias("id")))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.id").alias(key), (-F.col("b.s")).alias("score"))
