"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code. A fingerprint is copied to every
anchor within covering radius plus threshold; two fingerprints within the
threshold then meet at the anchor nearest to either of them, and fingerprints are
compared per anchor only.

The code: the 64 bits are two halves of 32, and two fingerprints that differ in
t bits differ in at most t // 2 in one half. Each half has its own anchors,
the words of the perfect Hamming code on 31 of its bits (2^26 anchors, covering
radius 1). For t = 3 a fingerprint has about 15.5 anchors a half within 1 + 1,
and a bucket holds 2.3e-7 of all fingerprints, where one perfect Golay
code over the whole word would give 71 anchors and buckets of 1.7e-2.

Equal fingerprints are one point before anything is compared. An anchor with
more points than CELL is cut into chunks and every pair of chunks is compared in a
cell of its own, so no task holds more than two chunks of an anchor. A cell sends on a spanning
forest, never all its pairs.

Cases: null text counts as empty; texts without words have fingerprint zero and
are linked like others; a very long text is read in blocks of shingle hashes; repeated rows share a class; a class whose
keys are all null has a null id; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.components import connected_components
from claimlens.llm.rows import body_of
from claimlens.storage import materialise

SEED = 42
#: Points of an anchor in one chunk.
CELL = 4096
_BLOCK = 1 << 16


def shingles(text: bytes, words: int) -> list[int]:
    """XXH64 with seed 42 of the lower-cased (A-Z) word shingles, repeats included; fewer words are one shingle, none gives none."""
    w = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII separators
    if not w:
        return []
    line = b" ".join(w)
    h = xxhash.xxh64_intdigest
    if len(w) < words:
        return [h(line, SEED)]
    ends = list(accumulate(map(len, w), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    return [h(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])]


def fingerprint(text: bytes, words: int = 3) -> int:
    """64-bit SimHash of the shingles; zero where there are none."""
    hashes = shingles(text, words)
    if not hashes:
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _BLOCK):
        a = np.array(hashes[i : i + _BLOCK], np.uint64)
        ones += np.unpackbits(a.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(key, fp): one row per document."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], [key, "fp"])

    return docs.select(F.col(key), body_of(text).cast("binary").alias("__cl_text")).mapInArrow(run, f"`{key}` {kind}, fp long")


def _masks(reach: int) -> list[np.ndarray]:
    """For each syndrome the flips of at most ``reach`` of 31 bits that lead from a word with it to a code word."""
    out: list[list[int]] = [[] for _ in range(32)]
    for n in range(reach + 1):
        for at in combinations(range(1, 32), n):
            s = m = 0
            for i in at:
                s ^= i
                m |= 1 << (i - 1)
            out[s].append(m)
    return [np.array(m, np.int64) for m in out]


def anchors_of(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into fp, anchor) of all anchors within radius 1 plus threshold // 2 of each half."""
    masks = _masks(1 + threshold // 2)
    checks = [sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1) for k in range(5)]
    index, anchor = [], []
    for half in (0, 1):
        word = (fp.view(np.uint64) >> np.uint64(32 * half)).astype(np.int64) & 0x7FFFFFFF
        s = sum(((np.bitwise_count(word & c) & 1).astype(np.int64) << k for k, c in enumerate(checks)), np.zeros(len(word), np.int64))
        for v in range(32):
            at = np.flatnonzero(s == v)
            if len(at) and len(masks[v]):
                index.append(np.repeat(at, len(masks[v])))
                anchor.append(((word[at][:, None] ^ masks[v][None, :]) | half << 31).ravel())
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *index]), np.concatenate([empty, *anchor])


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))  # of a signed number it would count the absolute value's


def _forest(g: np.ndarray, threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Star edges of the components among the points of one cell; each point is compared once with those not yet reached."""
    out, rest = [], g
    while len(rest) > 1:
        seed, rest, front = rest[0], rest[1:], rest[:1]
        while len(front) and len(rest):
            near = (_bits(front[:256, None] ^ rest[None, :]) <= threshold).any(0)
            front = np.concatenate([front[256:], rest[near]])
            if near.any():
                out.append((np.full(int(near.sum()), seed), rest[near]))
            rest = rest[~near]
    return out


def match_sorted(cell: np.ndarray, fp: np.ndarray, threshold: int, small: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Edges among points of equal cell; rows are sorted by cell."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(cell)])
    for i, n in zip(starts[sizes > small], sizes[sizes > small]):
        for x, y in _forest(np.unique(fp[i : i + n]), threshold):
            a.append(x)
            b.append(y)
    use = np.repeat(sizes <= small, sizes)
    for k in range(1, min(small, int(sizes.max(initial=1)))):
        at = np.flatnonzero((cell[k:] == cell[:-k]) & use[k:])
        if not len(at):
            break
        x, y = fp[at], fp[at + k]
        near = (_bits(x ^ y) <= threshold) & (x != y)
        a.append(x[near])
        b.append(y[near])
    return np.concatenate(a), np.concatenate(b)


def links(points: DataFrame, threshold: int = 3) -> DataFrame:
    """(a, b): edges that connect exactly the components of distinct fingerprints within the threshold. points: (fp)."""
    spark = points.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fp = f["fp"].to_numpy(np.int64)
            for i in range(0, len(fp), 20_000):
                at, anchor = anchors_of(fp[i : i + 20_000], threshold)
                yield pd.DataFrame({"anchor": anchor, "fp": fp[i : i + 20_000][at]})

    copies = points.select("fp").mapInPandas(spread, "anchor long, fp long")
    hot = materialise(copies.groupBy("anchor").count().filter(F.col("count") > CELL), "hot-anchors")
    n_hot = hot.count()
    if n_hot:
        # at most one in CELL of the copies is a hot anchor; beyond the bound the join shuffles instead
        hot = F.broadcast(hot) if n_hot <= 100_000 else hot
        n = F.ceil(F.col("count") / CELL).cast("int")
        copies = copies.join(hot, "anchor", "left").withColumn("n", F.coalesce(n, F.lit(1)))
        copies = copies.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        copies = copies.select(F.xxhash64("anchor", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "fp")
    else:
        copies = copies.select(F.xxhash64("anchor").alias("cell"), "fp")

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell = fp = np.zeros(0, np.int64)
        for f in frames:
            cell, fp = np.concatenate([cell, f["cell"].to_numpy()]), np.concatenate([fp, f["fp"].to_numpy()])
            whole = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
            if whole:
                a, b = match_sorted(cell[:whole], fp[:whole], threshold)
                yield pd.DataFrame({"a": a, "b": b})
                cell, fp = cell[whole:], fp[whole:]
        a, b = match_sorted(cell, fp, threshold)
        yield pd.DataFrame({"a": a, "b": b})

    return copies.repartition(parts, "cell").sortWithinPartitions("cell").mapInPandas(match, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, threshold: int = 3) -> DataFrame:
    """(key, fingerprint, component_id) of every row; component_id is the smallest key reachable over links."""
    prints = materialise(fingerprints(docs, key, text, words), "fingerprints")
    points = materialise(prints.groupBy("fp").agg(F.min(key).alias("low")), "points")
    roots = connected_components(links(points, threshold)).select(F.col("node").alias("fp"), "root")
    points = materialise(points.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "roots")
    least = points.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = points.join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
