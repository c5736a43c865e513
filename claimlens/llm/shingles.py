"""Near-duplicates by Jaccard similarity of word shingles: SimHash fingerprints by anchor-point covering find the close ones, MinHash bands
those that fingerprints leave apart, and the shingle sets confirm all.

A text is the set of its distinct word shingles (``simhash.shingles``); texts of equal sets (by a digest of 128 bits) are one point.
Fingerprints of the same shingles are linked at BITS or fewer differing bits (``simhash.links``). Few pairs near the threshold are that close
(at a similarity of 0.8 some 10 bits of 64 differ), and a covering of so wide a radius would copy a fingerprint to thousands of anchors, so
BANDS x ROWS minima make BANDS cells a point besides; two points of similarity 0.8 share none with probability
(1 - 0.8^6)^40 = 5e-6, less above. No fingerprint distance or estimate decides: every candidate is compared by its sets.

Classes are connected components over confirmed pairs. First come the pairs that fingerprints link; points in one class by these are not
compared again. Then each point is compared with the least and the greatest point of
its cells. Where a cell still holds several components, its points are compared with those of other components that share
one of their rarest shingles at a place that allows the similarity (``rare_pairs``). So texts around one passage are not
compared for it, a group of near copies mostly costs its size, and no pair of a cell in different components that could reach
the threshold stays uncompared.

Cases: null text counts as empty; texts without words are one point; fewer words than a shingle are one shingle; repeated
rows share a class; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm import simhash
from claimlens.llm.components import connected_components
from claimlens.llm.rows import body_of, text_key
from claimlens.llm.simhash import SEED, shingles
from claimlens.storage import materialise

#: Bits in which linked fingerprints may differ.
BITS = 3
BANDS, ROWS = 40, 6
_DRAW = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64)
_FLIP, _TIMES = _DRAW[0] << np.uint64(1) ^ _DRAW[1], _DRAW[1] | np.uint64(1)
_BLOCK = 512
#: Shingles of a row batch.
_PIECE = 10000
#: Points of a bucket: a block of the comparison holds the texts of two buckets at most.
BUCKET = 128
#: Words of 64 bits in a mark.
MARK = 16


def shingle_set(text: bytes, words: int) -> np.ndarray:
    return np.unique(np.array(shingles(text, words), np.uint64))


def bands(s: np.ndarray) -> list[int]:
    """Cells of a shingle set; empty for the empty set, which has no near point but itself."""
    if not len(s):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), _BLOCK):
        np.minimum(low, ((s[None, i : i + _BLOCK] ^ _FLIP) * _TIMES).min(1), out=low)
    raw = low.tobytes()
    width = 8 * ROWS
    return [xxhash.xxh64_intdigest(raw[b * width : (b + 1) * width], b) for b in range(BANDS)]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def mark(s: np.ndarray) -> np.ndarray:
    """One bit for each of 64 * MARK classes of shingles: whether the set holds an odd number of them. Marks differ in no more bits than their sets in shingles."""
    held = np.bincount((s >> np.uint64(32)) % np.uint64(64 * MARK), minlength=64 * MARK)
    return np.packbits((held & 1).astype(np.uint8)).view(np.int64)


def points_of(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(key, text_key, point, size, cells) of every row; size is the number of distinct shingles."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            point, size, cells = [], [], []
            for t in b.column(2):
                own = shingle_set(t.as_py(), words)
                point.append(xxhash.xxh128_digest(own.tobytes(), SEED))
                size.append(len(own))
                cells.append(np.array(bands(own), np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(point, pa.binary()), pa.array(size, pa.int64()), pa.array(cells, pa.list_(pa.int64()))], [key, "text_key", "point", "size", "cells"])

    rows = docs.select(F.col(key), text_key(key, text).alias("text_key"), body_of(text).cast("binary").alias("__cl_text"))
    return rows.mapInArrow(run, f"`{key}` {kind}, text_key binary, point binary, size long, cells array<long>")


def fingerprint_pairs(docs: DataFrame, prints: DataFrame, key: str, text: str, words: int, least: float) -> DataFrame:
    """Pairs (a, b) of points, as structs (point, size, text_key): each fingerprint's points with its least one, and the least ones of linked fingerprints."""
    marks = simhash.fingerprints(docs.select(text_key(key, text).alias("text_key"), F.col(text)), "text_key", text, words).distinct()
    rows = prints.filter("size > 0").select("point", "size", "text_key").distinct()
    points = materialise(marks.join(rows, "text_key").select("fp", F.struct("point", "size", "text_key").alias("b")), "fingerprints")
    first = materialise(points.groupBy("fp").agg(F.min("b").alias("a")), "first-points")
    links = simhash.links(first, BITS).distinct().withColumnsRenamed({"a": "fp", "b": "other"})
    across = links.join(first, "fp").select("a", F.col("other").alias("fp")).join(first.withColumnRenamed("a", "b"), "fp")
    pairs = points.join(first, "fp").select("a", "b").union(across.select("a", "b")).filter("a.point != b.point")
    return pairs.filter(F.least("a.size", "b.size") / F.greatest("a.size", "b.size") >= least)


def shrunk(texts: DataFrame) -> DataFrame:
    """(point, body) with the body compressed: bodies are sent out once for every pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([zstandard.compress(x.as_py(), 3) for x in b.column(1)], pa.binary())], ["point", "body"])

    return texts.select("point", "body").mapInArrow(run, "point binary, body binary")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The distinct pairs (a, b) whose shingle sets have the similarity ``least`` or more. texts: of ``shrunk``.

    Points are dealt to buckets of about BUCKET, and the pairs of two buckets are compared in one block: a text is sent to a block once
    and its set made once, however many pairs it has there.
    """
    buckets = max(1, -(-texts.count() // BUCKET))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets))
    placed = pairs.select((F.least(at("a"), at("b")) * buckets + F.greatest(at("a"), at("b"))).alias("block"), "a", "b")
    bodies = placed.select("block", F.col("a").alias("point")).union(placed.select("block", "b")).distinct().join(texts, "point")
    none = F.lit(None).cast("binary")
    rows = bodies.select("block", F.lit(0).alias("kind"), F.col("point").alias("a"), none.alias("b"), "body").union(placed.select("block", F.lit(1), "a", "b", none))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bodies, sets = None, {}, {}

        def own(point: bytes) -> np.ndarray:
            if point not in sets:
                sets[point] = shingle_set(zstandard.decompress(bodies.pop(point)), words)
            return sets[point]

        for batch in batches:
            out = []
            for block, kind, a, b, body in zip(*(c.to_pylist() for c in batch.columns)):
                if block != now:
                    now, bodies, sets = block, {}, {}
                if kind == 0:
                    bodies[a] = body
                elif similarity(own(a), own(b)) >= least:
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], ["a", "b"])

    return rows.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(run, "a binary, b binary")


def rare_pairs(points: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) of points of different roots that may have the similarity ``least``; none that has it is left out.

    Shingles are ranked by how few of these points hold them. The first common shingle of two sets of n and m shingles, at places
    i and j from 0, leaves at most min(n - i, m - j) in common, and the similarity asks for least / (1 + least) of n + m. So it stands
    among the rarest (1 - least) n of its set, and passages that many texts share, ranked last, bring no pair together. The similarity
    also allows at most (1 - least) / (1 + least) of n + m in which the sets differ, and marks tell where they differ in more: so copies of
    one text that were changed apart share a rare shingle now and then, but make no pair for it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, body in enumerate(b.column(3)):
                own = shingle_set(zstandard.decompress(body.as_py()), words)
                marks, own = pa.array([mark(own)], kind), own.view(np.int64)
                # the mark comes in a row of its own
                for piece, m in [(pa.nulls(1, pa.int64()), marks)] + [(pa.array(own[at : at + _PIECE]), None) for at in range(0, len(own), _PIECE)]:
                    m = pa.nulls(len(piece), kind) if m is None else m
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(c)[i].as_py()] * len(piece), b.column(c).type) for c in range(3)] + [piece, m], ["point", "size", "root", "shingle", "mark"])

    kind = pa.list_(pa.int64())
    every = points.join(texts, "point").select("point", "size", "root", "body").mapInArrow(run, "point binary, size long, root binary, shingle long, mark array<long>")
    every = materialise(every, "held")
    held = every.filter("shingle is not null").drop("mark")
    shared = held.groupBy("shingle").agg(F.count("*").alias("n"))
    ranked = held.join(shared, "shingle").withColumn("place", F.row_number().over(Window.partitionBy("point").orderBy("n", "shingle")) - 1)
    # a margin for rounding keeps every pair at the threshold
    first = materialise(ranked.filter(F.col("size") - F.col("place") >= least * F.col("size") - 1e-6).filter("n > 1").drop("n").join(every.filter("shingle is null").select("point", "mark"), "point"), "rarest")
    x, y = first.alias("x"), first.alias("y")
    left = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
    enough = left >= least / (1 + least) * (F.col("x.size") + F.col("y.size")) - 1e-6
    differ = sum((F.bit_count(F.col("x.mark")[i].bitwiseXOR(F.col("y.mark")[i])) for i in range(MARK)), F.lit(0))
    enough = enough & (differ <= (1 - least) / (1 + least) * (F.col("x.size") + F.col("y.size")) + 1e-6)
    met = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.point") < F.col("y.point")) & (F.col("x.root") != F.col("y.root")) & enough
    return x.join(y, met).select(F.col("x.point").alias("a"), F.col("y.point").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """(key, text_key, root) of every row: root names its class of points linked by a similarity of ``least`` or more."""
    prints = materialise(points_of(docs, key, text, words), "shingles")
    close = materialise(fingerprint_pairs(docs, prints, key, text, words, least), "close")
    members = prints.groupBy("point").agg(F.min("text_key").alias("text_key"), F.first("size").alias("size"), F.first("cells").alias("cells"))
    members = members.select("point", "text_key", "size", F.explode("cells").alias("cell"))
    ends = members.groupBy("cell").agg(F.min(F.struct("point", "size")).alias("low"), F.max(F.struct("point", "size")).alias("high")).filter("low.point < high.point")
    members = materialise(members.join(ends, "cell"), "cells")
    # one text stands for a point
    wanted = members.select("point", "text_key").union(close.select("a.point", "a.text_key")).union(close.select("b.point", "b.text_key")).distinct()
    texts = docs.select(text_key(key, text).alias("text_key"), body_of(text).cast("binary").alias("body"))
    texts = materialise(texts.join(wanted, "text_key").dropDuplicates(["point"]).transform(shrunk), "texts")
    close = close.select(F.least("a.point", "b.point").alias("a"), F.greatest("a.point", "b.point").alias("b")).distinct()
    linked = materialise(confirmed(close, texts, words, least), "near")
    classes = materialise(connected_components(linked), "classes")
    # sets of too different sizes cannot be that similar, so their texts need not be compared
    met = lambda end: members.filter(F.least("size", f"{end}.size") / F.greatest("size", f"{end}.size") >= least).select(F.least("point", f"{end}.point").alias("a"), F.greatest("point", f"{end}.point").alias("b"))
    root = lambda end: classes.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    pairs = met("low").union(met("high")).filter("a < b").distinct().join(root("a"), "a", "left").join(root("b"), "b", "left")
    pairs = pairs.filter("a_root is null or b_root is null or a_root != b_root").select("a", "b").join(close, ["a", "b"], "left_anti")
    pairs = materialise(pairs, "pairs")
    edges = materialise(confirmed(pairs, texts, words, least).union(linked), "near")
    roots = materialise(connected_components(edges), "roots")
    # what the ends of the cells leave apart
    placed = members.join(roots.withColumnRenamed("node", "point"), "point", "left").select("cell", "point", "size", F.coalesce("root", "point").alias("root"))
    parts = placed.groupBy("cell", "root").agg(F.count("*").alias("n"))
    main = parts.groupBy("cell").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    apart = materialise(placed.join(main, "cell").select("point", "size", "root").distinct(), "apart")
    # written once, as the comparison reads its pairs three times
    more = materialise(rare_pairs(apart, texts, words, least).join(pairs.union(close), ["a", "b"], "left_anti"), "more-pairs")
    more = materialise(confirmed(more, texts, words, least), "near")
    roots = connected_components(edges.union(more)).select(F.col("node").alias("point"), "root")
    return prints.select(key, "text_key", "point").join(roots, "point", "left").select(key, "text_key", F.coalesce("root", "point").alias("root"))
