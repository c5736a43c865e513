"""Importance resampling towards a target text, by external sort-count.

Every text becomes a stream of bucket numbers, one uint16 a feature (runs of one and two consecutive words). Streams of neighbouring
documents are packed into rows of some 2^18 features with the offset at which each document ends, and written once. For the counts
each stream is sorted and run-length encoded; the runs of a task are added up before they are shuffled. The gain of a
bucket compares its rate in the target with its rate in the raw text; a second pass over the streams gathers gains and sums
them per document with ``np.add.reduceat``, so texts are tokenised once.

A document's weight is the floored mean of its gains. With Gumbel noise drawn from a hash of its key, the highest scores of a share
of the documents with at least ``least`` words are drawn; their ranks come from ranges of the order.

Cases: null and empty texts, and texts without words, have weight 0 and are never drawn (``least`` of 0 draws them too); a very long text is one row of the
streams, two bytes a feature; scores that tie go by smaller key, null keys last; a null key is hashed as an empty one; repeated rows each count and each
have a rank; an empty target gives gains from the raw text alone; an empty table gives an empty result; extra columns are ignored. Keys are integers or strings.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from claimlens.llm.rows import body_of
from claimlens.operators.ranking import ranked
from claimlens.storage import materialise

BUCKETS = 10_000
_PACK = 1 << 18
_REMEMBER = 200_000
#: Bytes that end a word become spaces, A-Z become lower case; bytes from 0x80 on belong to words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Buckets:
    """Bucket numbers of a text's words, then of its pairs of neighbours."""

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def __call__(self, text: bytes) -> tuple[int, np.ndarray]:
        known, crc, n, before = self.known, zlib.crc32, self.buckets, None
        words = text.translate(_FOLD).split()
        one, two = [], []
        for w in words:
            seen = known.get(w)
            if seen is None:
                if len(known) >= _REMEMBER:
                    known.clear()
                c = crc(w)
                seen = known[w] = (c % n, crc(b" ", c))
            one.append(seen[0])
            if before is not None:
                two.append(crc(w, before) % n)
            before = seen[1]
        return len(words), np.array(one + two, np.uint16)


def streams(docs: DataFrame, key: str, text: str, buckets: int = BUCKETS) -> DataFrame:
    """(keys, words, ends, stream): documents in the order read, where each ends in the stream, its buckets as packed uint16."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket is stored in 16 bits")
    of_key = to_arrow_type(docs.schema[key].dataType)
    kind = docs.schema[key].dataType.simpleString()
    names = ["keys", "words", "ends", "stream"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, keys, words, ends, parts, at = Buckets(buckets), [], [], [], [], 0

        def packed():
            stream = np.concatenate(parts).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([keys], pa.list_(of_key)), pa.array([words], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([stream], pa.binary())], names)

        for b in batches:
            for k, t in zip(b.column(0), b.column(1)):
                n, x = split(t.as_py())
                at += len(x)
                for held, v in ((keys, k.as_py()), (words, n), (ends, at), (parts, x)):
                    held.append(v)
                if at >= _PACK or len(keys) >= _PACK:
                    yield packed()
                    keys, words, ends, parts, at = [], [], [], [], 0
        if keys:
            yield packed()

    rows = docs.select(F.col(key), body_of(text).cast("binary").alias("__cl_text"))
    return rows.mapInArrow(run, f"keys array<{kind}>, words array<long>, ends array<long>, stream binary")


def runs_of(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted and run-length encoded: the buckets that occur and how often."""
    s = np.sort(stream)
    at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    return s[at], np.diff(np.r_[at, len(s)])


def sort_count(packed: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of every bucket in all streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for s in b.column(0):
                values, n = runs_of(np.frombuffer(s.as_buffer(), np.uint16))
                total[values] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    counts = packed.select("stream").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counts.collect():  # at most one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains_of(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of target rate over raw rate, add-one smoothed, floored."""
    m = len(raw)
    s_all, t_all = float(raw.sum()) + m, float(target.sum()) + m
    return np.array([math.floor(1000 * math.log(float(t + 1) * s_all / (float(s + 1) * t_all))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def noise(key, seed: int) -> int:
    """Gumbel noise in thousandths from the key's hash."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(packed: DataFrame, gains: np.ndarray, key: str, seed: int) -> DataFrame:
    """(key, words, n_features, weight, score) of every document."""
    kind = packed.schema["keys"].dataType.elementType.simpleString()
    of_key = to_arrow_type(packed.schema["keys"].dataType.elementType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, words, ends, stream in zip(*b.columns):
                keys, ends = keys.as_py(), np.array(ends.as_py(), np.int64)
                starts = np.r_[0, ends[:-1]]
                sizes, weight = ends - starts, np.zeros(len(ends), np.int64)
                some = sizes > 0  # reduceat has no empty slices
                if some.any():
                    weight[some] = np.add.reduceat(gains[np.frombuffer(stream.as_buffer(), np.uint16)], starts[some]) // sizes[some]
                score = weight + np.array([noise(k, seed) for k in keys], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys, of_key), words.values, pa.array(sizes), pa.array(weight), pa.array(score)], [key, "words", "n_features", "weight", "score"])

    return packed.mapInArrow(run, f"`{key}` {kind}, words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 25, least: int = 20, buckets: int = BUCKETS, seed: int = 7) -> DataFrame:
    """(key, n_features, weight, score, rank) of every document; rank is null for those not drawn.

    percent: share of the documents with at least ``least`` words to draw, rounded down.
    """
    raw = materialise(streams(docs, key, text, buckets), "streams")
    wanted = target.select(F.lit(0).alias("__cl_key"), F.col(target_text).alias("__cl_of"))
    gains = gains_of(sort_count(raw, buckets), sort_count(streams(wanted, "__cl_key", "__cl_of", buckets), buckets))
    scored = materialise(weigh(raw, gains, key, seed), "scores")
    worded = scored.filter(F.col("words") >= least)
    drawn = worded.count() * percent // 100
    placed = ranked(worded, [F.col("score").desc(), F.col(key).asc_nulls_last()])
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(F.col("words") < least).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).select(key, "n_features", "weight", "score", "rank")
