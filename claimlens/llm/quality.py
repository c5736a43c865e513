"""Quality by importance resampling.

Two generative models over hashed n-grams (words and word pairs): one of the
target text, labelled good, one of all raw text. A document's log importance weight is the
sum over its n-grams of log(target / raw); a document of more than ``length`` n-grams is
weighed as ``length`` of its average ones, so that no text goes for its length alone. Documents are sampled without
replacement by Gumbel top-k: noise drawn from a hash of the key is added to the
weight and the k largest stay.

The raw model is counted over all documents. The target model is fitted on at most
``sample`` labelled documents of each class (smallest hash of the key first), which bounds what
is sent to the workers. k is the number of documents whose weight is at least a
threshold, put where the labelled classes part best.

Cases: null text counts as empty; a text without words has weight 0 and is never drawn, as nothing speaks for it; a very long text
is weighted whole, by its average n-gram; keys are integers or strings; repeated rows get equal weight and noise; rows with
a null key are never labelled; labels with a null are ignored, of contradicting
labels the lower counts; without labelled documents of both classes the threshold is
0; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimlens.llm.rows import body_of, text_key
from claimlens.storage import materialise

BUCKETS = 16_384
SAMPLE = 5_000
#: N-grams of a text beyond which only their average tells.
LENGTH = 512
_TOKENS = re.compile(r"\w+|[^\w\s]+").findall
_REMEMBER = 150_000


class Features:
    """Hash buckets of lower-cased words and pairs of neighbours."""

    def __init__(self, buckets: int):
        self.buckets, self.memory = buckets, {}

    def __call__(self, text: str) -> np.ndarray:
        memory, h, out = self.memory, xxhash.xxh32_intdigest, []
        for w in _TOKENS(text.lower()):
            v = memory.get(w)
            if v is None:
                if len(memory) >= _REMEMBER:
                    memory.clear()
                v = memory[w] = h(w.encode())
            out.append(v)
        one = np.array(out, np.uint64)
        two = (one[:-1] * np.uint64(0x9E3779B1) + one[1:] * np.uint64(0x85EBCA77) + np.uint64(1)) >> np.uint64(7)
        return np.concatenate([one, two]) % np.uint64(self.buckets) if len(one) else np.zeros(0, np.uint64)


def labelled(labels: DataFrame, key: str, label: str, sample: int) -> dict[int, int]:
    one = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias("y"))
    rows = []
    for y in (0, 1):
        rows += one.filter(F.col("y") == y).orderBy(F.xxhash64(key), key).limit(sample).collect()  # bounded by the parameter
    return {r[key]: int(r["y"]) for r in rows}


def fit(docs: DataFrame, sampled: dict[int, int], key: str, text: str, buckets: int) -> np.ndarray:
    """log(target / raw) per bucket, both with add-one smoothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets)
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            for k, t in zip(b.column(0), b.column(1)):
                n = np.bincount(features(t.as_py() or "").astype(np.int64), minlength=buckets)
                raw += n
                if sampled.get(k.as_py()) == 1:
                    target += n
        for name, n in (("raw", raw), ("target", target)):
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["model", "bucket", "n"])

    counts = docs.select(F.col(key), F.col(text).cast("string").alias("__cl_text")).mapInArrow(count, "model string, bucket long, n long")
    totals = counts.groupBy("model", "bucket").agg(F.sum("n").alias("n")).collect()  # at most two rows a bucket
    models = {m: np.ones(buckets) for m in ("raw", "target")}
    for r in totals:
        models[r["model"]][r["bucket"]] += r["n"]
    return np.log(models["target"] / models["target"].sum()) - np.log(models["raw"] / models["raw"].sum())


def weights(docs: DataFrame, ratio: np.ndarray, key: str, text: str, seed: int, length: int = LENGTH) -> DataFrame:
    """(key, text_key, n_features, log_weight, gumbel_weight); text_key as of ``rows``."""
    kind = docs.schema[key].dataType.simpleString()
    buckets = len(ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets)
        for b in batches:
            sizes, w = [], []
            for t in b.column(2):
                x = features(t.as_py()).astype(np.int64)
                sizes.append(len(x))
                w.append(float(ratio[x].sum()) * min(1.0, length / max(len(x), 1)))
            w = np.array(w, float)
            u = (np.array([xxhash.xxh64_intdigest(str(k.as_py()).encode(), seed) >> 11 for k in b.column(0)], float) + 0.5) / 2**53
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(w), pa.array(w - np.log(-np.log(u)))], [key, "text_key", "n_features", "log_weight", "gumbel_weight"])

    return docs.select(F.col(key), text_key(key, text).alias("text_key"), body_of(text).alias("__cl_text")).mapInArrow(score, f"`{key}` {kind}, text_key binary, n_features long, log_weight double, gumbel_weight double")


def threshold(scored: DataFrame, sampled: dict[int, int], key: str) -> float:
    """Where the fewest labelled documents stand on the wrong side; of equal places the lowest. Of rows sharing a labelled key the lowest counts."""
    if not sampled:
        return 0.0
    ids = scored.sparkSession.createDataFrame([(k,) for k in sampled], StructType([scored.schema[key]]))  # at most twice the sample
    rows = scored.join(F.broadcast(ids), key, "left_semi").groupBy(key).agg(F.min("log_weight").alias("log_weight")).collect()
    s = sorted(((r[key], r["log_weight"]) for r in rows), key=lambda r: r[1])
    y = np.array([sampled[k] for k, _ in s])
    if not len(y) or y.min() == y.max():
        return 0.0
    wrong = np.r_[0, np.cumsum(y == 1)] + np.r_[np.cumsum((y == 0)[::-1])[::-1], 0]
    i = int(wrong.argmin())
    w = [x for _, x in s]
    return float((w[i - 1] + w[i]) / 2) if 0 < i < len(w) else float(w[0] if i == 0 else np.nextafter(w[-1], np.inf))


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest double, by grouped counts over ever narrower ranges of at most 4096 cells."""
    d = df.select(F.col(column).alias("x"))
    lo, hi = (float(v) for v in d.agg(F.min("x"), F.max("x")).first())
    left = k
    while lo < hi:
        width = (hi - lo) / 4096
        if width == 0 or lo + width == lo:
            counts = {r["x"]: r["count"] for r in d.filter(F.col("x").between(lo, hi)).groupBy("x").count().collect()}  # neighbouring doubles: a few thousand values
            for v in sorted(counts, reverse=True):
                if left <= counts[v]:
                    return v
                left -= counts[v]
        cell = F.least(F.lit(4095), F.floor((F.col("x") - lo) / width)).cast("int")
        rows = sorted(((r["c"], r["n"], r["a"], r["b"]) for r in d.filter(F.col("x").between(lo, hi)).groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).collect()), reverse=True)
        for _, n, a, b in rows:
            if left <= n:
                lo, hi = a, b
                break
            left -= n
    return lo


def resample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", share: float | None = None, buckets: int = BUCKETS, sample: int = SAMPLE, seed: int = 7, length: int = LENGTH) -> DataFrame:
    """(key, text_key, n_features, log_weight, gumbel_weight, kept). share: part of the documents to draw; None: from the labels.

    Rows whose perturbed weight ties with the k-th stay.
    """
    sampled = labelled(labels, key, label, sample)
    scored = materialise(weights(docs, fit(docs, sampled, key, text, buckets), key, text, seed, length), "weights")
    worded = scored.filter("n_features > 0")
    if share is None:
        k = worded.filter(F.col("log_weight") >= F.lit(threshold(scored, sampled, key))).count()
    else:
        k = min(int(round(share * scored.count())), worded.count())
    if k == 0:
        return scored.withColumn("kept", F.lit(False))
    return scored.withColumn("kept", (F.col("n_features") > 0) & (F.col("gumbel_weight") >= F.lit(kth_largest(worded, "gumbel_weight", k))))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that are drawn, with all their columns."""
    kept = resample(docs, labels, key, text, **options).filter("kept").select(F.col("text_key").alias("__cl_key"))
    rows = docs.withColumn("__cl_key", text_key(key, text))
    return rows.join(kept, "__cl_key", "left_semi").select(docs.columns)
