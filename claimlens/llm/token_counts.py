"""Token counts by an exact length histogram.

Documents are aggregated by encoded length; suffix sums over the distinct
lengths then answer, for every context limit at once, how many documents are
longer, how many tokens they hold and how many tokens survive truncation.

Cases: a very long text is encoded whole; null text counts as empty (length 0); empty texts have length 0; ties
and repeated rows each count; an empty table gives an empty histogram; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.tokenise import default_path, json_vocabulary_encoder
from claimlens.storage import materialise


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): one row per distinct encoded length of whole texts."""
    path = vocabulary or default_path("byte_bpe_50k.json")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = json_vocabulary_encoder(path)
        for b in batches:
            sizes: dict[int, int] = {}
            for t in b.column(0):
                n = len(encode(t.as_py() or ""))
                sizes[n] = sizes.get(n, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(sizes), pa.int64()), pa.array(list(sizes.values()), pa.int64())], ["n_tokens", "n_docs"])

    lengths = docs.select(F.col(text).cast("string").alias("__cl_text")).mapInArrow(count, "n_tokens long, n_docs long")
    return lengths.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Answers for every context limit L = n_tokens.

    docs_at_least / tokens_at_least: documents of L tokens or more and their
    tokens. docs_up_to: documents of at most L tokens. truncated_tokens:
    sum of min(length, L). cdf: docs_up_to / all documents. Between two
    listed lengths, truncated_tokens grows linearly by the upper row's
    docs_at_least per token, so the table answers any limit.

    Two levels: sums inside blocks of lengths, offsets over the few blocks, so
    no task holds the histogram of all lengths. A block is 1024 lengths or a 64th of its octave, if that
    is more. The histogram is
    written once, as both levels read it and each would encode all texts again.
    """
    hist = materialise(hist, "histogram")
    octave = F.floor(F.log2(F.col("n_tokens") + F.lit(1.0)))
    part = F.floor(F.col("n_tokens") / F.greatest(F.lit(1024.0), F.pow(F.lit(2.0), octave) / 64))
    h = hist.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("toks"), octave.cast("long").alias("o"), part.cast("long").alias("p"))
    blocks = h.groupBy("o", "p").agg(F.sum("n_docs").alias("bd"), F.sum("toks").alias("bt"), F.min("n_tokens").alias("lo"))
    after = Window.orderBy(F.desc("lo")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select("o", "p", F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("ad"), F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("at"), F.sum("bd").over(every).alias("total_docs"), F.sum("bt").over(every).alias("total_tokens"))
    inside = Window.partitionBy("o", "p").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    at_least_d = F.sum("n_docs").over(inside) + F.col("ad")
    at_least_t = F.sum("toks").over(inside) + F.col("at")
    return h.join(blocks, ["o", "p"]).select(
        "n_tokens",
        "n_docs",
        at_least_d.alias("docs_at_least"),
        at_least_t.alias("tokens_at_least"),
        (F.col("total_docs") - at_least_d + F.col("n_docs")).alias("docs_up_to"),
        (F.col("total_tokens") - at_least_t + F.col("n_tokens") * at_least_d).alias("truncated_tokens"),
        "total_docs",
        "total_tokens",
        ((F.col("total_docs") - at_least_d + F.col("n_docs")) / F.col("total_docs")).alias("cdf"),
    )


def quantile(answers: DataFrame, q: float) -> DataFrame:
    """Smallest listed length with at least the share q of documents at or below it."""
    return answers.filter(F.col("cdf") >= F.lit(q)).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_total(answers: DataFrame, limit: int) -> DataFrame:
    """Sum of min(length, limit) for any limit, from the two neighbouring rows."""
    below = F.max(F.when(F.col("n_tokens") <= limit, F.struct("n_tokens", "truncated_tokens", "docs_at_least", "n_docs")))
    return answers.agg(below.alias("b"), F.max("total_docs").alias("d")).select(
        (F.when(F.col("b").isNull(), F.col("d") * limit).otherwise(F.col("b.truncated_tokens") + (F.lit(limit) - F.col("b.n_tokens")) * (F.col("b.docs_at_least") - F.col("b.n_docs")))).alias("truncated_tokens")
    )
