"""Citations held against the stored sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.functions.text import flatten_quote
from claimlens.operators.joins import provenance


def checked_citations(citations: DataFrame, stored: DataFrame) -> DataFrame:
    """(statement_id, sources, rejected): the quotes a stored source holds, with what that source says of itself, in their order.

    citations: statement_id, pos, domain, quote, data_date; stored: source_id, domain, text, url, producer, rank, vintage. Address, producer and
    rank of a kept quote are the stored source's, whatever the judge wrote; its date is the judge's, else the vintage. Other quotes are dropped and
    counted. Equal quotes are looked for once. Null or blank quotes are rejected.
    """
    c = citations.withColumn("flat", F.coalesce(flatten_quote(F.col("quote")), F.lit("")))
    c = c.withColumn("item_id", F.sha2(F.concat_ws("\u0001", F.coalesce("domain", F.lit("")), "flat"), 256))
    quotes = c.groupBy("item_id").agg(F.first("domain").alias("domain"), F.first("flat").alias("flat"))
    texts = stored.select("source_id", "domain", flatten_quote(F.col("text")).alias("flat")).filter("flat is not null")
    held = provenance(quotes, texts, texts.limit(0)).filter("found").select("item_id", "source_id")
    known = stored.select("source_id", "url", F.col("producer").alias("__producer"), "rank", "vintage")
    kept = c.join(held, "item_id", "left").join(known, "source_id", "left")
    source = F.struct("pos", "quote", "url", F.col("__producer").alias("domain"), "rank", F.coalesce("data_date", "vintage").alias("data_date"), F.lit(True).alias("quote_verified"))
    out = kept.groupBy("statement_id").agg(F.array_sort(F.collect_list(F.when(F.col("source_id").isNotNull(), source))).alias("s"), F.count_if(F.col("source_id").isNull()).alias("rejected"))
    return out.select("statement_id", F.transform("s", lambda x: x.dropFields("pos")).alias("sources"), "rejected")
