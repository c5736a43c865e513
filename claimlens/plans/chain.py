"""Composed plans: statements from blocks, briefs, attribution and the stage-0 funnel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens.functions.text import normalise, sentences
from claimlens.functions.triggers import deserves_verification, triggers
from claimlens.operators.aggregates import consensus, majority_identity
from claimlens.operators.joins import best_overlap, identify, keyword_terms
from claimlens.storage import materialise


def split_statements(blocks: DataFrame, by: str) -> DataFrame:
    """blocks: start, stop, text, speaker. One row a sentence; its time is the block's start plus the share of characters up to its end."""
    s = blocks.select(by, "start", "stop", "speaker", F.posexplode(sentences(F.col("text"))).alias("index", "text"))
    w = Window.partitionBy(by).orderBy("index")
    run, total = F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum(F.length("text")).over(Window.partitionBy(by))
    name = F.concat_ws("-", F.lower(F.substring("speaker", 1, 3)), F.round("start").cast("long").cast("string"), F.col("index").cast("string"))
    return s.withColumn("timestamp", F.col("start") + (F.col("stop") - F.col("start")) * run / total).withColumn("statement_id", name)


def stage0(statements: DataFrame) -> DataFrame:
    s = statements.withColumn("triggers", triggers(F.col("text")))
    return s.withColumn("candidate", deserves_verification(F.col("triggers")))


def compose_brief(claims: DataFrame, forms: DataFrame, term_domains: DataFrame, sources: DataFrame, measures: DataFrame, key: str = "statement_id", most: int = 3) -> DataFrame:
    """(key, domains, source_keys, terms, trap). term_domains: term, domain; sources: domain, source_key; measures: term, measure."""
    hits = materialise(keyword_terms(claims.select(key, normalise(F.col("text")).alias("flat")), forms, key, "flat"), "hits")
    traps = measures.groupBy("term").agg((F.count("*") > 1).alias("trap"))
    t = hits.join(traps, "term", "left").groupBy(key).agg(F.array_sort(F.collect_set("term")).alias("terms"), F.coalesce(F.bool_or("trap"), F.lit(False)).alias("trap"))
    d = hits.join(term_domains, "term").join(sources.select("domain").distinct(), "domain", "left_semi").select(key, "domain").distinct()
    k = d.join(sources, "domain").groupBy(key).agg(F.array_sort(F.collect_set("domain")).alias("domains"), F.slice(F.array_sort(F.collect_set("source_key")), 1, most).alias("source_keys"))
    none = F.array().cast("array<string>")
    return claims.select(key).join(t, key, "left").join(k, key, "left").select(key, F.coalesce("domains", none).alias("domains"), F.coalesce("source_keys", none).alias("source_keys"), F.coalesce("terms", none).alias("terms"), F.coalesce("trap", F.lit(False)).alias("trap"))


def attribute(windows: DataFrame, prints: DataFrame, overlapped: DataFrame, captions: DataFrame, turns: DataFrame, threshold: float, margin: float) -> DataFrame:
    """Identify windows, decide per turn, then give captions the decided speaker of their turn."""
    hits = identify(windows, prints, "window_id", "embedding", threshold, margin)
    per = windows.select("window_id", "turn_seq", "seq").join(hits, "window_id")
    who = consensus(majority_identity(per, "turn_seq"), overlapped, prints, "turn_seq")
    return best_overlap(captions, turns, "caption_id").join(who, "turn_seq", "left")


def staleness(claims: DataFrame, series: DataFrame) -> DataFrame:
    """claims: claim_id, measure, at; series: measure, vintage, value. The value of then and the current one.

    Claims and vintages of a measure are sorted together once and each claim takes the last vintage before it, so none meets all vintages.
    """
    none = lambda c, df: F.lit(None).cast(df.schema[c].dataType).alias(c)
    asks = claims.select("measure", "claim_id", F.col("at").alias("t"), none("value", series), none("vintage", series), F.lit(1).alias("asks"))
    known = series.filter("vintage is not null").select("measure", none("claim_id", claims), F.col("vintage").alias("t"), "value", "vintage", F.lit(0).alias("asks"))
    w = Window.partitionBy("measure").orderBy("t", "asks").rowsBetween(Window.unboundedPreceding, 0)
    then = F.last(F.when(F.col("asks") == 0, F.struct("value", "vintage")), True).over(w)
    u = asks.unionByName(known).withColumn("then", then).filter("asks = 1").select("claim_id", F.col("then.value").alias("value_then"), F.col("then.vintage").alias("vintage_then"))
    now = series.groupBy("measure").agg(F.max_by("value", "vintage").alias("value_now"), F.max("vintage").alias("vintage_now"))
    return claims.join(u, "claim_id", "left").join(now, "measure", "left").withColumn("outdated", F.coalesce(F.col("value_then") != F.col("value_now"), F.lit(False)))


def arbitrate(readings: DataFrame, least: int = 2) -> DataFrame:
    """readings: claim_id, family, value. A value heard by at least two families stands."""
    v = readings.groupBy("claim_id", "value").agg(F.count_distinct("family").alias("families"))
    return v.filter(F.col("families") >= least).groupBy("claim_id").agg(F.max_by("value", F.struct("families", -F.col("value"))).alias("value"))


def coherence(pledges: DataFrame, programme: DataFrame) -> DataFrame:
    """pledges: speaker, topic, position; programme: speaker, topic, published. Never a truth verdict."""
    j = pledges.join(programme, ["speaker", "topic"], "left")
    p, q = F.col("position"), F.col("published")
    return j.withColumn("coherence", F.when(q.isNull(), "absent").when(p == q, "consistent").when(F.signum(p) == -F.signum(q), "contradicted").otherwise("divergent"))


def clear_speech(segments: DataFrame, no_speech: float = 0.6, log_prob: float = -1.0, compression: float = 2.4) -> DataFrame:
    return segments.filter((F.col("no_speech_prob") <= no_speech) & (F.col("avg_logprob") >= log_prob) & (F.col("compression_ratio") <= compression))


def relisten(statements: DataFrame, around: float = 3.0) -> DataFrame:
    """An interval around each numeric trigger's time."""
    t = statements.select("statement_id", "timestamp", F.explode("triggers").alias("t")).filter(F.col("t.type").isin("percentage", "amount", "number"))
    return t.select("statement_id", (F.col("timestamp") - around).alias("l_start"), (F.col("timestamp") + around).alias("l_stop"), F.col("t.text").alias("text"))
