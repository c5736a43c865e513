"""Verdict guardrails: each step may only weaken towards abstention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.functions.numbers import DOUBTFUL, POINT_BARS, RELATIVE_BARS, threshold_verdict

_weak = lambda: F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(DOUBTFUL))


def gate(statements: DataFrame, strict: bool = True) -> DataFrame:
    """statements: agreement. Strict: figures no witness confirms are stopped as unverified with confidence 0."""
    blocked = F.lit(strict) & ~F.col("agreement").isin("confirmed", "no_quantity")
    return statements.withColumn("allowed", ~blocked).withColumn("verdict", F.when(blocked, "unverified").otherwise(F.col("verdict"))).withColumn("confidence", F.when(blocked, 0.0).otherwise(F.col("confidence")))


def quotes_kept(statements: DataFrame) -> DataFrame:
    """sources: array of (quote, quote_verified, rank). No verified quote: unverified, confidence at most 0.3. Adds rank, the least of kept sources."""
    s = statements.withColumn("sources", F.filter("sources", lambda x: x["quote_verified"]))
    return s.withColumn("rank", F.array_min(F.transform("sources", lambda x: x["rank"]))).withColumns({"verdict": F.when(F.size("sources") == 0, "unverified").otherwise(F.col("verdict")), "confidence": F.when(F.size("sources") == 0, _weak()).otherwise(F.col("confidence"))})


def rank_cap(statements: DataFrame) -> DataFrame:
    capped = (F.col("verdict") == "false") & ~F.coalesce(F.col("rank") == 1, F.lit(False))
    return statements.withColumn("verdict", F.when(capped, "unverified").otherwise(F.col("verdict")))


def thresholds(statements: DataFrame) -> DataFrame:
    v, c = threshold_verdict(*(F.col(x) for x in ("verdict", "confidence", "gap", "unit", "rank")))
    return statements.withColumn("__v", v).withColumn("confidence", c).withColumn("verdict", F.col("__v")).drop("__v")


def explained_thresholds(statements: DataFrame) -> DataFrame:
    """``thresholds`` that say what they did. statements: also tags (array of strings) and note.

    A gap within the exact bar is tagged approximate_magnitude, once; a gap in points is noted, and so is a verdict withdrawn because the judge
    called exact what it measured beyond the bars. Abstentions and unmeasured gaps get neither.
    """
    gap, points = F.col("gap"), F.coalesce(F.col("unit") == "points", F.lit(False))
    decided = F.col("verdict").isin("exact", "approximate", "false") & gap.isNotNull()
    inside = decided & (gap <= F.when(points, POINT_BARS[0]).otherwise(RELATIVE_BARS[0]))
    beyond = decided & (F.col("verdict") == "exact") & (gap > F.when(points, POINT_BARS[1]).otherwise(RELATIVE_BARS[1]))
    in_points = F.concat(F.replace(F.format_string("%.2f", gap.cast("double")), F.lit("."), F.lit(",")), F.when(gap >= 2, " points").otherwise(" point"))
    written = F.when(points, in_points).otherwise(F.concat(F.bround(gap * 100, 0).cast("long").cast("string"), F.lit("%")))
    withdrawn = F.when(beyond, F.concat(F.lit("(Withdrawn: called exact with a gap of "), written, F.lit(".)")))
    measured = F.when(decided & points, F.concat(F.lit("(Gap in points: "), written, F.lit(".)")))
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    tagged = F.when(F.coalesce(inside, F.lit(False)) & ~F.array_contains(tags, "approximate_magnitude"), F.array_append(tags, F.lit("approximate_magnitude"))).otherwise(tags)
    return thresholds(statements.withColumns({"tags": tagged, "note": F.concat_ws(" ", F.nullif("note", F.lit("")), withdrawn, measured)}))


def red_guard(statements: DataFrame, unlocked: bool = False) -> DataFrame:
    """No false leaves unless unlocked and corroborated."""
    stop = (F.col("verdict") == "false") & ~(F.lit(unlocked) & F.coalesce("corroborated", F.lit(False)))
    return statements.withColumn("confidence", F.when(stop, _weak()).otherwise(F.col("confidence"))).withColumn("note", F.when(stop, F.concat_ws(" ", "note", F.lit("contradiction not published"))).otherwise(F.col("note"))).withColumn("verdict", F.when(stop, "unverified").otherwise(F.col("verdict")))


def fill(statements: DataFrame) -> DataFrame:
    return statements.withColumn("verdict", F.coalesce("verdict", F.lit("out_of_scope")))


def promotable(statements: DataFrame, least: float = 0.75) -> DataFrame:
    return statements.filter(F.col("verdict").isin("exact", "approximate", "false") & (F.col("confidence") >= least) & F.exists("sources", lambda s: s["quote_verified"]) & ~F.coalesce("withdrawn", F.lit(False)))


def apply_revisions(statements: DataFrame, revisions: DataFrame) -> DataFrame:
    """revisions: statement_id, new_verdict, new_confidence."""
    return statements.join(revisions, "statement_id", "left").withColumn("verdict", F.coalesce("new_verdict", "verdict")).withColumn("confidence", F.coalesce("new_confidence", "confidence")).drop("new_verdict", "new_confidence")


def withdraw(statements: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """Text stays, analysis goes."""
    w = withdrawals.select("statement_id", F.lit(True).alias("__w")).distinct()
    out = statements.drop("withdrawn").join(w, "statement_id", "left").withColumn("withdrawn", F.coalesce("__w", F.lit(False))).drop("__w")
    return out.withColumn("verdict", F.when(~F.col("withdrawn"), F.col("verdict"))).withColumn("confidence", F.when(~F.col("withdrawn"), F.col("confidence")))


def dispersion(runs: DataFrame) -> DataFrame:
    """Several runs of one statement: any disagreement abstains."""
    return runs.groupBy("statement_id").agg(F.when(F.min("verdict") == F.max("verdict"), F.min("verdict")).otherwise("unverified").alias("verdict"), F.count("*").alias("runs"))


def chain(statements: DataFrame, strict: bool = True, unlocked: bool = False) -> DataFrame:
    """All steps in their order."""
    return fill(red_guard(thresholds(rank_cap(quotes_kept(gate(statements, strict)))), unlocked))
