"""Reports and grouped decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from claimlens.functions.numbers import dot


def share(n, of):
    return F.round(F.try_divide(n, F.greatest(of, F.lit(1))), 3)


def trigger_density(statements: DataFrame, minutes: float) -> DataFrame:
    """Total, per minute and count of each type over triggers (array of spans)."""
    # a plain explode would be given a filter on its array, and with it a second run of the scanner
    t = statements.select(F.explode_outer("triggers.type").alias("type")).filter("type is not null")
    by = t.groupBy("type").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return by.select("type", "n", total.alias("total"), F.when(F.lit(minutes) > 0, F.round(total / F.lit(minutes), 2)).otherwise(0.0).alias("per_minute"))


def agreement_report(rows: DataFrame) -> DataFrame:
    """rows: status. Shares over statements with figures."""
    n = lambda s: F.count_if(F.col("status") == s)
    figures = F.count_if(F.col("status") != "no_quantity")
    blocked = F.count_if(~F.col("status").isin("confirmed", "no_quantity"))
    return rows.agg(F.count("*").alias("statements"), figures.alias("with_figures"), n("confirmed").alias("corroborated"), share(n("confirmed"), figures).alias("corroborated_share"), share(blocked, figures).alias("blocked_share"))


def speech_coverage(blocks: DataFrame) -> DataFrame:
    """blocks: seconds, identified, analysed."""
    s = lambda c: F.round(F.coalesce(F.sum(F.when(c, F.col("seconds"))), F.lit(0.0)), 3)
    return blocks.agg(s(F.lit(True)).alias("total"), s(~F.col("identified")).alias("unattributed"), s(F.col("identified") & ~F.col("analysed")).alias("not_analysed"), s(F.col("analysed") & F.col("identified")).alias("analysed_seconds"))


def _run_counters(statements: DataFrame) -> list[Column]:
    unv = F.count_if(F.col("verdict") == "unverified")
    verified = F.count_if(F.col("verdict").isNotNull() & (F.col("verdict") != "out_of_scope"))
    out = [F.count("*").alias("statements"), verified.alias("verified"), unv.alias("unverified"), F.round(F.coalesce(F.try_divide(unv, verified), F.lit(0.0)), 6).alias("abstention"), F.count_if(F.col("verdict") == "false").alias("reds")]
    if "triggers" in statements.columns:
        out.append(F.count_if(F.size("triggers") > 0).alias("triggered"))
    if "sources" in statements.columns:
        unproved = F.size(F.filter("sources", lambda s: ~F.coalesce(s["quote_verified"], F.lit(False))))
        out.append(F.coalesce(F.sum(F.greatest(unproved, F.lit(0))), F.lit(0)).cast("long").alias("unverified_quotes"))
    if "strong_verdict" in statements.columns:
        out.append(F.count("strong_verdict").alias("escalated"))
    return out


def run_stats(statements: DataFrame) -> DataFrame:
    """One row of counters. statements: verdict, and for the counters named triggered, unverified_quotes and escalated the columns triggers,
    sources (structs with quote_verified, null counting as not verified) and strong_verdict (null where no second judge was asked)."""
    return statements.agg(*_run_counters(statements))


def observed_run(statements: DataFrame) -> tuple[DataFrame, Observation]:
    """The statements, and the counters of ``run_stats`` gathered while an action runs over them: no second pass. Read them after the action."""
    seen = Observation("run")
    return statements.observe(seen, *_run_counters(statements)), seen


def status_counts(rows: DataFrame) -> DataFrame:
    """(status, n, share) of all statements, those without figures too."""
    n = rows.groupBy("status").agg(F.count("*").alias("n"))
    return n.select("status", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 3).alias("share"))


def majority_identity(windows: DataFrame, key: str) -> DataFrame:
    """(key, n_windows, accepted, speaker_id, share, similarity): modal identity among accepted windows, ties to the first seen."""
    n = windows.groupBy(key).agg(F.count("*").alias("n_windows"), F.count("speaker_id").alias("accepted"))
    g = windows.filter("speaker_id is not null").groupBy(key, "speaker_id").agg(F.count("*").alias("c"), F.min("seq").alias("first"), F.avg("similarity").alias("sim"))
    best = g.groupBy(key).agg(F.max_by(F.struct("speaker_id", "c", "sim"), F.struct("c", -F.col("first"))).alias("b"))
    return n.join(best, key, "left").select(key, "n_windows", "accepted", F.col("b.speaker_id").alias("speaker_id"), (F.col("b.c") / F.col("accepted")).alias("share"), F.col("b.sim").alias("similarity"))


def consensus(majority: DataFrame, overlapped: DataFrame, prints: DataFrame, key: str, min_windows: int = 2, min_share: float = 0.75) -> DataFrame:
    """Decision ladder: overlapped speech and every doubt abstain."""
    m = majority.join(overlapped, key, "left").join(prints.select("speaker_id", F.lit(True).alias("known")), "speaker_id", "left")
    reason = (
        F.when(F.coalesce("overlap", F.lit(False)), "overlap")
        .when(F.col("n_windows") < min_windows, "too few windows")
        .when(F.col("accepted") == 0, "none accepted")
        .when(F.col("share") < min_share, "disagreement")
        .when(F.col("known").isNull(), "unknown print")
        .otherwise("attributed")
    )
    return m.select(key, F.when(reason == "attributed", F.col("speaker_id")).alias("speaker_id"), reason.alias("reason"))


def centroids(vectors: DataFrame, key: str, vector: str, least: int = 3) -> DataFrame:
    """(speaker_id, centroid, members, cohesion): mean of unit vectors, scaled to one; cohesion is the mean cosine of members."""
    x = F.col(vector).cast("array<double>")
    unit = vectors.select(F.col(key).alias("speaker_id"), F.transform(x, lambda v: v / F.sqrt(dot(x, x))).alias("u")).filter("u is not null")
    mean = unit.select("speaker_id", F.posexplode("u").alias("i", "v")).groupBy("speaker_id", "i").agg(F.avg("v").alias("m"), F.count("*").alias("members"))
    c = mean.groupBy("speaker_id").agg(F.max("members").alias("members"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m")).filter(F.col("members") >= least)
    c = c.select("speaker_id", "members", F.transform("m", lambda v: v / F.sqrt(dot(F.col("m"), F.col("m")))).alias("centroid"))
    cohesion = unit.join(c.select("speaker_id", "centroid"), "speaker_id").groupBy("speaker_id").agg(F.avg(dot(F.col("u"), F.col("centroid"))).alias("cohesion"))
    return c.join(cohesion, "speaker_id")


def gold_compare(gold: DataFrame, produced: DataFrame) -> DataFrame:
    """Paired on common ids only; ids of either side alone are counted."""
    j = gold.select("id", F.col("verdict").alias("g")).join(produced.select("id", F.col("verdict").alias("p")), "id", "full")
    both = F.col("g").isNotNull() & F.col("p").isNotNull()
    n = F.count_if(both)
    return j.agg(
        n.alias("compared"),
        share(F.count_if(both & (F.col("g") == F.col("p"))), n).alias("agreement"),
        F.count_if(both & (F.col("p") == "false") & F.col("g").isin("exact", "approximate")).alias("false_positives"),
        F.count_if(both & (F.col("g") == "false") & (F.col("p") != "false")).alias("missed_falses"),
        F.count_if(F.col("p").isNull()).alias("only_gold"),
        F.count_if(F.col("g").isNull()).alias("only_produced"),
    )


def threshold_sweep(items: DataFrame, grid: DataFrame) -> DataFrame:
    """items: gap, unit, label; grid (a fixed list of bars): exact_bar, approx_bar. Labels reproduced by each pair of bars and unit."""
    b = F.when(F.col("gap") <= F.col("exact_bar"), "exact").when(F.col("gap") <= F.col("approx_bar"), "approximate").otherwise("false")
    bars = [(r["exact_bar"], r["approx_bar"]) for r in grid.filter("approx_bar > exact_bar").collect()]
    each = F.explode(F.array(*(F.struct(F.lit(e).alias("exact_bar"), F.lit(a).alias("approx_bar")) for e, a in bars)))
    return items.withColumn("g", each).select("*", "g.*").groupBy("unit", "exact_bar", "approx_bar").agg(F.count_if(b == F.col("label")).alias("reproduced"), F.count("*").alias("items"))


def ledger_status(occurrences: DataFrame, key: str) -> DataFrame:
    settled = F.col("verdict").isin("exact", "approximate", "false")
    g = occurrences.groupBy(key).agg(F.count("*").alias("occurrences"), F.count_if(settled).alias("settled"), F.min(F.when(settled, F.col("verdict"))).alias("low"), F.max(F.when(settled, F.col("verdict"))).alias("high"), F.max("confidence").alias("highest"))
    status = F.when(F.col("settled") < 2, "single").when(F.col("low") == F.col("high"), "corroborated").otherwise("conflicted")
    return g.withColumn("status", status).drop("low", "high")


def audit_occurrences(occurrences: DataFrame, key: str) -> DataFrame:
    """(key, status, statement_id, verdict, confidence): the occurrences of every claim met more than once, a row each, so a claim met very often
    is no single row; confidence to three places."""
    status = ledger_status(occurrences, key).filter("occurrences > 1").select(key, "status")
    return occurrences.select(key, "statement_id", "verdict", F.round("confidence", 3).alias("confidence")).join(status, key).select(key, "status", "statement_id", "verdict", "confidence")


def dominant(rows: DataFrame, by: list[str], who: str, seconds: str) -> DataFrame:
    t = rows.groupBy(*by, who).agg(F.sum(seconds).alias("s"))
    return t.groupBy(*by).agg(F.max_by(who, F.struct("s", F.col(who))).alias(who), F.max("s").alias("seconds"))
