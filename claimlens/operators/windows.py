"""Islands, gap merges and running states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, by: list[str], order: list[str], value: Column) -> DataFrame:
    """Adds island: consecutive rows of equal value share a number."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = F.when(value.eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("__c", change).withColumn("island", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__c")


def gap_merge(rows: DataFrame, by: list[str], order: list[str], start: Column, stop: Column, gap: float) -> DataFrame:
    """Adds island: rows that begin within ``gap`` of the stop before them continue its island."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.when(start - F.lag(stop).over(w) <= gap, 0).otherwise(1)
    return rows.withColumn("__c", new).withColumn("island", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__c")


def first_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__r = 1").drop("__r")


def active_clips(rows: DataFrame, by: list[str], order: list[str], usable: Column, wanted: int = 3) -> DataFrame:
    """Rows in order until enough usable ones came before; unusable ones do not count."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__u", F.coalesce(F.sum(F.when(usable, 1).otherwise(0)).over(w), F.lit(0))).filter(F.col("__u") < wanted).drop("__u")


def ledger(occurrences: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Running state of each key after each occurrence: settled, verdicts, status; a conflict is sticky by growth of the set.

    retracts: the earlier occurrences that this one turns to unverified (it opens the conflict)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    settled = F.col("verdict").isin("exact", "approximate", "false")
    o = occurrences.withColumn("settled", F.sum(F.when(settled, 1).otherwise(0)).over(w))
    # the lowest and highest verdict differ once two are seen: constant state, where a set over the frame would grow
    low, high = F.min(F.when(settled, F.col("verdict"))).over(w), F.max(F.when(settled, F.col("verdict"))).over(w)
    status = F.when(F.col("settled") < 2, "single").when(low == high, "corroborated").otherwise("conflicted")
    o = o.withColumn("status", status)
    before = F.lag("status").over(Window.partitionBy(key).orderBy(*order))
    earlier = F.coalesce(F.sum(F.when(F.col("verdict") != "unverified", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return o.withColumn("retracts", F.when((F.col("status") == "conflicted") & (F.coalesce(before, F.lit("")) != "conflicted"), earlier).otherwise(F.lit(0)))
