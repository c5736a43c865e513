"""Places in one order over all rows, without a task that holds them all.

Rows are dealt out by ranges of the order and sorted inside each; the place of a row is its position in its range after the
sizes of the ranges before it. Rows that tie are told apart by a row number, so very many equal rows are cut over several ranges too.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.storage import materialise

_INSIDE = (1 << 33) - 1


def ranked(df: DataFrame, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """df with the place of every row in the order, from 1; rows that tie come in the order they are read."""
    if clash := set(df.columns) & {"__cl_row", "__cl_at", "__cl_part", "__cl_before", rank}:
        raise ValueError(f"columns {sorted(clash)} are taken")
    rows = df.withColumn("__cl_row", F.monotonically_increasing_id())
    keys = [*order, F.col("__cl_row")]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__cl_row").withColumn("__cl_at", F.monotonically_increasing_id())
    dealt = materialise(dealt, "ranges")
    part = F.shiftright("__cl_at", 33)
    sizes = sorted(dealt.groupBy(part.alias("part")).count().collect())  # a row a range, of which there are as many as shuffle partitions
    before = accumulate((n for _, n in sizes), initial=0)
    starts = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "__cl_part long, __cl_before long")
    place = F.col("__cl_before") + F.col("__cl_at").bitwiseAND(F.lit(_INSIDE)) + 1
    return dealt.withColumn("__cl_part", part).join(F.broadcast(starts), "__cl_part").withColumn(rank, place.cast("long")).select(*df.columns, rank)


def medians(df: DataFrame, value: str) -> DataFrame:
    """(lower, upper, n) of the non-null values: the two middle ones, equal for an odd number; null without values."""
    placed = ranked(df.filter(F.col(value).isNotNull()).select(value), [F.col(value).asc()], "__cl_place")
    n = placed.agg(F.max("__cl_place")).first()[0]
    mid = placed.filter((F.col("__cl_place") * 2).between(n or 0, (n or 0) + 2))
    return mid.agg(F.min(value).alias("lower"), F.max(value).alias("upper"), F.lit(n).cast("long").alias("n"))
