"""Exact duplicates by a tree-merge of sorted digest runs.

Every partition makes a sorted run of its texts' digests, one entry per
text. Partitions then exchange runs in rounds: in round j each of the P = 4^k
partitions deals its run out to the four partitions that differ from it in digit j,
by digit j of the digest, and merges the four runs it gets. Equal texts collapse at
every level, so a text with very many copies has one entry per run, and after k rounds a
partition holds the whole groups of its own digest range; no task holds more.

A run is ordered by a 64-bit digest; entries are merged only if SHA-256 and byte length agree too, so
texts that share a 64-bit digest stay apart.

Cases: null text counts as empty; keys are integers or strings; null keys are the smallest; of rows with equal text and
key exactly one is kept; of a very long text only its digest travels; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.storage import materialise

FAN = 4


def lowered(text: str) -> Column:
    """The text with A-Z lower-cased, null as empty."""
    return F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, row, d, sha, size) of the whole text with A-Z lower-cased; row numbers the rows."""
    rows = docs.select(F.col(key).alias("id"), F.monotonically_increasing_id().alias("row"), lowered(text).alias("t"))
    return rows.select("id", "row", F.xxhash64("t").alias("d"), F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("sha"), F.octet_length("t").cast("long").alias("size"))


def _merge(keep: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for f in frames:
            if not len(f):
                continue
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            new = np.r_[True, (f["d"].to_numpy()[1:] != f["d"].to_numpy()[:-1]) | (f["sha"].to_numpy()[1:] != f["sha"].to_numpy()[:-1]) | (f["size"].to_numpy()[1:] != f["size"].to_numpy()[:-1])]
            starts = np.flatnonzero(new)
            ends = np.r_[starts[1:], len(f)] - 1
            best = ends if keep == "max" else starts
            has = f["id"].notna().to_numpy()
            ids = f["id"].to_numpy(np.int64, na_value=0) if f["id"].dtype == "Int64" else f["id"].where(has, "").to_numpy(object)
            group = np.cumsum(new) - 1
            same = (ids == ids[best][group]) & (has == has[best][group])
            out = f.iloc[best].reset_index(drop=True)
            out["cnt"] = np.add.reduceat(f["cnt"].to_numpy(np.int64), starts)
            out["ties"] = np.add.reduceat(f["ties"].to_numpy(np.int64) * same, starts)
            held = out.iloc[-1:]
            if len(out) > 1:
                yield out.iloc[:-1]
        if held is not None:
            yield held

    return run


def _typed(run, kind: str):
    """Integers keep all digits beside nulls."""

    def typed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return run(f.astype({"id": "Int64"}) if kind == "bigint" else f for f in frames)

    return typed


def merge_runs(entries: DataFrame, keep: str = "max") -> DataFrame:
    """(d, sha, size, keep_id, keep_row, cnt, ties) per text from (id, row, d, sha, size)."""
    spark = entries.sparkSession
    rounds = 1
    while FAN**rounds < int(spark.conf.get("spark.sql.shuffle.partitions")):
        rounds += 1
    order = ["d", "sha", "size", F.col("id").asc_nulls_first() if keep == "max" else F.col("id").asc_nulls_last(), "row"]
    if entries.schema["id"].dataType.simpleString() in ("tinyint", "smallint", "int"):
        entries = entries.withColumn("id", F.col("id").cast("long"))
    kind = entries.schema["id"].dataType.simpleString()
    schema = f"cur int, d long, sha binary, size long, id {kind}, row long, cnt long, ties long"
    merge = _typed(_merge(keep), kind)
    cols = [c.split()[0] for c in schema.split(", ")]
    runs = entries.select(F.pmod(F.spark_partition_id(), F.lit(FAN**rounds)).alias("cur"), "d", "sha", "size", "id", "row", F.lit(1).cast("long").alias("cnt"), F.lit(1).cast("long").alias("ties"))
    runs = runs.sortWithinPartitions(*order).mapInPandas(merge, schema)
    for j in range(rounds):
        # digit j of the partition becomes digit j of the digest
        digit = F.pmod(F.shiftright(F.col("d"), 2 * j), F.lit(FAN)).cast("int")
        at = F.lit(FAN**j)
        cur = F.col("cur") + (digit - F.pmod(F.floor(F.col("cur") / at), F.lit(FAN)).cast("int")) * at
        runs = runs.withColumn("cur", cur.cast("int")).select(cols).repartitionById(FAN**rounds, F.col("cur")).sortWithinPartitions(*order).mapInPandas(merge, schema)
    return runs.select("d", "sha", "size", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), "cnt", "ties")


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "max") -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) of every row; keep: which key of equal texts stays, max or min."""
    entries = materialise(digests(docs, key, text), "digests")
    groups = merge_runs(entries, keep)
    return entries.join(groups, ["d", "sha", "size"]).select(
        F.col("id").alias(key),
        "keep_id",
        F.col("cnt").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "max") -> DataFrame:
    """The rows that stay, with all their columns."""
    entries = digests(docs, key, text)
    groups = materialise(merge_runs(entries, keep), "groups")
    rows = docs.withColumn("__cl_sha", F.unhex(F.sha2(lowered(text).cast("binary"), 256)))
    stay = groups.select(F.col("sha").alias("__cl_sha"), F.col("keep_id").alias("__cl_id"), "ties")
    same = lambda s: (F.col("__cl_l.__cl_sha") == F.col("__cl_r.__cl_sha")) & F.col(f"__cl_l.{key}").eqNullSafe(F.col("__cl_r.__cl_id"))
    once = rows.alias("__cl_l").join(stay.filter("ties = 1").drop("ties").alias("__cl_r"), same(1), "left_semi")
    if not groups.filter("ties > 1").limit(1).count():
        return once.select(docs.columns)
    tied = rows.alias("__cl_l").join(stay.filter("ties > 1").drop("ties").alias("__cl_r"), same(1), "left_semi")
    return once.unionByName(tied.dropDuplicates(["__cl_sha", key])).select(docs.columns)
