"""Voices against a register of prints: two nearest by cosine, and prints too close to each other.

A register of checked size is one matrix that all tasks get, and rows are multiplied with it a batch at a time. A larger one is
cut into cells around pivots. Angles obey the triangle inequality, so a cell whose radius is less than a row's angle to its
pivot by more than the row's second nearest so far holds no nearer print: rows first meet their own cell, then only cells that this leaves, and the
result is that of all pairs. A cell with many rows is dealt to several tasks.

Rows whose vector is null or holds null or NaN have no similarity; a vector of length zero has similarity 0 with all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from claimlens.storage import materialise

#: Bytes of a register up to which it is sent to all tasks.
REGISTER = 32 << 20
PIVOTS = 4096  # at most; each costs a row one product
_ROWS = 1 << 15  # rows of a cell in one task
_SLACK = 1e-6  # of angles, for rounding


def _units(column: pa.ListArray | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one (or zero), and which are whole."""
    if not dim:  # an empty register
        return np.zeros((len(column), 0)), np.zeros(len(column), bool)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    whole = pc.fill_null(pc.list_value_length(column), -1).to_numpy() == dim
    out = np.zeros((len(column), dim))
    out[whole] = column.filter(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)  # a null component becomes NaN
    whole &= np.isfinite(out).all(1)
    out[~whole] = 0.0
    n = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(n > 0, n, 1.0), whole


def _nearest(sims: np.ndarray, ids: np.ndarray) -> list[list[dict]]:
    """The two most similar of each row; equal ones by id, in the order of which ids stand."""
    order = np.argsort(-np.round(sims, 12), axis=1, kind="stable")[:, :2]
    return [[{"n": -float(s[j]), "id": ids[j]} for j in o] for s, o in zip(sims, order)]


def _found(of_id: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct([("n", pa.float64()), ("id", of_id)]))


def _angles(sims: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(sims, -1.0, 1.0))


def _matrix(prints: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and unit vectors, of a register whose size was checked."""
    rows = prints.select("speaker_id", F.col("centroid").cast("array<double>").alias("v")).orderBy("speaker_id").toArrow()
    units, whole = _units(rows["v"], dim)
    return rows["speaker_id"].to_numpy()[whole], units[whole]


def _register(prints: DataFrame) -> tuple[int, int]:
    n, dim = prints.agg(F.count("*"), F.max(F.size("centroid"))).first()
    return n, dim or 0


class _Cells:
    """Prints dealt to the nearest of the pivots."""

    def __init__(self, prints: DataFrame, n: int, dim: int, block: int):
        self.dim, spark = dim, prints.sparkSession
        count = min(PIVOTS, -(-n // block))
        _, self.pivots = _matrix(prints.orderBy(F.xxhash64("speaker_id"), "speaker_id").limit(count), dim)  # at most PIVOTS vectors
        pivots, kind = self.pivots, prints.schema["speaker_id"].dataType.simpleString()

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                units, whole = _units(b.column(1), dim)
                sims = units @ pivots.T
                cell = sims.argmax(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int64()), pa.array(_angles(sims[np.arange(len(cell)), cell]))], ["speaker_id", "v", "cell", "angle"]).filter(pa.array(whole))

        dealt = prints.select("speaker_id", F.col("centroid").cast("array<double>").alias("v")).mapInArrow(deal, f"speaker_id {kind}, v array<double>, cell long, angle double")
        self.prints = materialise(dealt, "cells")
        self.radius = np.full(len(pivots), -np.inf)
        for r in self.prints.groupBy("cell").agg(F.max("angle").alias("a")).collect():  # a row a pivot
            self.radius[r["cell"]] = r["a"]
        self.spark = spark

    def meet(self, rows: DataFrame, work, schema: str) -> DataFrame:
        """``work`` on rows (with cell) and the prints of their cell; a cell of many rows is cut."""
        sizes = {r["cell"]: -(-r["n"] // _ROWS) for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a pivot
        parts = self.spark.createDataFrame(list(sizes.items()) or [(0, 1)], "cell long, parts int")
        a = rows.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.monotonically_increasing_id(), F.col("parts")).cast("int")).drop("parts")
        b = self.prints.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "angle")
        return a.groupBy("cell", "part").cogroup(b.groupBy("cell", "part")).applyInArrow(work, schema)


def two_nearest(rows: DataFrame, prints: DataFrame, key: str, vector: str, block: int = 1024, register: int | None = None) -> DataFrame:
    """(key, s, compared): s holds the two nearest prints as (minus similarity, id), nearest first; compared: prints the row was multiplied with."""
    n, dim = _register(prints)
    of_key, kind = to_arrow_type(rows.schema[key].dataType), rows.schema[key].dataType.simpleString()
    of_id, id_kind = to_arrow_type(prints.schema["speaker_id"].dataType), prints.schema["speaker_id"].dataType.simpleString()
    schema, names = f"`{key}` {kind}, s array<struct<n:double,id:{id_kind}>>, compared long", [key, "s", "compared"]
    own = rows.select(F.col(key), F.col(vector).cast("array<double>").alias("v"))

    def table(keys, found, compared):
        return [pa.array(keys, of_key) if isinstance(keys, list) else keys, pa.array(found, _found(of_id)), pa.array([compared] * len(found), pa.int64())]

    if n * dim * 8 <= (REGISTER if register is None else register):
        ids, matrix = _matrix(prints, dim)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                units, whole = _units(b.column(1), dim)
                found = _nearest(units @ matrix.T, ids)
                yield pa.RecordBatch.from_arrays(table(b.column(0), [f if w else [] for f, w in zip(found, whole)], len(ids)), names)

        return own.mapInArrow(near, schema)

    cells = _Cells(prints, n, dim, block)
    pivots, radius = cells.pivots, cells.radius

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units, _ = _units(b.column(1), dim)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((units @ pivots.T + np.where(np.isinf(radius), -9.0, 0.0)).argmax(1), pa.int64())], [key, "v", "cell"])

    def first(a: pa.Table, b: pa.Table) -> pa.Table:
        units, whole = _units(a["v"], dim)
        b = b.sort_by("speaker_id")
        found = _nearest(units @ _units(b["v"], dim)[0].T, b["speaker_id"].to_numpy())
        out = table(a[key].combine_chunks(), [f if w else [] for f, w in zip(found, whole)], len(b))
        return pa.table([*out, a["v"].combine_chunks(), a["cell"].combine_chunks()], names=[*names, "v", "cell"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units, whole = _units(b.column(2), dim)
            second = np.array([-x[1]["n"] if len(x) > 1 else -1.0 for x in b.column(1).to_pylist()])
            may = (_angles(units @ pivots.T) - radius <= _angles(second)[:, None] + _SLACK) & whole[:, None] & np.isfinite(radius)
            may[np.arange(len(may)), b.column(3).to_numpy()] = False
            row, cell = np.nonzero(may)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(2).take(pa.array(row)), pa.array(cell, pa.int64())], [key, "v", "cell"])

    met = materialise(cells.meet(own.mapInArrow(home, f"`{key}` {kind}, v array<double>, cell long"), first, f"{schema}, v array<double>, cell long"), "nearest")
    more = materialise(met.select(key, "s", "v", "cell").mapInArrow(rest, f"`{key}` {kind}, v array<double>, cell long"), "cells")
    later = cells.meet(more, lambda a, b: first(a, b).select(names), schema)
    all_ = met.select(names).unionByName(later)
    merged = F.slice(F.array_sort(F.flatten(F.collect_list("s"))), 1, 2)  # two of each cell that the row met
    return all_.groupBy(key).agg(merged.alias("s"), F.sum("compared").alias("compared"))


def identify(rows: DataFrame, prints: DataFrame, key: str, vector: str, threshold: float = 0.62, margin: float = 0.06, block: int = 1024, register: int | None = None) -> DataFrame:
    """(key, speaker_id, similarity, runner_up, reason, compared): top-1 cosine with rejection. prints: speaker_id, centroid; keys are unique."""
    scored = two_nearest(rows, prints, key, vector, block, register)
    found = F.size("s")
    best, second = -F.get("s", F.lit(0))["n"], F.coalesce(-F.get("s", F.lit(1))["n"], F.lit(0.0))
    reason = F.when(F.col("compared") <= 0, "no prints").when((found <= 0) | (best < threshold), "below threshold").when((found > 1) & (best - second < margin), "margin").otherwise("accepted")
    return scored.select(key, F.when(reason == "accepted", F.get("s", F.lit(0))["id"]).alias("speaker_id"), best.alias("similarity"), second.alias("runner_up"), reason.alias("reason"), "compared")


def separated(prints: DataFrame, threshold: float = 0.50, block: int = 1024, register: int | None = None) -> DataFrame:
    """Prints without any that is more similar than the threshold; both of a close pair go."""
    n, dim = _register(prints)
    kind = prints.schema["speaker_id"].dataType.simpleString()
    own = prints.select("speaker_id", F.col("centroid").cast("array<double>").alias("v"))
    if n * dim * 8 <= (REGISTER if register is None else register):
        ids, matrix = _matrix(prints, dim)

        def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sims = _units(b.column(1), dim)[0] @ matrix.T
                other = b.column(0).to_numpy(zero_copy_only=False)[:, None] != ids[None, :]
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(((sims > threshold) & other).any(1)))], ["speaker_id"])

        return prints.join(own.mapInArrow(close, f"speaker_id {kind}"), "speaker_id", "left_anti")

    cells = _Cells(prints, n, dim, block)
    pivots, radius, reach = cells.pivots, cells.radius, float(_angles(np.array(threshold)))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units, whole = _units(b.column(1), dim)
            row, cell = np.nonzero((_angles(units @ pivots.T) - radius <= reach + _SLACK) & whole[:, None] & np.isfinite(radius))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(cell, pa.int64())], ["speaker_id", "v", "cell"])

    def clash(a: pa.Table, b: pa.Table) -> pa.Table:
        sims = _units(a["v"], dim)[0] @ _units(b["v"], dim)[0].T
        other = a["speaker_id"].to_numpy()[:, None] != b["speaker_id"].to_numpy()[None, :]
        return a.select(["speaker_id"]).filter(pa.array(((sims > threshold) & other).any(1)))

    gone = cells.meet(materialise(own.mapInArrow(near, f"speaker_id {kind}, v array<double>, cell long"), "near"), clash, f"speaker_id {kind}")
    return prints.join(gone.distinct(), "speaker_id", "left_anti")
