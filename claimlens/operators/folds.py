"""Folds whose rule depends on what was kept so far, split over tasks within a group.

A row opens a block if its stop lies ``cap`` or more after the start of the block before it; else it joins that block. So what a
stretch of rows does depends on one number, the start of the block it finds open, and as a function of that number it is a step function: the
first row far enough behind opens a block, and from there on all is settled. Rows are sorted by ranges and cut into shards; every shard
gives its step function, neighbouring shards' functions are composed in rounds of a fixed fan, and the starts then found
are handed down again, so each shard is folded exactly with what it finds open. A group of any length is split over many tasks, many small groups share one.

The steps of a function are at most the rows of a shard and fall together when composed: no more can differ than rows begin within one cap.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.operators.ranking import ranked
from claimlens.storage import materialise

SHARD, FAN = 12, 6  # bits: rows of a shard, functions composed in a task
_NODE = "node long, first string, last string, whole boolean, at array<double>, out array<double>, n array<long>, exit double, exit_n long"
_NODE_PA = pa.schema([("node", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("whole", pa.bool_()), ("at", pa.list_(pa.float64())), ("out", pa.list_(pa.float64())), ("n", pa.list_(pa.int64())), ("exit", pa.float64()), ("exit_n", pa.int64())])
_ENTRY = "node long, key string, open double, blocks long"
_ENTRY_PA = pa.schema([("node", pa.int64()), ("key", pa.string()), ("open", pa.float64()), ("blocks", pa.int64())])
_NONE = float("-inf")


def _steps(a: np.ndarray, b: np.ndarray, cap: float) -> tuple[list, list, list]:
    """Thresholds, the start open at the end and the blocks opened, of rows of one group."""
    a, b, size = a.tolist(), b.tolist(), len(a)
    follows, j = [0] * size, 0
    for i in range(size):  # never moves back, as starts do not
        j = max(j, i + 1)
        while j < size and b[j] - a[i] < cap:
            j += 1
        follows[i] = j
    out, n = a[:], [1] * size
    for i in range(size - 1, -1, -1):
        if follows[i] < size:
            out[i], n[i] = out[follows[i]], n[follows[i]] + 1
    high, rows = _NONE, []
    for i in range(size):
        if b[i] > high:
            high = b[i]
            rows.append((high, out[i], n[i]))
    return _merged(rows)


def _merged(rows: list[tuple]) -> tuple[list, list, list]:
    """Of neighbouring steps with the same result the last one says all."""
    kept = [r for r, after in zip(rows, [*rows[1:], None]) if after is None or r[1:] != after[1:]]
    return tuple(map(list, zip(*kept))) if kept else ([], [], [])


def _run(node: dict, state: tuple | None, cap: float) -> tuple:
    """(key, open, blocks) after the node."""
    if not node["whole"]:
        return node["last"], node["exit"], node["exit_n"]
    key, v, n = state if state is not None and state[0] == node["first"] else (node["first"], _NONE, 0)
    i = bisect_left(node["at"], True, key=lambda t: t - v >= cap)
    return (key, v, n) if i == len(node["at"]) else (key, node["out"][i], n + node["n"][i])


def _composed(number: int, nodes: list[dict], cap: float) -> dict:
    first, last = nodes[0]["first"], nodes[-1]["last"]
    whole = all(x["whole"] and x["first"] == first for x in nodes)
    at, out, n, leaves, leaves_n = [], [], [], None, None
    if whole:
        rows = []
        for i, x in enumerate(nodes):
            for t, o, m in zip(x["at"], x["out"], x["n"]):
                if not rows or t > rows[-1][0]:
                    state = (first, o, m)
                    for y in nodes[i + 1 :]:
                        state = _run(y, state, cap)
                    rows.append((t, state[1], state[2]))
        at, out, n = _merged(rows)
    else:
        state = None
        for x in nodes:
            state = _run(x, state, cap)
        _, leaves, leaves_n = state
    return {"node": number, "first": first, "last": last, "whole": whole, "at": at, "out": out, "n": n, "exit": leaves, "exit_n": leaves_n}


def folded(rows: DataFrame, by: list[str], start: str, stop: str, seq: str, cap: float, shard: int = SHARD, fan: int = FAN) -> DataFrame:
    """(by, start, stop, seq, place, block, opens) of every row, in order of start, seq and stop; rows with a null time take no part.

    block counts from 0 in each group; opens: the row begins it.
    """
    asked = rows.filter(F.col(start).isNotNull() & F.col(stop).isNotNull())
    asked = asked.select(F.to_json(F.struct(*by)).alias("key"), *by, F.col(start).cast("double").alias("start"), F.col(stop).cast("double").alias("stop"), F.col(seq).alias("seq"))
    placed = ranked(asked, [F.col("key"), F.col("start"), F.col("seq"), F.col("stop")], "place").withColumn("node", F.shiftright(F.col("place") - 1, shard))

    def summary(f: pa.Table) -> pa.Table:
        f = f.sort_by("place")
        key, a, b = f["key"].to_numpy(), f["start"].to_numpy(), f["stop"].to_numpy()
        tail = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])  # where the last group begins
        at, out, n = _steps(a[tail:], b[tail:], cap)
        whole = tail == 0
        return pa.Table.from_pylist([{"node": f["node"][0].as_py(), "first": key[0], "last": key[-1], "whole": whole, "at": at if whole else [], "out": out if whole else [], "n": n if whole else [], "exit": None if whole else out[0], "exit_n": None if whole else n[0]}], _NODE_PA)

    def compose(f: pa.Table) -> pa.Table:
        f = f.sort_by("node")
        return pa.Table.from_pylist([_composed(f["parent"][0].as_py(), f.to_pylist(), cap)], _NODE_PA)

    def hand_down(f: pa.Table, above: pa.Table) -> pa.Table:
        given, out = above.to_pylist(), []
        state = (given[0]["key"], given[0]["open"], given[0]["blocks"]) if given and given[0]["key"] is not None else None
        for x in f.sort_by("node").to_pylist():
            out.append({"node": x["node"], **dict(zip(("key", "open", "blocks"), state or (None, None, None)))})
            state = _run(x, state, cap)
        return pa.Table.from_pylist(out, _ENTRY_PA)

    levels = [materialise(placed.select("node", "place", "key", "start", "stop").groupBy("node").applyInArrow(summary, _NODE), "steps")]
    nodes = levels[0].count()
    while nodes > 1 << fan:
        above = levels[-1].withColumn("parent", F.shiftright("node", fan)).groupBy("parent").applyInArrow(compose, _NODE)
        levels.append(materialise(above, "steps"))
        nodes = -(-nodes // (1 << fan))
    entries = rows.sparkSession.createDataFrame([], _ENTRY)
    for level in reversed(levels):
        entries = materialise(level.groupBy(F.shiftright("node", fan).alias("up")).cogroup(entries.groupBy(F.col("node").alias("up"))).applyInArrow(hand_down, _ENTRY), "entries")

    def fold(f: pa.Table, found: pa.Table) -> pa.Table:
        f, given = f.sort_by("place"), found.to_pylist()[0]
        before, v, n = given["key"], given["open"], given["blocks"]
        block, opens = [], []
        for k, a, b in zip(f["key"].to_pylist(), f["start"].to_pylist(), f["stop"].to_pylist()):
            if k != before:
                before, v, n = k, _NONE, 0
            new = b - v >= cap
            if new:
                v, n = a, n + 1
            block.append(n - 1)
            opens.append(new)
        return f.drop_columns(["key", "node"]).append_column("block", pa.array(block, pa.int64())).append_column("opens", pa.array(opens, pa.bool_()))

    kinds = ", ".join(f"`{c}` {placed.schema[c].dataType.simpleString()}" for c in placed.columns if c not in ("key", "node"))
    return placed.groupBy("node").cogroup(entries.groupBy("node")).applyInArrow(fold, f"{kinds}, block long, opens boolean")


def capped_blocks(rows: DataFrame, by: list[str], start: str, stop: str, seq: str, cap: float = 30.0, **sizes) -> DataFrame:
    """(by, block, start, stop, n): a row joins the block while its stop is less than ``cap`` after the block's start."""
    f = folded(rows, by, start, stop, seq, cap, **sizes)
    return f.groupBy(*by, "block").agg(F.min("start").alias("start"), F.max_by("stop", "place").alias("stop"), F.count("*").alias("n")).select(*by, F.col("block").cast("int"), "start", "stop", F.col("n").cast("int"))


def spaced(rows: DataFrame, by: list[str], at: str, apart: float, **sizes) -> DataFrame:
    """(by, n, first): how many rows of a group count, the first and every next one at least ``apart`` after the last that counted."""
    f = folded(rows.withColumn("__cl_seq", F.lit(0)), by, at, at, "__cl_seq", apart, **sizes)
    return f.groupBy(*by).agg(F.sum(F.col("opens").cast("int")).cast("int").alias("n"), F.min("start").alias("first"))
