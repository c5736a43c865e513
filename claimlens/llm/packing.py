"""Sequence packing by cutting-stock column generation.

A document of T tokens gives T // capacity full sequences and a tail. The tails'
length histogram (at most capacity - 1 rows, whatever the input), in classes of
``grain`` lengths rounded up, is the demand of a cutting-stock linear program over patterns, multisets of lengths that fit one
sequence. Columns are priced by an unbounded knapsack dynamic program over the duals
until Farley's bound proves the gap small. Pattern counts are rounded
down, the documents of each length are ranked, and ranks are assigned to the slots of
the patterns. What rounding leaves over (less than one pattern's worth per
basic pattern), and what only badly filled patterns would take, is laid end to end and cut at
the sequence borders; its places follow from the histogram alone.

Ranks need no sort: each task numbers its tails per length as it encodes, and
a prefix sum over (length, task) makes the numbers global.

Cases: null text counts as empty and is its end id alone; repeated rows and ties of length are packed each; keys of any type pass
unchanged, null ones too; a very long text fills sequences of its own; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.tokenise import default_path, json_vocabulary_encoder
from claimlens.storage import materialise


def price(duals: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best pattern for duals[l - 1] per length l: value and copies of each length."""
    best = np.zeros(capacity + 1)
    pick = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        v = best[c - 1 :: -1] + duals[:c]
        i = int(v.argmax())
        if v[i] > best[c - 1]:
            best[c], pick[c] = v[i], i + 1
        else:
            best[c] = best[c - 1]
    copies, c = np.zeros(capacity, np.int64), capacity
    while c > 0:
        if pick[c]:
            copies[pick[c] - 1] += 1
            c -= int(pick[c])
        else:
            c -= 1
    return float(best[capacity]), copies


def inverted(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots; a few hundred rows, and no threads on the driver."""
    n = len(a)
    w = np.hstack([a, np.eye(n)])
    for i in range(n):
        j = i + int(np.abs(w[i:, i]).argmax())
        w[[i, j]] = w[[j, i]]
        w[i] /= w[i, i]
        f = w[:, i].copy()
        f[i] = 0
        w -= np.outer(f, w[i])
    return w[:, n:]


def column_generation(demand: dict[int, int], capacity: int, gap: float = 0.002, rounds: int = 2500) -> list[tuple[float, dict[int, int]]]:
    """[(times, {length: copies})] of a basic solution that meets the demand exactly, within ``gap`` of the least number of sequences."""
    lengths = np.array(sorted(demand), np.int64)
    m = len(lengths)
    if not m:
        return []
    d = np.array([demand[int(n)] for n in lengths], float)
    basis = np.diag((capacity // lengths).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    x = inverse @ d
    for step in range(rounds):
        if step % 150 == 149:
            inverse = inverted(basis)
            x = np.maximum(inverse @ d, 0)
        y = inverse.sum(0)  # every pattern costs one sequence
        duals = np.full(capacity, -1.0)
        duals[lengths - 1] = y
        value, copies = price(duals, capacity)
        if value <= 1 + 1e-9 or x.sum() * (1 - 1 / value) <= gap * x.sum():
            break
        column = copies[lengths - 1].astype(float)
        u = inverse @ column
        rows = np.flatnonzero(u > 1e-9)
        r = rows[np.argmin(x[rows] / u[rows])]
        times = x[r] / u[r]
        x = np.maximum(x - times * u, 0)
        x[r] = times
        row = inverse[r] / u[r]
        inverse -= np.outer(u, row)
        inverse[r] = row
        basis[:, r] = column
    return [(float(x[j]), {int(n): int(k) for n, k in zip(lengths, basis[:, j]) if k > 0}) for j in range(m) if x[j] > 0]


@dataclass
class Plan:
    """Where the tail of given length and rank goes.

    Lengths are grouped in classes of ``grain`` and a class's tails are ranked by length, so the histogram
    tells the length of any rank. A slot is a run of ranks of one class, given to as many consecutive
    sequences; its offset is what the pattern's slots before it really hold there.
    """

    capacity: int
    grain: int
    counts: dict[int, int]
    base: dict[int, int]  # ranks of the class that shorter lengths take
    edges: dict[int, tuple[np.ndarray, np.ndarray]]  # per class: lengths, and ranks at which they end
    first: dict[int, np.ndarray]  # per class: first rank of each slot, ascending
    slot: dict[int, list[tuple[int, int, list[tuple[int, int]]]]]  # first sequence, first rank, (class, first rank) of the slots before it
    placed: dict[int, int]  # ranks from here on are laid end to end
    strip: dict[int, int]  # where the length's rest begins on the strip
    patterned: int  # sequences made from patterns
    sequences: int

    def length_at(self, cls: int, rank: int) -> int:
        lengths, ends = self.edges[cls]
        return int(lengths[np.searchsorted(ends, rank, "right")])

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """Pieces (start in tail, length, sequence, offset)."""
        cls = -(-length // self.grain)
        r = rank + self.base[length]
        if r < self.placed[cls]:
            first, begin, before = self.slot[cls][int(np.searchsorted(self.first[cls], r, "right")) - 1]
            return [(0, length, first + r - begin, sum(self.length_at(c, b + r - begin) for c, b in before))]
        at, done, pieces = self.strip[length] + (r - max(self.placed[cls], self.base[length])) * length, 0, []
        while done < length:
            room = min(length - done, self.capacity - (at + done) % self.capacity)
            pieces.append((done, room, self.patterned + (at + done) // self.capacity, (at + done) % self.capacity))
            done += room
        return pieces


def plan(counts: dict[int, int], capacity: int, grain: int = 8, gap: float = 0.002, fill: float = 0.98) -> Plan:
    """counts: tails per length below capacity. Patterns that fill less than ``fill`` of a sequence are not used: their tails join the strip."""
    demand: dict[int, int] = {}
    base: dict[int, int] = {}
    spans: dict[int, list[tuple[int, int]]] = {}
    for n in sorted(counts):
        cls = -(-n // grain)
        base[n] = demand.get(cls, 0)
        demand[cls] = base[n] + counts[n]
        spans.setdefault(cls, []).append((n, demand[cls]))
    edges = {c: (np.array([n for n, _ in v]), np.array([e for _, e in v])) for c, v in spans.items()}
    sequences, slots, used = 0, {c: [] for c in demand}, dict.fromkeys(demand, 0)
    for times, pattern in column_generation(demand, capacity // grain, gap):
        n = min([int(times + 1e-7), *((demand[k] - used[k]) // c for k, c in pattern.items())])
        if n <= 0 or sum(k * c for k, c in pattern.items()) * grain < fill * capacity:
            continue
        before: list[tuple[int, int]] = []
        for cls, copies in sorted(pattern.items(), reverse=True):
            for _ in range(copies):
                slots[cls].append((sequences, used[cls], list(before)))
                before.append((cls, used[cls]))
                used[cls] += n
        sequences += n
    strip, at = {}, 0
    for n in sorted(counts, reverse=True):
        strip[n] = at
        at += max(0, base[n] + counts[n] - max(used[-(-n // grain)], base[n])) * n
    return Plan(capacity, grain, counts, base, edges, {c: np.array([s[1] for s in v], np.int64) for c, v in slots.items()}, slots, used, strip, sequences, sequences + -(-at // capacity))


def encoded(docs: DataFrame, capacity: int, key: str, text: str, vocabulary: str, end_id: int) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = json_vocabulary_encoder(vocabulary), TaskContext.get().partitionId()
        full, ranks = 0, {}
        for b in batches:
            rows = {c: [] for c in ("doc_tokens", "full_before", "tail", "rank", "ids")}
            for t in b.column(1):
                ids = np.array(encode(t.as_py() or "") + [end_id], np.uint32)
                tail = len(ids) % capacity
                rows["doc_tokens"].append(len(ids))
                rows["full_before"].append(full)
                full += len(ids) // capacity
                rows["tail"].append(tail)
                rows["rank"].append(ranks.get(tail, 0))
                ranks[tail] = ranks.get(tail, 0) + 1
                rows["ids"].append(ids.astype("<u2").tobytes() if ids.max() < 65536 else b"\0" + ids.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([task] * len(b), pa.int32()), *(pa.array(rows[c], pa.int64()) for c in ("doc_tokens", "full_before", "tail", "rank")), pa.array(rows["ids"], pa.binary())], [key, "task", "doc_tokens", "full_before", "tail", "rank", "ids"])

    return docs.select(F.col(key), F.col(text).cast("string").alias("__cl_text")).mapInArrow(run, f"`{key}` {kind}, task int, doc_tokens long, full_before long, tail long, rank long, ids binary")


def _ids(raw: bytes) -> np.ndarray:
    """Two bytes an id where all fit; an odd length marks four."""
    return np.frombuffer(raw, "<u2").astype("<u4") if len(raw) % 2 == 0 else np.frombuffer(raw, "<u4", offset=1)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 1024, vocabulary: str | None = None, end_id: int = 0, grain: int = 8, gap: float = 0.002, with_ids: bool = True) -> DataFrame:
    """(key, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset): the pieces of all documents.

    ids is little-endian unsigned 32-bit; with_ids=False leaves it null and keeps the checksum only.
    """
    t = materialise(encoded(docs, capacity, key, text, vocabulary or default_path("byte_bpe_50k.json"), end_id), "encoded")
    ranks = t.groupBy("tail", "task").agg(F.count("*").alias("n"))
    demand = {r["tail"]: r["n"] for r in ranks.filter("tail > 0").groupBy("tail").agg(F.sum("n").alias("n")).collect()}  # fewer than capacity rows
    layout = plan(demand, capacity, grain, gap)
    before = Window.partitionBy("tail").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = ranks.select("tail", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_base"))
    fulls = t.groupBy("task").agg(F.max(F.col("full_before") + F.floor(F.col("doc_tokens") / capacity)).alias("n"))
    fulls = fulls.select("task", F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full_base"))  # one row a task
    bases = materialise(ranks.join(fulls, "task"), "bases")  # at most tasks x capacity rows of 28 bytes: Spark broadcasts them where its own bound allows
    kind = t.schema[key].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, (total, tail, rank, rank_base, before, full_base, raw) in enumerate(zip(*(c.to_pylist() for c in b.columns[1:]))):
                ids, rank, full = _ids(raw), rank + rank_base, before + full_base
                cut = total - tail
                pieces = [(s, capacity, layout.sequences + full + s // capacity, 0) for s in range(0, cut, capacity)]
                if tail:
                    pieces += [(cut + s, n, q, o) for s, n, q, o in layout.place(tail, rank)]
                for s, n, q, o in pieces:
                    part = ids[s : s + n].tobytes()
                    rows.append((i, s, n, part if with_ids else None, zlib.crc32(part), total, q, o))
            of, *columns = zip(*rows) if rows else [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))], [key, "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    joined = t.join(bases, ["tail", "task"])
    return joined.select(key, "doc_tokens", "tail", "rank", "rank_base", "full_before", "full_base", "ids").mapInArrow(assign, f"`{key}` {kind}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
