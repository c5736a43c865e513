"""Repeated passages removed, by a count-min prefilter and exact grouping of what it leaves.

Every window of ``width`` words is hashed to 128 bits. A sketch with two rows of counters, wider than the number of windows,
overestimates how often a window occurs: each partition of the corpus (a chunk of some 2^19 words) sketches its own windows, the
partitions' sketches are merged cell by cell, and only windows whose counters are two or more in both rows can be repeated.
No task holds the sketch: its cells are dealt out by range, a chunk sends the sorted cells it touches and gets back one bit for each. Rare windows
never leave their chunk; of the others a chunk sends its digests, once each with the earliest place, and the second pass
groups them exactly and answers which chunk holds the first. Windows that are really repeated are in no case lost.

A word goes if a window that covers it has the words of a window that starts earlier: in a document of smaller key, or earlier in the same. Windows
are judged on the input.

A chunk's memory is its words, an owner's its range of cells or digests, both set by parameters, whatever the corpus. Chunks x owners messages
are exchanged, so ``words`` and ``cells`` should grow with the square root of a very large input.

Cases: null and empty texts have no words; a text shorter than the window loses none; a very long text makes a chunk of its own; of texts that repeat
whole, the one of smallest key stays; of rows that share a key the one whose text has the smaller digest is earlier, of equal rows either; null keys come last;
an empty table gives an empty result; extra columns are ignored. Keys are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from claimlens.llm.rows import body_of
from claimlens.storage import materialise

WIDTH = 20
WORDS = 1 << 19
CELLS = 24  # bits of an owner's range of the sketch
_REMEMBER = 400_000
_LAST = (1 << 63) - 1


def chunks(docs: DataFrame, key: str, text: str, width: int, words: int) -> DataFrame:
    """(chunk, keys, ties, n_words, ends, windows, body): documents in order of key, their texts compressed together."""
    names = ["keys", "ties", "n_words", "ends", "windows", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        pack = zstandard.ZstdCompressor(level=1).compress

        def out():
            held.sort(key=lambda x: (_LAST if x[0] is None else x[0], x[1]))
            keys, ties, sizes, texts = zip(*held)
            windows = sum(max(0, n - width + 1) for n in sizes)
            lists = [pa.array([list(x)], pa.list_(pa.int64())) for x in (keys, ties, sizes, np.cumsum([len(t) for t in texts]))]
            return pa.RecordBatch.from_arrays([*lists, pa.array([windows], pa.int64()), pa.array([pack(b"".join(texts))], pa.binary())], names)

        for b in batches:
            for k, t in zip(b.column(0), b.column(1)):
                t = t.as_py()
                n = len(t.split())
                held.append((k.as_py(), xxhash.xxh64_intdigest(t) >> 1, n, t))
                total += n + 1
                if total >= words:
                    yield out()
                    held, total = [], 0
        if held:
            yield out()

    rows = docs.select(F.col(key).cast("long"), body_of(text).cast("binary").alias("__cl_text"))
    packed = rows.mapInArrow(run, "keys array<long>, ties array<long>, n_words array<long>, ends array<long>, windows long, body binary")
    return packed.withColumn("chunk", F.monotonically_increasing_id())


class Known(dict):
    """Words numbered as they come, with the 128 bits of each one's digest."""

    def __init__(self):
        super().__init__()
        self.digests = bytearray()

    def __missing__(self, word: bytes) -> int:
        self.digests += xxhash.xxh3_128_digest(word)
        self[word] = n = len(self)
        return n

    def lanes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > _REMEMBER:
            self.clear()
            self.digests.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        both = np.frombuffer(bytes(self.digests), "<u8").reshape(-1, 2)
        return both[at, 0], both[at, 1]


def _joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A digest of two neighbouring runs from theirs."""
    z = x * np.uint64(0x9E3779B97F4A7C15)
    z ^= z >> np.uint64(32)
    z += y
    z *= np.uint64(0xD6E8FEB86659FD93)
    z ^= z >> np.uint64(29)
    return z


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """A digest of every run of ``width`` words: runs of twice the length from two, then those that make up the width."""
    n, out, at, size, run = len(h) - width + 1, None, 0, 1, h
    if n <= 0:
        return np.zeros(0, np.uint64)
    runs = {1: h}
    while size * 2 <= width:
        run = _joined(run[: len(run) - size], run[size:])
        size *= 2
        runs[size] = run
    for size in sorted(runs, reverse=True):
        if width - at >= size:
            part = runs[size][at : at + n]
            out, at = part if out is None else _joined(out, part), at + size
    return out


class Chunk:
    """The words and windows of a chunk."""

    def __init__(self, known: Known, n_words, ends, body: bytes, width: int):
        raw = zstandard.ZstdDecompressor().decompress(body)
        self.sizes, self.words, a = np.array(n_words, np.int64), [], 0
        for b in ends:
            self.words += raw[a:b].split()
            a = b
        self.firsts = np.r_[0, np.cumsum(self.sizes)]
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        hi, lo = known.lanes(self.words)
        starts = np.arange(max(0, len(self.words) - width + 1))
        self.starts = starts[self.doc[starts] == self.doc[starts + width - 1]]
        self.hi, self.lo = (rolled(x, width)[self.starts] for x in (hi, lo))


def _cells(lane: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cell of every window; the distinct cells, sorted; which of them several windows of the chunk share."""
    cell = lane >> np.uint64(64 - bits)
    s = np.sort(cell)
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    return cell, s[first], np.diff(np.r_[first, len(s)]) > 1


def _cuts(distinct: np.ndarray, bits: int, owner_bits: int) -> np.ndarray:
    return np.r_[np.searchsorted(distinct, np.arange(1 << owner_bits, dtype=np.uint64) << np.uint64(bits - owner_bits)), len(distinct)]


def _packed(sorted_cells: np.ndarray) -> bytes:
    """Gaps of sorted numbers under 2^32, byte by byte plane."""
    gaps = np.diff(sorted_cells, prepend=sorted_cells.dtype.type(0)).astype("<u4")
    return zstandard.compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel(), dtype=np.int64)


_ASK = "owner long, chunk long, blob binary"
_TOLD = "chunk long, owner long, bits binary"


def _told(chunk, owner, bits) -> pa.Table:
    return pa.table({"chunk": pa.array(chunk, pa.int64()), "owner": pa.array([owner] * len(chunk), pa.int64()), "bits": pa.array(bits, pa.binary())})


def merged_sketch(packed: DataFrame, width: int, bits: int, owner_bits: int) -> DataFrame:
    """(chunk, told): for each chunk and owner, which of the chunk's sorted cells count two or more in the merged sketch."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for b in batches:
            for row in range(b.num_rows):
                chunk, n_words, ends, body = (b.column(c)[row].as_py() for c in range(4))
                own, owners, blobs = Chunk(known, n_words, ends, body, width), [], []
                for r, lane in enumerate((own.hi, own.lo)):
                    _, distinct, _ = _cells(lane, bits)
                    cuts = _cuts(distinct, bits, owner_bits)
                    for o in np.flatnonzero(np.diff(cuts)).tolist():
                        owners.append((r << owner_bits) + o)
                        blobs.append(_packed(distinct[cuts[o] : cuts[o + 1]] - np.uint64(o << (bits - owner_bits))))
                yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array([chunk] * len(owners), pa.int64()), pa.array(blobs, pa.binary())], ["owner", "chunk", "blob"])

    def own(asked: pa.Table) -> pa.Table:
        count = np.zeros(1 << (bits - owner_bits), np.uint8)  # two is as good as more
        for blob in asked["blob"]:
            at = _unpacked(blob.as_py())
            count[at] = np.minimum(count[at] + 1, 2)
        answers = [np.packbits(count[_unpacked(blob.as_py())] == 2).tobytes() for blob in asked["blob"]]
        return _told(asked["chunk"].to_pylist(), asked["owner"][0].as_py(), answers)

    asks = packed.filter("windows > 0").select("chunk", "n_words", "ends", "body").mapInArrow(ask, _ASK)
    return _by_chunk(asks.groupBy("owner").applyInArrow(own, _TOLD))


def _by_chunk(told: DataFrame) -> DataFrame:
    return told.groupBy("chunk").agg(F.collect_list(F.struct("owner", "bits")).alias("told"))  # a bit a cell or digest of the chunk


def suspects(own: Chunk, told: list[dict], bits: int, owner_bits: int) -> np.ndarray:
    """Windows whose counters are two or more in both rows."""
    answer, keep = {x["owner"]: x["bits"] for x in told}, np.ones(len(own.starts), bool)
    for r, lane in enumerate((own.hi, own.lo)):
        cell, distinct, repeated = _cells(lane, bits)
        cuts, repeated = _cuts(distinct, bits, owner_bits), repeated.copy()
        for o in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[o], cuts[o + 1]
            repeated[a:b] |= np.unpackbits(np.frombuffer(answer[(r << owner_bits) + o], np.uint8), count=b - a).astype(bool)
        wanted = distinct[repeated]
        keep &= _member(cell, wanted)
    return np.flatnonzero(keep)


def _member(x: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted ``wanted``; a small table of low bits settles most."""
    if not len(wanted):
        return np.zeros(len(x), bool)
    low, table = np.uint64((1 << 21) - 1), np.zeros(1 << 21, bool)
    table[wanted & low] = True
    out = table[x & low]
    at = np.flatnonzero(out)
    place = np.minimum(np.searchsorted(wanted, x[at]), len(wanted) - 1)
    out[at] = wanted[place] == x[at]
    return out


def _digests(own: Chunk, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suspects in order of digest, earliest first among equal; where each distinct digest begins."""
    hi, lo = own.hi[at], own.lo[at]
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    first = np.flatnonzero(np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]) if len(hi) else np.zeros(0, np.int64)
    return at[order], first


_ENTRY = np.dtype([("hi", "<u8"), ("lo", "<u8"), ("key", "<i8"), ("tie", "<i8")])


def _entries(e: np.ndarray) -> bytes:
    """Digests, then places, of which few differ."""
    return zstandard.compress(np.column_stack((e["hi"], e["lo"])).tobytes() + np.column_stack((e["key"], e["tie"])).tobytes(), 1)


def _read(blob: bytes) -> np.ndarray:
    digests, places = np.frombuffer(zstandard.decompress(blob), np.int64).reshape(2, -1, 2)
    e = np.zeros(len(digests), _ENTRY)
    (e["hi"], e["lo"]), (e["key"], e["tie"]) = digests.view(np.uint64).T, places.T
    return e


def first_holders(packed: DataFrame, sketched: DataFrame, width: int, bits: int, sketch_bits: int, owner_bits: int) -> DataFrame:
    """(chunk, told): for each chunk and owner, which of the chunk's suspect digests start in this chunk first."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for b in batches:
            for row in range(b.num_rows):
                chunk, keys, ties, n_words, ends, body, told = (b.column(c)[row].as_py() for c in range(7))
                own = Chunk(known, n_words, ends, body, width)
                at, first = _digests(own, suspects(own, told, bits, sketch_bits))
                at = at[first]
                doc = own.doc[own.starts[at]]
                e = np.zeros(len(at), _ENTRY)
                e["hi"], e["lo"] = own.hi[at], own.lo[at]
                e["key"], e["tie"] = np.array([_LAST if k is None else k for k in keys], np.int64)[doc], np.array(ties, np.int64)[doc]
                cuts = _cuts(e["hi"], 64, owner_bits)
                owners = np.flatnonzero(np.diff(cuts)).tolist()
                blobs = [_entries(e[cuts[o] : cuts[o + 1]]) for o in owners]
                yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array([chunk] * len(owners), pa.int64()), pa.array(blobs, pa.binary())], ["owner", "chunk", "blob"])

    def own(asked: pa.Table) -> pa.Table:
        # the earliest place of every digest, merged some chunks at a time; of equal places the chunk read first has it
        best, held, of_best, of_held = np.zeros(0, _ENTRY), [], np.zeros(0, np.int64), []
        chunk = asked["chunk"].to_numpy()
        order = np.argsort(chunk)
        for n, i in enumerate(order.tolist()):
            held.append(_read(asked["blob"][i].as_py()))
            of_held.append(np.full(len(held[-1]), chunk[i]))
            if sum(map(len, held)) >= 1 << 20 or n == len(order) - 1:
                e, of = np.concatenate([best, *held]), np.concatenate([of_best, *of_held])
                at = np.lexsort((of, e["tie"], e["key"], e["lo"], e["hi"]))
                e, of = e[at], of[at]
                new = np.flatnonzero(np.r_[True, (e["hi"][1:] != e["hi"][:-1]) | (e["lo"][1:] != e["lo"][:-1])])
                best, of_best, held, of_held = e[new], of[new], [], []
        answers = []
        for c, blob in zip(chunk.tolist(), asked["blob"]):
            e = _read(blob.as_py())
            at = np.searchsorted(best["hi"], e["hi"])
            while (other := best["lo"][at] != e["lo"]).any():  # digests that share 64 bits stand together
                at += other
            answers.append(np.packbits(of_best[at] == c).tobytes())
        return _told(chunk.tolist(), asked["owner"][0].as_py(), answers)

    rows = packed.join(sketched, "chunk").select("chunk", "keys", "ties", "n_words", "ends", "body", "told")
    return _by_chunk(rows.mapInArrow(ask, _ASK).groupBy("owner").applyInArrow(own, _TOLD))


def unrepeated(packed: DataFrame, sketched: DataFrame, firsts: DataFrame, key: str, width: int, bits: int, sketch_bits: int, owner_bits: int) -> DataFrame:
    """(key, n_words, n_removed, removed, kept) of every document."""
    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    names = [key, "n_words", "n_removed", "removed", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for b in batches:
            for row in range(b.num_rows):
                keys, n_words, ends, body, told, first_told = (b.column(c)[row].as_py() for c in range(6))
                own = Chunk(known, n_words, ends, body, width)
                gone = np.zeros(len(own.words) + 1, np.int64)
                if first_told:
                    at, first = _digests(own, suspects(own, told, bits, sketch_bits))
                    stays = np.zeros(len(at), bool)
                    cuts = _cuts(own.hi[at[first]], 64, owner_bits)
                    for x in first_told:
                        a, z = cuts[x["owner"]], cuts[x["owner"] + 1]
                        stays[first[a:z]] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=z - a).astype(bool)
                    starts = own.starts[at[~stays]]
                    np.add.at(gone, starts, 1)
                    np.add.at(gone, starts + width, -1)
                gone = np.cumsum(gone[:-1]) > 0
                out = [[], [], [], [], []]
                for d, k in enumerate(keys):
                    a, z = own.firsts[d], own.firsts[d + 1]
                    mine, words = gone[a:z], own.words[a:z]
                    edges = np.flatnonzero(np.diff(np.r_[False, mine, False].astype(np.int8))).reshape(-1, 2).tolist() if mine.any() else []
                    kept = [w for w, g in zip(words, mine.tolist()) if not g] if edges else words
                    for held, v in zip(out, (k, int(z - a), len(words) - len(kept), [{"start": x, "stop": y} for x, y in edges], b" ".join(kept))):
                        held.append(v)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], spans), pa.array(out[4], pa.binary())], names)

    rows = packed.join(sketched, "chunk", "left").join(firsts.withColumnRenamed("told", "first_told"), "chunk", "left").select("keys", "n_words", "ends", "body", "told", "first_told")
    return rows.mapInArrow(run, f"`{key}` long, n_words long, n_removed long, removed array<struct<start:long,stop:long>>, kept binary").withColumn("kept", F.col("kept").cast("string"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, words: int = WORDS, cells: int = CELLS) -> DataFrame:
    """(key, n_words, n_removed, removed, kept): removed are half-open ranges of word numbers, kept the words left, joined by one space.

    words: words of a chunk; cells: most bits of an owner's range of the sketch.
    """
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} must be an integer: its order says which passage came first")
    packed = materialise(chunks(docs, key, text, width, words), "chunks")
    total = packed.agg(F.sum("windows")).first()[0] or 0
    spread = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    bits = max(12, (4 * total).bit_length())  # four to eight cells a window
    sketch_bits = min(bits - 4, max(spread, bits - cells))
    digest_bits = max(spread, total.bit_length() - 20)
    sketched = materialise(merged_sketch(packed, width, bits, sketch_bits), "sketch")
    firsts = materialise(first_holders(packed, sketched, width, bits, sketch_bits, digest_bits), "firsts")
    return unrepeated(packed, sketched, firsts, key, width, bits, sketch_bits, digest_bits)
