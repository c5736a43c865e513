"""Quotes looked for in source texts by multi-pattern automata, one pass over the sources for each."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.storage import ship_package, spread

#: Letters of quotes, with 16 a quote besides, that one automaton takes; more quotes are dealt to several.
AUTOMATON = 2 << 20
#: Letters of a quote that lie in the automaton; the rest of a longer one is compared where these begin.
BEGINNING = 256
_built: dict[str, Beginnings] = {}


class Beginnings:
    """The quotes by their beginnings; ``found`` gives the numbers of those that a text holds."""

    def __init__(self, quotes: list[str]) -> None:
        import ahocorasick

        self.automaton, self.empty = ahocorasick.Automaton(), [i for i, q in enumerate(quotes) if not q]
        by: dict[str, list[tuple[int, str]]] = {}
        for i, q in enumerate(quotes):
            if q:
                by.setdefault(q[:BEGINNING], []).append((i, q))
        for start, those in by.items():
            self.automaton.add_word(start, (len(start), those))
        if by:
            self.automaton.make_automaton()

    def found(self, text: str) -> list[int]:
        out = set(self.empty)
        if len(self.automaton):
            for end, (size, those) in self.automaton.iter(text):
                out.update(i for i, q in those if i not in out and (len(q) == size or text.startswith(q, end + 1 - size)))
        return sorted(out)


def passes(quotes: DataFrame) -> int:
    """Automata that hold all the quotes; no quote, no automaton."""
    letters = quotes.agg(F.sum(F.length("flat") + F.lit(16))).first()[0] or 0
    return -(-letters // AUTOMATON)


def quotes_within(quotes: DataFrame, sources: DataFrame, parts: int) -> DataFrame:
    """(source_id, rep, and the sources' domain if any): each quote with each source that holds it.

    quotes: rep, flat, each flat once; sources: source_id, flat. The quotes of a part, about AUTOMATON letters of them, are sent to all tasks;
    sources are read once a part and only hits leave a task. Null texts hold nothing, an empty quote lies in every text.
    """
    spark = quotes.sparkSession
    ship_package(spark)
    kept = [c for c in ("source_id", "domain") if c in sources.columns]
    texts = spread(sources.filter("flat is not null").select(*kept, "flat"))
    types = {f.name: f.dataType.simpleString() for f in [*quotes.schema, *texts.schema]}
    schema = ", ".join(f"{c} {types[c]}" for c in [*kept, "rep"])
    out = None
    for part in range(parts):
        held = quotes.filter((F.pmod(F.xxhash64("flat"), F.lit(parts)) == part) & F.col("flat").isNotNull()).select("rep", "flat").toArrow()
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, held["rep"].combine_chunks(), held["flat"].to_pylist()))
        hits = texts.mapInArrow(_scan(sent, kept), schema)
        out = hits if out is None else out.unionByName(hits)
    return out


def _scan(sent, kept: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reps, quotes = sent.value
        if key not in _built:
            _built.clear()  # a worker goes from one part to the next
            _built[key] = Beginnings(quotes)
        known = _built[key]
        for b in batches:
            rows, which = [], []
            for row, text in enumerate(b.column("flat")):
                found = known.found(text.as_py())
                rows += [row] * len(found)
                which += found
                if len(rows) >= 1 << 16:
                    yield _hits(b, kept, reps, rows, which)
                    rows, which = [], []
            if rows:
                yield _hits(b, kept, reps, rows, which)

    return scan


def _hits(b: pa.RecordBatch, kept: list[str], reps: pa.Array, rows: list[int], which: list[int]) -> pa.RecordBatch:
    at = pa.array(rows, pa.int64())
    return pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in kept), reps.take(pa.array(which, pa.int64()))], [*kept, "rep"])
