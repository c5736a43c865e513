"""Statements from blocks of speech in one pass, without an exchange: the same plan serves tables and streams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from claimlens.functions.triggers import SPANS, UNDECIDABLE, spans_of

_END = re.compile(r"(?<=[.!?…])\s+(?=[A-ZÀÉÈÊÎÔÙ])")
_SPAN = pa.list_(pa.struct([("type", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def placed(text: str) -> list[tuple[str, int]]:
    """Sentences with the character each begins at."""
    out, at = [], 0
    for stop, following in [*((m.start(), m.end()) for m in _END.finditer(text)), (len(text), len(text))]:
        piece = text[at:stop]
        bare = piece.strip()
        if bare:
            out.append((bare, at + len(piece) - len(piece.lstrip())))
        at = following
    return out


def statements(blocks: DataFrame, by: str) -> DataFrame:
    """One row a sentence: by, speaker, index, statement_id, text, offset, end, timestamp, triggers, candidate.

    blocks: by, start, stop, speaker, text. A sentence's time is the block's start plus the share of characters up to its end; offset and end are
    characters of the block. Null texts have no statements.
    """
    of_key, kind = to_arrow_type(blocks.schema[by].dataType), blocks.schema[by].dataType.simpleString()
    names = [by, "speaker", "index", "statement_id", "text", "offset", "end", "timestamp", "triggers", "candidate"]
    types = [of_key, pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), _SPAN, pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for key, start, stop, speaker, text in zip(*(c.to_pylist() for c in b.columns)):
                found = placed(text or "")
                total, said = sum(len(s) for s, _ in found) or 1, 0
                for i, (s, at) in enumerate(found):
                    said += len(s)
                    spans = spans_of(s)
                    name = f"{(speaker or '')[:3].lower()}-{start or 0:.0f}-{i}"
                    rows.append((key, speaker, i, name, s, at, at + len(s), None if start is None or stop is None else start + (stop - start) * said / total, spans, any(x["type"] not in UNDECIDABLE for x in spans)))
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    asked = blocks.select(F.col(by), F.col("start").cast("double"), F.col("stop").cast("double"), F.col("speaker").cast("string"), F.col("text").cast("string"))
    return asked.mapInArrow(run, f"`{by}` {kind}, speaker string, index int, statement_id string, text string, offset int, end int, timestamp double, triggers {SPANS}, candidate boolean")
