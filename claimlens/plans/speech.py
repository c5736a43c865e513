"""Captions and speaking turns made into the blocks that are analysed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.operators.joins import best_overlap
from claimlens.operators.transcripts import analysed
from claimlens.operators.windows import islands

UNKNOWN, NO_TURN = "unknown", "no speaking turn covers this passage"


def attributed_blocks(captions: DataFrame, turns: DataFrame, by: str, min_share: float = 0.5) -> DataFrame:
    """Captions take the speaker of the turn that holds most of them; neighbours of one speaker and role are joined into a block.

    captions: by, seq, l_start, l_stop, text; turns: by, turn_seq, r_start, r_stop, accepted, speaker, role, similarity, reason. A caption without a
    turn of ``min_share`` or with a turn that was not accepted is nobody's. Returns by, block, start, stop, speaker, role, text, similarity (the
    highest), identified, analysed, note (the first caption's), captions. Null or blank texts add nothing to a block's text but its time.
    """
    c = captions.select(by, "seq", "l_start", "l_stop", "text").withColumn("caption_id", F.struct(by, "seq"))
    placed = best_overlap(c, turns.select(by, "turn_seq", "r_start", "r_stop"), "caption_id", min_share=min_share, by=[by])
    j = placed.drop("share", "caption_id").join(turns.select(by, "turn_seq", "accepted", "speaker", "role", "similarity", "reason"), [by, "turn_seq"], "left")
    known = F.coalesce("accepted", F.lit(False))
    j = j.withColumns({
        "speaker": F.when(known, F.col("speaker")).otherwise(UNKNOWN),
        "role": F.when(known, F.col("role")).otherwise(""),
        "speaker_id": F.when(known, F.col("speaker")),
        "similarity": F.coalesce("similarity", F.lit(0.0)),
        "note": F.when(known, "").otherwise(F.coalesce("reason", F.lit(NO_TURN))),
    })
    j = islands(analysed(j), [by], ["seq"], F.struct("speaker", "role"))
    said = F.array_sort(F.collect_list(F.struct("seq", F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+$", "").alias("t"))))
    parts = F.filter(F.transform(said, lambda x: x["t"]), lambda t: t != "")
    first = lambda name: F.min_by(name, "seq").alias(name)
    blocks = j.groupBy(by, F.col("island").alias("block")).agg(
        F.min_by("l_start", "seq").alias("start"),
        F.max_by("l_stop", "seq").alias("stop"),
        *(first(x) for x in ("speaker", "role", "identified", "analysed", "note")),
        F.regexp_replace(F.array_join(parts, " "), r"^\s+", "").alias("text"),
        F.max("similarity").alias("similarity"),
        F.count("*").alias("captions"),
    )
    return blocks
