"""Slices, windows, filters and look-ups on the way from a transcript to statements worth checking."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.functions.text import strip_accents
from claimlens.operators.joins import interval_pairs

# The roles whose speech is analysed, the least seconds of a window and of a segment, the length of a spoken extract.
ANALYSED_ROLES = ("candidate",)
WINDOW_SECONDS, SEGMENT_SECONDS, EXTRACT = 2.0, 3.0, 400


def time_slice(blocks: DataFrame, lo: float, hi: float) -> DataFrame:
    """Blocks that reach into [lo, hi): half-open, so neighbouring slices share no block that only touches."""
    return blocks.filter((F.col("stop") > lo) & (F.col("start") < hi))


def text_within(blocks: DataFrame, windows: DataFrame, by: list[str], key: str, closed: bool = True, limit: int | None = None, width: float = 60.0) -> DataFrame:
    """(key, text): what is said in each window of its transcript, in order; empty where nothing is.

    blocks: by, seq, start, stop, text; windows: key, by, lo, hi. closed: touching blocks count; limit: cut there, with an ellipsis.
    """
    b = blocks.select(*by, "seq", F.col("start").alias("r_start"), F.col("stop").alias("r_stop"), "text")
    w = windows.select(key, *by, F.col("lo").alias("l_start"), F.col("hi").alias("l_stop"))
    said = interval_pairs(w, b, width, by, closed).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("s"))
    joined = F.array_join(F.col("s.text"), " ")
    if limit is not None:
        joined = F.trim(joined)
        joined = F.when(F.length(joined) > limit, F.concat(F.substring(joined, 1, limit), F.lit("…"))).otherwise(joined)
    return windows.select(key).join(said.select(key, joined.alias("text")), key, "left").withColumn("text", F.coalesce("text", F.lit("")))


def analysed(blocks: DataFrame, roles: tuple[str, ...] = ANALYSED_ROLES) -> DataFrame:
    """Adds identified and analysed: a speaker is known, and of a listed role. Unknown roles are never analysed."""
    known = F.col("speaker_id").isNotNull()
    return blocks.withColumn("identified", known).withColumn("analysed", known & F.coalesce(F.col("role").isin(*roles), F.lit(False)))


def usable_windows(windows: DataFrame, length: Column | float) -> DataFrame:
    """Windows of two seconds or more, also after the audio's end has cut them."""
    end = F.least(F.col("stop"), length if isinstance(length, Column) else F.lit(length))
    return windows.filter((F.col("stop") - F.col("start") >= WINDOW_SECONDS) & (end - F.col("start") >= WINDOW_SECONDS))


def enrolment_segments(segments: DataFrame) -> DataFrame:
    return segments.filter(F.col("stop") - F.col("start") >= SEGMENT_SECONDS)


def segment_windows(segments: DataFrame, windows: DataFrame, key: str, value: str) -> DataFrame:
    """Every segment with its windows in order; an empty list where it has none. windows: key, seq, value."""
    w = windows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col(value).alias("v")))), lambda x: x["v"]).alias("windows"))
    kind = windows.schema[value].dataType.simpleString()
    return segments.join(w, key, "left").withColumn("windows", F.coalesce("windows", F.array().cast(f"array<{kind}>")))


def lookup(rows: DataFrame, table: DataFrame, on: list[str], value: str, default: Column) -> DataFrame:
    """The table's value of each row's keys, else the default. Several keys make a composite one. table: one row a key."""
    return rows.join(table.select(*on, F.col(value).alias("__v")), on, "left").withColumn(value, F.coalesce("__v", default)).drop("__v")


def route(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """Keys are kept where a source of the domain has them, in their order; without any the statement abstains.

    requests: statement_id, domain, keys, verdict, confidence; sources: domain, source_key.
    """
    asked = requests.select("statement_id", "domain", F.posexplode("keys").alias("pos", "source_key"))
    kept = asked.join(sources.select("domain", "source_key").distinct(), ["domain", "source_key"], "left_semi").groupBy("statement_id").agg(F.array_sort(F.collect_list(F.struct("pos", "source_key"))).alias("k"))
    out = requests.drop("keys").join(kept, "statement_id", "left")
    none = F.col("k").isNull()
    return out.withColumns({"keys": F.coalesce(F.col("k.source_key"), F.array().cast("array<string>")), "verdict": F.when(none, "unverified").otherwise(F.col("verdict")), "confidence": F.when(none, 0.0).otherwise(F.col("confidence"))}).drop("k")


def brief_gate(briefs: DataFrame) -> DataFrame:
    """A statement whose brief names no source is unverified at once."""
    return briefs.withColumn("verdict", F.when(F.size("source_keys") <= 0, "unverified").otherwise(F.col("verdict")))


def page_filter(statements: DataFrame, verdicts: list[str], needle: str = "") -> DataFrame:
    """What the page shows: any of the chosen verdicts (none chosen: all) whose text holds the search, in any case."""
    shown = F.col("verdict").isin(*verdicts) if verdicts else F.lit(True)
    return statements.filter(shown & F.lower("text").contains(needle.lower()))


def first_statements(statements: DataFrame, order: list[str], n: int) -> DataFrame:
    return statements.orderBy(*order).limit(n)


def decidable(items: DataFrame) -> DataFrame:
    """Items whose label the bars can reproduce and that have both values. items: label, gap."""
    return items.filter(F.col("label").isin("exact", "approximate", "false") & F.col("gap").isNotNull())


def reachable(items: DataFrame) -> DataFrame:
    """(judged, unreachable): known unreachable items are left out of judging but counted."""
    out = F.coalesce(F.col("reachable") == "non", F.lit(False))
    return items.agg(F.count_if(~out).alias("judged"), F.count_if(out).alias("unreachable"))


def caption_fold(cues: DataFrame, by: str, longest: int = 25) -> DataFrame:
    """(by, start, stop, text): rolling captions without what the segment before already said; a cue wholly said before only extends it.

    cues: by, seq, start, stop, text. A fold over what was last emitted, so one transcript is one task.
    """
    kind = cues.schema[by].dataType.simpleString()

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for _, start, stop, text in f.sort_values("seq")[["seq", "start", "stop", "text"]].itertuples(index=False):
            words = " ".join((text or "").split()).split(" ")
            if words == [""]:
                continue
            if out:
                tail, low = out[-1][2].lower().split(), [w.lower() for w in words]
                words = words[next((k for k in range(min(len(tail), len(low), longest), 0, -1) if tail[-k:] == low[:k]), 0) :]
                if not words:
                    out[-1][1] = stop
                    continue
            out.append([start, stop, " ".join(words)])
        return pd.DataFrame([(f[by].iloc[0], *x) for x in out], columns=[by, "start", "stop", "text"])

    return cues.select(by, "seq", "start", "stop", "text").groupBy(by).applyInPandas(fold, f"{by} {kind}, start double, stop double, text string")


def mentions(blocks: DataFrame, panel: list[tuple[str, str]], least: int = 4) -> DataFrame:
    """Adds id: one row per person named in a block, by any form of the surname of ``least`` letters or more.

    panel: (id, name) of the people on stage, a manifest of some dozens, so the forms are literals of one expression and nothing is joined.
    """
    from claimlens.functions.text import surname_forms_of

    flat = strip_accents(F.lower("text"))
    hit = lambda name: F.exists(F.array(*(F.lit(f) for f in surname_forms_of(name, least))), lambda f: flat.contains(f)) if surname_forms_of(name, least) else F.lit(False)
    found = F.array_compact(F.array(*(F.when(hit(name), i) for i, name in panel)))
    return blocks.withColumn("id", F.explode(found))


def person_of(answers: DataFrame, panel: DataFrame, name: str) -> DataFrame:
    """Adds person: the panel id an answer names, by id in any case or by name without accents or case; else the answer itself.

    panel: id, nom. Two equi-joins, so neither side pairs up with all of the other; the id wins.
    """
    fold = lambda c: strip_accents(F.lower(F.trim(c)))
    ids = panel.groupBy(F.lower("id").alias("__i")).agg(F.min("id").alias("__by_id"))
    names = panel.groupBy(fold(F.col("nom")).alias("__n")).agg(F.min("id").alias("__by_name"))
    j = answers.withColumns({"__i": F.lower(F.trim(F.col(name))), "__n": fold(F.col(name))}).join(ids, "__i", "left").join(names, "__n", "left")
    return j.withColumn("person", F.coalesce("__by_id", "__by_name", F.col(name))).drop("__i", "__n", "__by_id", "__by_name")


def not_enrolled(clusters: DataFrame, enrolled: DataFrame) -> DataFrame:
    """Clusters whose person has no print from pieces yet."""
    return clusters.join(enrolled.select("person").distinct(), "person", "left_anti")
