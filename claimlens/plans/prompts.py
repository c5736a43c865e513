"""Texts that judges are given: excerpts of the stored sources, what a domain holds, definition traps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what a judge reads where no source is at hand.
NO_SOURCE = "(no primary source supplied)"
#: Letters of all excerpts of a statement together.
BUDGET = 12_000


def excerpt(share: Column) -> Column:
    """One source as a judge reads it: what it says of itself, then its text up to ``share`` letters."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    unit = F.when(said("unit") != "", F.concat(F.lit(" "), said("unit"))).otherwise("")
    lines = [
        F.concat(F.lit("--- PRIMARY SOURCE: "), F.col("source_key"), F.lit(" ---")),
        F.concat(F.lit("producer : "), said("producer"), F.lit(" (rank "), said("rank"), F.lit(")")),
        F.concat(F.lit("measure  : "), said("measure")),
        F.concat(F.lit("vintage  : "), said("vintage"), unit),
        F.concat(F.lit("url      : "), said("url")),
    ]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n\n"), F.substring(said("text"), F.lit(1), share), F.lit("\n"))


def evidence_texts(requests: DataFrame, sources: DataFrame, key: str = "statement_id", budget: int = BUDGET) -> DataFrame:
    """(key, sources, evidence): the excerpts of the sources a statement asks for, in the order asked, and how many there were.

    requests: key, pos, domain, source_key; sources: domain, source_key, producer, rank, measure, vintage, unit, url, text. Every key asked for takes
    an equal share of the budget, also one that its domain does not hold; a key asked for twice is given twice. Texts are cut to the budget before
    the join, so a long source is not carried whole. A statement whose keys are all unknown or null gets NO_SOURCE.
    """
    asked = requests.groupBy(key).agg(F.greatest(F.count("source_key"), F.lit(1)).alias("__n"))
    wanted = requests.filter("source_key is not null").select(key, "pos", "domain", "source_key")
    known = sources.select("domain", "source_key", "producer", "rank", "measure", "vintage", "unit", "url", F.substring("text", 1, budget).alias("text"))
    j = wanted.join(known, ["domain", "source_key"]).join(asked, key)
    cut = F.floor(F.lit(budget) / F.col("__n")).cast("int")
    chunks = j.select(key, F.struct("pos", "source_key", excerpt(cut).alias("e")).alias("c"))
    given = chunks.groupBy(key).agg(F.array_sort(F.collect_list("c")).alias("c"))
    out = asked.join(given, key, "left")
    return out.select(key, F.coalesce(F.size("c"), F.lit(0)).alias("sources"), F.coalesce(F.array_join("c.e", "\n"), F.lit(NO_SOURCE)).alias("evidence"))


def orientations(domains: DataFrame, sources: DataFrame) -> DataFrame:
    """(domain, line, orientation): a domain's line in the index, and its brief with the inventory of its sources by key.

    domains: domain, brief; sources: domain, source_key, measure, producer, vintage. A domain without sources has an empty inventory. The text of
    a domain holds a line for each of its sources, so it is as long as its inventory.
    """
    line = F.concat(F.lit("  - "), F.col("source_key"), F.lit(" -- "), F.col("measure"), F.lit(" ("), F.col("producer"), F.lit(", "), F.col("vintage"), F.lit(")"))
    held = sources.select("domain", F.struct("source_key", line.alias("l")).alias("s")).groupBy("domain").agg(F.array_sort(F.collect_list("s")).alias("s"))
    n = F.coalesce(F.size("s"), F.lit(0)).cast("string")
    index = F.concat(F.lit("  - "), F.col("domain"), F.lit(" ("), n, F.lit(" primary source(s))"))
    brief = F.concat(F.coalesce("brief", F.lit("")), F.lit("\n\nPrimary sources in this domain:\n"), F.coalesce(F.array_join("s.l", "\n"), F.lit("")))
    return domains.join(held, "domain", "left").select("domain", index.alias("line"), brief.alias("orientation"))


def trap_texts(traps: DataFrame, key: str) -> DataFrame:
    """(key, text): a subject that has several measures, its measures in their order, and the note if there is one. traps: key, subject, measures, note."""
    measures = F.array_join(F.transform("measures", lambda m: F.concat(F.lit("    - "), m)), "\n")
    note = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit("    -> "), F.col("note")))
    return traps.select(key, F.concat_ws("\n", F.concat(F.lit("  "), F.col("subject"), F.lit(":")), measures, note).alias("text"))
