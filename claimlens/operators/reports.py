"""Reports: seconds by speaker and reason, votes, cluster filters, metrics, dossiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.functions.text import review_slug
from claimlens.operators.folds import spaced
from claimlens.operators.guardrails import promotable
from claimlens.operators.ranking import ranked
from claimlens.operators.windows import islands

# What a voice cluster needs to keep its name, usable clips for a confirmation, recordings for a voice.
NAME_SHARE, NAME_MENTIONS, COHESION = 0.60, 3, 0.60
CLIPS, RECORDINGS = 3, 3


def ranked_counts(rows: DataFrame, by: str, seq: str) -> DataFrame:
    """(by, n, place): counts from the largest; equal ones as first seen."""
    n = rows.groupBy(by).agg(F.count("*").alias("n"), F.min(seq).alias("__first"))
    return ranked(n, [F.desc("n"), F.col("__first")], "place").drop("__first")


def speaker_seconds(blocks: DataFrame) -> DataFrame:
    """(speaker, seconds, share) of all speech."""
    s = blocks.groupBy("speaker").agg(F.sum(F.col("stop") - F.col("start")).alias("s"))
    return s.select("speaker", F.round("s", 1).alias("seconds"), F.round(F.try_divide(F.col("s"), F.sum("s").over(Window.partitionBy())), 3).alias("share"))


def abstentions(decisions: DataFrame) -> DataFrame:
    """(reason, seconds): what was not attributed, by the reason up to its bracket. decisions: accepted, reason, start, stop."""
    why = F.trim(F.substring_index("reason", "(", 1))
    return decisions.filter(~F.col("accepted")).groupBy(why.alias("reason")).agg(F.round(F.sum(F.col("stop") - F.col("start")), 1).alias("seconds"))


def attributed(decisions: DataFrame) -> DataFrame:
    """(total_seconds, attributed_seconds, attributed_share)."""
    length = F.col("stop") - F.col("start")
    total, ours = F.coalesce(F.sum(length), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("accepted"), length)), F.lit(0.0))
    return decisions.agg(F.round(total, 1).alias("total_seconds"), F.round(ours, 1).alias("attributed_seconds"), F.round(F.try_divide(ours, F.greatest(total, F.lit(1e-6))), 3).alias("attributed_share"))


def evaluation(results: DataFrame) -> DataFrame:
    """Coverage before accuracy. results: expected, given, robustness ("mecanique" where the label needs no bar)."""
    g, e = F.col("given"), F.col("expected")
    mechanical = F.col("robustness") == "mecanique"
    return results.agg(
        F.count("*").alias("judged"),
        F.count_if(g == "unverified").alias("abstentions"),
        F.count_if(e == "unverified").alias("abstentions_expected"),
        F.count_if(mechanical).alias("mechanical"),
        F.count_if(mechanical & (g == e)).alias("mechanical_right"),
        F.count_if((g == "false") & (e != "false")).alias("false_reds"),
    )


def verdict_maps(statements: DataFrame) -> DataFrame:
    """One row: (verdicts, categories), maps of counts; statements without either are not counted there."""
    count = lambda c: statements.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("k")).agg(F.count("*").alias("n"))
    to_map = lambda c, name: count(c).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))
    return to_map("verdict", "verdicts").crossJoin(to_map("category", "categories"))  # one row each


def tally(scores: DataFrame, by: str, score: str, values: list[str]) -> DataFrame:
    """Scores by source, a column each."""
    return scores.groupBy(by).pivot(score, values).count().na.fill(0)


def name_votes(votes: DataFrame, apart: float = 30.0) -> DataFrame:
    """(cluster, id, mentions, share): the person most often named for a cluster; mentions closer than ``apart`` are one occasion.

    votes: cluster, id, t. Ties go to the one named first.
    """
    n = spaced(votes, ["cluster", "id"], "t", apart)
    best = n.groupBy("cluster").agg(F.max_by(F.struct("id", "n"), F.struct("n", -F.col("first"), "id")).alias("b"), F.sum("n").alias("total"))
    return best.select("cluster", F.col("b.id").alias("id"), F.col("b.n").alias("mentions"), (F.col("b.n") / F.col("total")).alias("share"))


def named_clusters(clusters: DataFrame) -> DataFrame:
    """Clusters sure of their name; of a name on two clusters neither is kept. clusters: cluster, id, share, mentions, cohesion."""
    sure = clusters.filter((F.col("share") >= NAME_SHARE) & (F.col("mentions") >= NAME_MENTIONS) & (F.col("cohesion") >= COHESION))
    once = sure.groupBy("id").agg(F.count("*").alias("__n")).filter("__n = 1").select("id")
    return sure.join(once, "id", "left_semi")


def confirmation(clips: DataFrame, by: str) -> DataFrame:
    """(by, confirmed): the one name all usable clips give, if there are three or more; ``plusieurs`` where they differ; else empty.

    clips: by, usable, who (null where nobody is named). Answers of unusable clips do not count.
    """
    usable, answer = F.count_if("usable"), F.when(F.col("usable"), F.nullif(F.col("who"), F.lit("")))
    g = clips.groupBy(by).agg(usable.alias("u"), F.count(answer).alias("a"), F.min(answer).alias("low"), F.max(answer).alias("high"))
    said = F.when(F.col("low") != F.col("high"), "plusieurs").when((F.col("a") == F.col("u")) & (F.col("u") >= CLIPS), F.col("low")).otherwise("")
    return g.select(by, F.coalesce(said, F.lit("")).alias("confirmed"))


def dossier_report(files: DataFrame, by: str, sections: list[str], voice: str, programme: str) -> DataFrame:
    """Files per section, total, place by total, the median total, and what the dossier is enough for. files: by, section."""
    p = files.groupBy(by).pivot("section", sections).count().na.fill(0)
    total = sum((F.col(s) for s in sections[1:]), F.col(sections[0]))
    p = p.withColumn("total", total).withColumn("voice_enrolable", F.col(voice) >= RECORDINGS).withColumn("coherence_available", F.col(programme) > 0)
    placed = ranked(p, [F.desc("total"), F.col(by)], "place")
    n = placed.count()
    median = placed.filter(F.col("place").between((n + 1) // 2, n // 2 + 1)).agg(F.avg("total")).first()[0]
    return placed.withColumn("median", F.lit(median).cast("double"))


def transcript_size(blocks: DataFrame, by: str, compute_seconds: Column | None = None) -> DataFrame:
    """(by, blocks, minutes, words, speed): speed is minutes of speech per minute of computing, null without its seconds."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    g = blocks.groupBy(by).agg(F.count("*").alias("blocks"), F.round(F.max("stop") / 60, 2).alias("minutes"), F.sum(words).cast("long").alias("words"), F.max("stop").alias("s"))
    return g.withColumn("speed", F.try_divide(F.col("s"), compute_seconds) if compute_seconds is not None else F.lit(None).cast("double")).drop("s")


def pair_classes(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Adds class to (left_id, right_id): agree (same figure, same scale or one without), disagree, left_alone, right_alone.

    left, right: id, figure, scale.
    """
    a, b = (s.select(F.col("id").alias(f"{n}_id"), F.col("figure").alias(f"{n}_figure"), F.col("scale").alias(f"{n}_scale")) for s, n in ((left, "left"), (right, "right")))
    j = pairs.join(a, "left_id", "left").join(b, "right_id", "left")
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    x, y = F.col("left_scale"), F.col("right_scale")
    same = F.col("left_figure").eqNullSafe(F.col("right_figure")) & (x.eqNullSafe(y) | empty(x) | empty(y))
    return j.select("left_id", "right_id", F.when(F.col("right_id").isNull(), "left_alone").when(F.col("left_id").isNull(), "right_alone").when(same, "agree").otherwise("disagree").alias("class"))


def audit_records(statements: DataFrame, corpus_version: str) -> DataFrame:
    """One row per verdict and source it rests on; verdicts without a source have one row with none. sources: array of structs."""
    return statements.select(F.lit(corpus_version).alias("corpus_version"), "statement_id", "verdict", "confidence", F.explode_outer("sources").alias("s")).select("corpus_version", "statement_id", "verdict", "confidence", F.col("s.domain").alias("domain"), F.col("s.rank").alias("rank"), F.col("s.quote").alias("quote"))


def first_examples(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; ranks above n are dropped before the exchange."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def only_in_either(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """(side, on): what one side has and the other lacks, each once."""
    a, b = left.select(on), right.select(on)
    return a.subtract(b).select(F.lit("left").alias("side"), on).union(b.subtract(a).select(F.lit("right").alias("side"), on))


def page_blocks(statements: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by, island, speaker, withdrawn, start, timecode, n): runs of one speaker; withdrawn if any statement is; the timecode is the last one's."""
    s = islands(statements, by, order, F.col("speaker"))
    at = F.struct(*order)
    return s.groupBy(*by, "island").agg(F.first("speaker").alias("speaker"), F.bool_or(F.coalesce("withdrawn", F.lit(False))).alias("withdrawn"), F.min_by("timestamp", at).alias("start"), F.max_by("timestamp", at).alias("timecode"), F.count("*").alias("n"))


def ledger_counters(status: DataFrame) -> DataFrame:
    """One row: claims, those met more than once, corroborated and conflicted ones. status: claim_key, occurrences, status."""
    return status.agg(F.count("*").alias("claims"), F.count_if(F.col("occurrences") > 1).alias("repeated"), F.count_if(F.col("status") == "corroborated").alias("corroborated"), F.count_if(F.col("status") == "conflicted").alias("conflicted"))


def routing_line(terms: Column, domains: Column, keys: Column, trap: Column) -> Column:
    """One line a routing decision, for later audit."""
    some = lambda c: F.when(F.size(c) > 0, F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))).otherwise("-")
    return F.concat(F.lit("terms="), some(terms), F.lit(" domains="), some(domains), F.lit(" sources="), some(keys), F.when(trap, " TRAP").otherwise(""))


def corroboration_note(status: Column, witness: Column, missing: Column, unanchored: Column, heard: Column) -> Column:
    """One sentence on what the other recordings say of a statement's figures. missing, unanchored, heard: arrays of figures as heard."""
    listed = lambda c: F.array_join(c, ", ")
    drifted = (F.size(unanchored) > 0) & (F.size(unanchored) == F.size(missing))
    instead = F.coalesce(F.nullif(listed(F.slice(heard, 1, 3)), F.lit("")), F.lit("something else"))
    return (
        F.when(status == "confirmed", F.format_string("confirmed by an independent transcription (%s)", witness))
        .when(drifted, F.format_string("%s is heard by %s among other words: not corroborated", listed(unanchored), witness))
        .when(status == "divergent", F.format_string("transcriptions differ: %s here, %s in %s", listed(missing), instead, witness))
        .when(status == "absent", F.format_string("%s reports no figure here: not judged", witness))
        .when(status == "no_witness", "only one transcription: no independent source")
        .otherwise("no figure to corroborate")
    )


def findings(statements: DataFrame, key: str, order: str) -> DataFrame:
    """One row a claim worth keeping: speaker, slug, key, statement_id, verdict and confidence of its first occurrence, and how many there were.

    statements: speaker, statement_id, key, order, verdict, confidence, sources, withdrawn; only promotable ones count. Any later speaker of the
    same claim adds to the first one's finding.
    """
    first = F.min_by(F.struct("speaker", "statement_id", "verdict", "confidence"), F.struct(order, "statement_id"))
    g = promotable(statements).groupBy(key).agg(first.alias("f"), F.count("*").alias("occurrences"))
    return g.select(F.col("f.speaker").alias("speaker"), review_slug(F.col("f.speaker")).alias("slug"), key, "f.statement_id", "f.verdict", "f.confidence", "occurrences")
