"""Sinks."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.functions.text import review_slug
from claimlens.operators.aggregates import audit_occurrences


def statements_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def batch_jsonl(df: DataFrame, path: str, meta: dict[str, str], brief: str = "brief") -> None:
    """A folder of lines, one a statement that has a brief, and a file with the _meta line that comes first by name.

    The lines are written by all tasks; the header follows when they are in place, so a folder with a header is whole.
    """
    body = df.filter(F.coalesce(F.col(brief), F.lit("")) != "").select(F.to_json(F.struct(*df.columns)).alias("value"))
    body.write.mode("overwrite").text(path)
    state_file(df, f"{path.rstrip('/')}/header.jsonl", json.dumps({"_meta": meta}, ensure_ascii=False) + "\n")


def review_queue(findings: DataFrame, path: str) -> None:
    """A folder per speaker, most frequent findings first."""
    findings.withColumn("slug", review_slug(F.col("speaker"))).repartition("slug").sortWithinPartitions("slug", F.desc("occurrences")).write.mode("overwrite").partitionBy("slug").json(path)


def registry(prints: DataFrame, path: str) -> None:
    prints.withColumn("id", F.col("speaker_id")).write.mode("overwrite").partitionBy("id").json(path)


def transcript_json(blocks: DataFrame, path: str) -> None:
    """Blocks of a transcript as one nested row."""
    b = F.array_sort(F.collect_list(F.struct("seq", F.col("start").alias("debut"), F.col("stop").alias("fin"), F.col("text").alias("texte"), F.col("speaker").alias("locuteur"))))
    t = blocks.groupBy("transcript_id", "family").agg(b.alias("b"))
    t.select(F.col("transcript_id").alias("source"), F.struct(F.col("family").alias("famille")).alias("transcription"), F.transform("b", lambda x: x.dropFields("seq")).alias("blocs")).write.mode("overwrite").json(path)


def ledger_audit(occurrences: DataFrame, key: str, path: str) -> None:
    """The occurrences of every claim met more than once, a line each, claims together."""
    audit_occurrences(occurrences, key).sort(key, "statement_id").write.mode("overwrite").json(path)


def report_json(report: DataFrame, path: str) -> None:
    """A bench, evaluation or coverage report: some rows of totals, in one file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def state_file(df: DataFrame, path: str, text: str) -> None:
    """A small file that readers see whole or not at all: written beside its place, then renamed over it."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(spark._jsc.sc().hadoopConfiguration())
    target = context.makeQualified(hadoop.Path(path))
    beside = hadoop.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    out = beside.getFileSystem(spark._jsc.sc().hadoopConfiguration()).create(beside, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, target, options)


def confirmation_yaml(clusters: DataFrame, path: str, header: str = "") -> None:
    """The clusters a person is to confirm, some hundreds of a debate, as one YAML file that replaces the former at once."""
    import yaml

    rows = [json.loads(r) for r in clusters.toJSON().toLocalIterator()]
    state_file(clusters, path, header + yaml.safe_dump({"grappes": rows}, allow_unicode=True, sort_keys=False))
