"""Readers of transcripts, subtitles, claims, registers and dossiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions.numbers import l2_normalise
from claimlens.functions.text import seconds_of, strip_tags
from claimlens.operators.transcripts import caption_fold

TRANSCRIPT = "source string, source_titre string, titre string, transcription struct<modele:string,famille:string,langue:string,produite_le:string,secondes_de_calcul:double>, blocs array<struct<debut:double,fin:double,texte:string,locuteur:string>>"
PRINT = "speaker_id string, display_name string, role string, centroid array<float>, sample_count int, total_seconds double, sources array<string>, enrolled_on string, human_verified boolean"


def transcripts(spark: SparkSession, path: str, family: str | None = None) -> DataFrame:
    """One row a block; fails on files without a declared family unless one is given."""
    t = spark.read.schema(TRANSCRIPT).json(path, multiLine=True)
    declared = F.coalesce(F.lit(family), F.col("transcription.famille"), F.lit(""))
    t = t.withColumn("family", F.when(declared != "", declared).otherwise(F.raise_error(F.lit("no transcription family declared"))))
    return t.select(F.input_file_name().alias("transcript_id"), "family", F.coalesce("source_titre", "titre").alias("name"), F.posexplode("blocs").alias("seq", "b")).select("transcript_id", "family", "name", "seq", F.col("b.debut").alias("start"), F.col("b.fin").alias("stop"), F.col("b.texte").alias("text"), F.col("b.locuteur").alias("speaker"))


def subtitles(spark: SparkSession, path: str) -> DataFrame:
    """WebVTT cues: (file, seq, start, stop, text), tags stripped, header lines and empty cues skipped."""
    t = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    cues = t.select("file", F.posexplode(F.split(F.replace("value", F.lit("\r"), F.lit("")), "\n\\s*\n")).alias("seq", "cue"))
    pattern = r"(?s)((?:\d+:)?\d+:\d+[.,]\d+)\s+-->\s+((?:\d+:)?\d+:\d+[.,]\d+)[^\n]*\n(.*)"
    g = lambda i: F.regexp_extract("cue", pattern, i)
    return cues.select("file", "seq", seconds_of(g(1)).alias("start"), seconds_of(g(2)).alias("stop"), strip_tags(g(3)).alias("text"), g(1).alias("__m")).filter("__m <> '' and text <> ''").drop("__m")


def subtitle_segments(spark: SparkSession, path: str) -> DataFrame:
    """WebVTT files to segments: (file, start, stop, text), rolling captions without what was already said."""
    return caption_fold(subtitles(spark, path), "file")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines without the _meta header; blank lines are skipped."""
    return _lines(spark, path, schema).select("r.*")


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(r, at): the record of each line, and a struct that orders lines by file, split and place."""
    lines = spark.read.text(path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("at"))
    r = lines.filter(F.trim("value") != "").select(F.from_json("value", f"_meta string, {schema}").alias("r"), "at")
    return r.filter("r._meta is null").select(F.col("r").dropFields("_meta").alias("r"), "at")


def verdicts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSONL verdicts; of a repeated id the last line counts, of several files the last by name, however the scan deals out its splits."""
    v = _lines(spark, path, schema)
    return v.groupBy("r.statement_id").agg(F.max_by("r", "at").alias("r")).select("r.*")


def voice_prints(spark: SparkSession, path: str) -> DataFrame:
    """Prints with their centroid scaled to length one again, as files hold it rounded; a centroid of zeros stays."""
    p = spark.read.schema(PRINT).json(path, multiLine=True).withColumn("human_verified", F.coalesce("human_verified", F.lit(False)))
    return p.withColumn("centroid", l2_normalise(F.col("centroid")).cast("array<float>"))


def primary_sources(spark: SparkSession, base: str, max_chars: int = 40_000) -> DataFrame:
    """Source texts of a base/<domain>/sources folder paired with their .meta.yaml by stem; meta without text is skipped."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select("path", "content")
    f = f.filter(F.col("path").rlike("/sources/[^/]+$")).withColumn("domain", F.regexp_extract("path", "/([^/]+)/sources/", 1)).withColumn("stem", F.regexp_extract("path", r"/([^/]+?)(?:\.meta\.yaml|\.[^./]+)$", 1))
    meta, body = f.filter(F.col("path").endswith(".meta.yaml")), f.filter(~F.col("path").endswith(".meta.yaml"))
    rank = F.regexp_extract(F.decode("m.content", "UTF-8"), r"(?m)^rang:\s*(\d+)", 1)
    return meta.alias("m").join(body.alias("b"), ["domain", "stem"]).select("domain", F.col("stem").alias("key"), F.coalesce(F.nullif(rank, F.lit("")).cast("int"), F.lit(1)).alias("rank"), F.substring(F.decode("b.content", "UTF-8"), 1, max_chars).alias("text"))


def yaml_rows(spark: SparkSession, path: str, rows, schema: str) -> DataFrame:
    """A small YAML file (glossary, panel, gold set, ranks) as a table; ``rows`` maps the document to tuples."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()[0]
    return spark.createDataFrame(rows(yaml.safe_load(text)), schema)


def dossiers(spark: SparkSession, path: str) -> DataFrame:
    """Files per dossier and section; hidden keepers and _folders are not counted."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    parts = F.split(F.regexp_extract("path", "([^/]+/[^/]+/[^/]+)$", 1), "/")
    f = f.select(parts[0].alias("slug"), parts[1].alias("section"), parts[2].alias("name"))
    return f.filter(~F.col("slug").startswith("_") & (F.col("name") != ".gitkeep")).groupBy("slug", "section").agg(F.count("*").alias("files"))
