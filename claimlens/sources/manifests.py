"""Small hand-kept files as tables: ranks, glossary, panel, gold set, dossiers, listening states; and tables kept for reuse.

A manifest is one file that people write, so it is read on the driver; folders of dossiers are read by the executors.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions.text import claim_key

# Keys of the rank file and the rank each stands for; speech sources have none.
RANK_KEYS = {"rang1": 1, "rang2": 2, "rang3": 3, "rang_parole": None}

# Lists of a dossier and what they hold; of one claim in both the later kind counts.
LEADS = {"chiffres_recurrents": "recurring_figure", "erreurs_recurrentes": "recurring_error"}


def _document(spark: SparkSession, path: str):
    import yaml

    text = spark.read.text(path, wholetext=True).first()  # no row for an empty file
    return (yaml.safe_load(text[0]) if text else None) or {}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.sc().hadoopConfiguration()).exists(p)


def rank_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(list, rank, domain), one row a listed domain."""
    doc = _document(spark, path)
    return spark.createDataFrame([(k, r, d) for k, r in RANK_KEYS.items() for d in (doc.get(k) or {}).get("domaines") or []], "list string, rank int, domain string")


def fact_check_domains(ranks: DataFrame) -> DataFrame:
    """Domains of ranks 1 and 2, each once, sorted; rank 3 repeats the verdicts of others and speech sources are no evidence."""
    return ranks.filter("rank = 1").select("domain").union(ranks.filter("rank = 2").select("domain")).distinct().orderBy("domain")


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """(term, label, warning, measure, measure_label, definition, producer, source, unit): a row a measure; a term without any has one of nulls."""
    rows = []
    for term, e in (_document(spark, path).get("termes") or {}).items():
        for m in e.get("mesures") or [{}]:
            text = [m.get(k) for k in ("cle", "libelle", "definition", "producteur", "source", "unite")]
            rows.append((term, e.get("libelle") or term, (e.get("alerte") or "").strip(), *(x.strip() if isinstance(x, str) else x for x in text)))
    return spark.createDataFrame(rows, "term string, label string, warning string, measure string, measure_label string, definition string, producer string, source string, unit string")


def trigger_forms(terms: DataFrame, forms: DataFrame) -> DataFrame:
    """(term, form): the forms that call a term; a term without forms calls itself."""
    return terms.select("term").distinct().join(forms, "term", "left").withColumn("form", F.coalesce("form", "term"))


def panel(spark: SparkSession, path: str | None) -> tuple[DataFrame, float]:
    """((id, nom, role, analyse), second where analysis begins). A missing file is an empty panel from second 0."""
    doc = _document(spark, path) if path and _exists(spark, path) else {}
    rows = [(p.get("id"), p.get("nom"), p.get("role"), bool(p.get("analyse"))) for p in doc.get("intervenants") or []]
    return spark.createDataFrame(rows, "id string, nom string, role string, analyse boolean"), float(doc.get("analyse_debut_s") or 0.0)


def analysed_speakers(people: DataFrame) -> DataFrame:
    return people.filter("analyse").select("nom").distinct()


def gold_set(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The items of a gold file, by the columns of ``schema``; fields an item lacks are null."""
    items = [(json.dumps(x, default=str),) for x in _document(spark, path)["items"]]
    return spark.createDataFrame(items, "value string").select(F.from_json("value", schema).alias("r")).select("r.*")


def dossier_leads(spark: SparkSession, path: str) -> DataFrame:
    """(slug, claim_key, kind, entry): recurring figures and errors of dossiers as leads; a file that does not parse has none.

    entry: the record as JSON. Of one claim noted more than once an error goes before a figure, then the last entry counts.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for f in frames:
            out = []
            for name, content in zip(f["path"], f["content"]):
                try:
                    doc = yaml.safe_load(content.decode("utf-8"))
                except (yaml.YAMLError, UnicodeDecodeError):
                    continue
                if not isinstance(doc, dict):
                    continue
                entries = [(k, e) for key, k in LEADS.items() for e in doc.get(key) or [] if e.get("enonce_type")]
                out += [(os.path.splitext(os.path.basename(name))[0], i, e["enonce_type"], k, json.dumps(e, ensure_ascii=False, default=str)) for i, (k, e) in enumerate(entries)]
            yield pd.DataFrame(out, columns=["slug", "seq", "text", "kind", "entry"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.yaml").load(path).select("path", "content")
    rows = files.mapInPandas(parse, "slug string, seq int, text string, kind string, entry string").withColumn("claim_key", claim_key(F.col("text")))
    return rows.groupBy("slug", "claim_key").agg(F.max_by(F.struct("kind", "entry"), "seq").alias("r")).select("slug", "claim_key", "r.*")


ANSWER = "struct<inutilisable:string,segments:array<struct<a:double,b:double,who:string,bad:string>>>"


def listening_state(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, clip, unusable, segments) of listening files, whether the state is wrapped in ``etat`` or bare; keys are cluster:clip."""
    raw = spark.read.text(path, wholetext=True)
    state = F.coalesce(F.get_json_object("value", "$.etat"), F.col("value"))
    rows = raw.select(F.explode(F.from_json(state, "map<string,string>")).alias("k", "v")).filter(F.col("k").rlike(r"^\d+:\d+$"))
    at, answer = F.split("k", ":"), F.from_json("v", ANSWER)
    return rows.select(at[0].cast("int").alias("cluster"), at[1].cast("int").alias("clip"), answer.alias("a")).select("cluster", "clip", F.nullif("a.inutilisable", F.lit("")).alias("unusable"), "a.segments")


def kept(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table of vectors or passes made once: read where a finished one lies, else computed and written there."""
    if not _exists(spark, path.rstrip("/") + "/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def video_id(url: Column) -> Column:
    """The eleven letters that name a video in its address; null if none."""
    return F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?:v=|youtu\.be/|/embed/|/live/)([A-Za-z0-9_-]{11})", 1), F.lit(""))
