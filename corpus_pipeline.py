"""Corpus pipeline: quality, exact duplicates, near duplicates, personal data, packing.

Every stage but the last returns the columns of documents; each works on what the stage before kept.

Cases: null text counts as empty and, having no words, goes in the first stage, as does an empty one; very long texts are worked on
whole; of repeated rows one stays, of equal texts the one with the largest id, of near copies the one with the smallest; rows of null id
come last and are judged like others; extra columns pass through to the packing stage; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens.llm import exact_dedup, packing, pii, quality, shingles
from claimlens.llm.rows import text_key
from claimlens.storage import discarding, materialise, release, ship_package, table


#: Rows of an Arrow batch: whole texts in batches of Spark's 10000 rows stay in the memory of the Python workers, which are kept from stage to stage.
ROWS_A_BATCH = 1000


def ready(spark):
    """Ships the package; a stage's last step runs after it returns, so the batches stay small in this session."""
    ship_package(spark)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(size)) <= ROWS_A_BATCH:
        spark.conf.set(size, ROWS_A_BATCH)


def good_quality(spark, docs, sf_dir):
    ready(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_duplicates(spark, docs, sf_dir):
    ready(spark)
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark, docs, sf_dir):
    """Fingerprints by anchors, then bands, the shingle sets confirming: one document of each group of similarity 0.8 or more stays, the one with the smallest id."""
    ready(spark)
    classes = materialise(shingles.near_duplicates(docs), "classes")
    # null ids come last; different texts may share an id: of those in one class the smallest key stays
    stay = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))["text_key"].alias("__cl_key"))
    rows = docs.withColumn("__cl_key", text_key("doc_id", "text"))
    return rows.join(stay.select("__cl_key"), "__cl_key", "left_semi").select(docs.columns)


def personal_data(spark, docs, sf_dir):
    ready(spark)
    return pii.sanitise(docs)


def packed(spark, docs, sf_dir):
    ready(spark)
    return packing.pack(docs)


STAGES = [("quality", good_quality), ("exact duplicates", exact_duplicates), ("near duplicates", near_duplicates), ("personal data", personal_data), ("packing", packed)]

#: SQL cannot express the stages; tests/llm hold run() and its stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with discarding() as scratch:
            kept = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            scratch.remove(kept)
        if i:
            release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
