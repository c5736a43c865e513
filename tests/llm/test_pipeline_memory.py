"""Texts reach the Python workers of every stage in small batches, in the steps that run after a stage returns too."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SIZE = "spark.sql.execution.arrow.maxRecordsPerBatch"


def largest_batch(spark):
    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)])], ["n"])

    return spark.range(0, 12000, 1, 1).mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_batches_of_a_stage_are_small(spark, tmp_path, name, stage):
    before = spark.conf.get(SIZE)
    try:
        spark.conf.set(SIZE, 10000)
        spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        stage(spark, spark.createDataFrame([(1, "one text of a few words")], "doc_id long, text string"), str(tmp_path))
        assert largest_batch(spark) == 1000
    finally:
        spark.conf.set(SIZE, before)


def test_smaller_batches_of_the_session_stay(spark):
    before = spark.conf.get(SIZE)
    try:
        spark.conf.set(SIZE, 300)
        corpus_pipeline.ready(spark)
        assert spark.conf.get(SIZE) == "300"
    finally:
        spark.conf.set(SIZE, before)
