"""Streams over the files of a table, run until all that is there has been read.

A micro-batch is written under its number and overwrites what a failed attempt left, so after a restart from the checkpoint every
batch is there once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.storage import scratch_path

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of its own whose stateful streams use the RocksDB store."""
    child = spark.newSession()
    for k, v in (("spark.sql.streaming.stateStore.providerClass", STATE_STORE), ("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone")), ("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))):
        child.conf.set(k, v)
    return child


def table_stream(spark: SparkSession, folder: str, name: str, files: int = 8) -> DataFrame:
    """The rows of a table as a stream, at most ``files`` files a micro-batch."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # as a pattern, since the source takes a folder or a pattern but no single file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/{name}.parque[t]")


def drained(stream: DataFrame, target: str, checkpoint: str, mode: str = "append", reader: SparkSession | None = None) -> DataFrame:
    """Run the stream over all files there are, then give what it wrote, with the number of the micro-batch as ``batch``.

    Called again with the same folders it goes on where the checkpoint stands.
    """
    spark = stream.sparkSession

    def keep(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/batch={n}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    out, path = reader or spark, spark._jvm.org.apache.hadoop.fs.Path(target)
    if not path.getFileSystem(spark._jsc.sc().hadoopConfiguration()).exists(path):  # no file, no batch
        return out.createDataFrame([], stream.schema).withColumn("batch", F.lit(0).cast("long"))
    return out.read.schema(stream.schema.add("batch", "long")).parquet(target)


def run_table(spark: SparkSession, folder: str, name: str, plan, mode: str = "append", files: int = 8) -> DataFrame:
    """``plan`` over the stream of a table, drained into scratch folders of this application."""
    stream = plan(table_stream(stream_session(spark), folder, name, files))
    return drained(stream, scratch_path(spark, f"stream-{name}"), scratch_path(spark, f"checkpoint-{name}"), mode, spark)
