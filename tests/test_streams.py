"""Streams over tables: places of statements, claims that end with their time, recovery from a checkpoint."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from claimlens.plans.statements import placed, statements
from claimlens.streaming import ledger as L
from claimlens.streaming.tables import drained, stream_session, table_stream


def test_places():
    text = "  Un mot. Deux !\n Été… trois. \tFin"
    assert [text[at : at + len(s)] for s, at in placed(text)] == [s for s, _ in placed(text)] == ["Un mot.", "Deux !", "Été… trois.", "Fin"]
    assert placed("") == placed(" \n ") == []


def test_statements_of_blocks(spark):
    rows = [(1, 10.0, 20.0, "Ana", "Oui. Non, 45 % des gens."), (2, 0.0, 1.0, None, None), (None, None, None, "Bo", "Seul"), (1, 10.0, 20.0, "Ana", "Oui. Non, 45 % des gens.")]
    got = statements(spark.createDataFrame(rows, "k long, start double, stop double, speaker string, text string"), "k").orderBy("index").collect()
    assert len(got) == 5
    first, second = [r for r in got if r["k"] == 1][0], [r for r in got if r["k"] == 1][-1]
    assert (first["statement_id"], first["offset"], first["end"], first["candidate"]) == ("ana-10-0", 0, 4, False)
    assert (second["statement_id"], second["offset"], second["timestamp"], second["candidate"]) == ("ana-10-1", 5, 20.0, True)
    assert next(r for r in got if r["k"] is None)["timestamp"] is None


SCHEMA = "claim_key string, statement_id string, seq long, at timestamp, verdict string, confidence double"
T0 = dt.datetime(2024, 1, 1)
HOUR = 3_600_000


def hours(rows):
    return [(k, s, i, T0 + dt.timedelta(hours=h), v, c) for i, (k, s, h, v, c) in enumerate(rows)]


ROWS = [("k", "a", 0, "exact", 0.8), ("k", "b", 1, "exact", 0.7), ("m", "x", 1, "exact", 0.5), ("k", "c", 30, "false", 0.9), ("m", "y", 2, "false", 0.6), ("m", "z", 3, "unverified", 0.9), ("k", "d", 31, "exact", 0.4)]
STANDS = {
    "a": ("exact", "single"), "b": ("exact", "corroborated"),
    "c": ("unverified", "conflicted"), "d": ("unverified", "conflicted"),  # a day later: a new claim, in conflict with itself
    "x": ("unverified", "conflicted"), "y": ("unverified", "conflicted"), "z": ("unverified", "conflicted"),
}


def write(spark, folder, parts):
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/t.parquet")


@pytest.mark.parametrize("cuts", [[7], [2, 5], [1, 1, 1, 1, 1, 1, 1]])
def test_claims_do_not_depend_on_batches(spark, tmp_path, cuts):
    rows, parts = sorted(hours(ROWS), key=lambda r: r[3]), []
    for n in cuts:
        parts.append(rows[:n])
        rows = rows[n:]
    write(spark, tmp_path, parts)
    s = table_stream(stream_session(spark), str(tmp_path), "t", 1)
    out = drained(L.timed_ledger(s, 24 * HOUR, "2 days"), str(tmp_path / "out"), str(tmp_path / "cp"), "update", spark)
    got = {r["statement_id"]: (r["verdict"], r["status"]) for r in L.latest(out).collect()}
    assert got == STANDS


def test_goes_on_from_its_checkpoint(spark, tmp_path):
    rows = sorted(hours(ROWS), key=lambda r: r[3])
    run = lambda: drained(L.timed_ledger(table_stream(stream_session(spark), str(tmp_path), "t"), 24 * HOUR, "2 days"), str(tmp_path / "out"), str(tmp_path / "cp"), "update", spark)
    write(spark, tmp_path, [rows[:3]])
    assert L.latest(run()).filter("status = 'conflicted'").count() == 0
    n = run().count()
    assert run().count() == n  # nothing new, nothing twice
    write(spark, tmp_path, [rows[3:]])
    got = {r["statement_id"]: (r["verdict"], r["status"]) for r in L.latest(run()).collect()}
    assert got == STANDS


def test_a_failed_batch_is_written_once(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "t.parquet"))
    bad = F.when(F.col("id") == 25, F.raise_error(F.lit("lost"))).otherwise(F.col("id"))
    at = str(tmp_path / "out"), str(tmp_path / "cp")
    with pytest.raises(Exception, match="lost"):
        drained(table_stream(stream_session(spark), str(tmp_path), "t", 1).select(bad.cast("long").alias("id")), *at)
    out = drained(table_stream(stream_session(spark), str(tmp_path), "t", 1).select("id"), *at, reader=spark)
    assert sorted(r["id"] for r in out.collect()) == list(range(30))
    assert out.select("batch").distinct().count() == 3


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "t.parquet"))
    out = drained(table_stream(stream_session(spark), str(tmp_path), "t"), str(tmp_path / "out"), str(tmp_path / "cp"), reader=spark)
    assert out.count() == 0


def test_times_are_rounded_as_in_sql(spark, tmp_path):
    """Times that end in a five at the fifth digit."""
    from claimlens.queries import ORACLES, QUERIES
    import claimlens.queries_streams  # noqa: F401

    rows = [(i, "A" * (n - 1) + ". " + "B" * (16000 - n - 1) + ".", "web") for i, n in enumerate((15977, 12603, 12553, 11111, 800))]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in QUERIES["stream_statements"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(ORACLES["stream_statements"]).fetchall())
    assert got[2][-1] == 52.2612  # Spark's round gives 52.2613
