"""Queries that read the driver's tables as streams, with the SQL that their drained result equals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimlens.plans.statements import statements
from claimlens.queries import SHORT, query
from claimlens.storage import ship_package
from claimlens.streaming import ledger as L
from claimlens.streaming.tables import run_table

_SPACE = "E' \\t\\n\\r\\f\\v'"


def _round4(c: str) -> Column:
    """To four digits as the SQL does, in doubles; Spark's round goes by the decimal digits and differs where these end in a five. Not below zero."""
    return F.floor(F.col(c) * 10000 + 0.5) / 10000


# sentences with the white space before them, so that lengths add up to places
PIECES = r"string_split(regexp_replace(text, '([.!?…])(\s+)([A-ZÀÉÈÊÎÔÙ])', '\1' || chr(1) || '\2\3', 'g'), chr(1))"


@query(f"""WITH p AS (SELECT doc_id, source, {PIECES} AS s FROM documents), e AS (SELECT doc_id, source, unnest(s) AS t, generate_subscripts(s, 1) AS i FROM p),
 o AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(t) - length(ltrim(t, {_SPACE})) AS place, trim(t, {_SPACE}) AS b FROM e),
 k AS (SELECT *, row_number() OVER w - 1 AS n, sum(length(b)) OVER w AS run, sum(length(b)) OVER (PARTITION BY doc_id) AS total FROM o WHERE b <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i))
 SELECT doc_id, lower(substr(source, 1, 3)) || '-5-' || n AS statement_id, place::INTEGER AS "offset", (place + length(b))::INTEGER AS "end", round(5 + 60.0 * run / total, 4)::DOUBLE AS timestamp FROM k""")
def stream_statements(spark, d):
    """Documents as a stream of speaking turns, cut into statements with their place and time."""
    ship_package(spark)

    def plan(docs):
        turns = docs.select("doc_id", F.lit(5.0).alias("start"), F.lit(65.0).alias("stop"), F.col("source").alias("speaker"), "text")
        return statements(turns, "doc_id").select("doc_id", "statement_id", "offset", "end", _round4("timestamp").alias("timestamp"))

    return run_table(spark, d, "documents", plan).drop("batch")


@query(f"SELECT o_orderkey, 'sp' || o_custkey % 3 || '-' || o_orderkey || '-0' AS statement_id, o_orderkey % 6 <> 2 AS triggered, o_orderkey % 6 IN (3, 4) AS candidate, ({SHORT}) AS text FROM orders")
def stream_triggers(spark, d):
    """Stage 0 on a stream: every statement with its triggers as it comes."""
    ship_package(spark)

    def plan(orders):
        at = F.col("o_orderkey").cast("double")
        said = orders.select("o_orderkey", at.alias("start"), (at + 1).alias("stop"), F.concat(F.lit("sp"), F.col("o_custkey") % 3).alias("speaker"), F.expr(SHORT).alias("text"))
        return statements(said, "o_orderkey").select("o_orderkey", "statement_id", (F.size("triggers") > 0).alias("triggered"), "candidate", "text")

    return run_table(spark, d, "orders", plan).drop("batch")


KEEP = 86_400_000
SAID = "CASE WHEN event_type <> 'purchase' THEN 'unverified' WHEN event_id % 7 = 0 THEN 'false' ELSE 'exact' END"


@query(f"""WITH e AS (SELECT event_id, user_id, epoch_ms(ts) AS ms, {SAID} AS verdict, 0.5 + 0.1 * (event_id % 5) AS confidence FROM events),
 n AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) > {KEEP} THEN 1 ELSE 0 END AS fresh FROM e),
 c AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS claim FROM n),
 r AS (SELECT *, count(*) FILTER (verdict <> 'unverified') OVER w AS settled, min(CASE WHEN verdict <> 'unverified' THEN verdict END) OVER w AS lo, max(CASE WHEN verdict <> 'unverified' THEN verdict END) OVER w AS hi, max(confidence) OVER w AS best
       FROM c WINDOW w AS (PARTITION BY user_id, claim ORDER BY ms, event_id)),
 x AS (SELECT *, coalesce(lo <> hi, false) AS split, bool_or(coalesce(lo <> hi, false)) OVER (PARTITION BY user_id, claim) AS ends FROM r),
 y AS (SELECT *, split OR (ends AND verdict <> 'unverified') AS gone FROM x)
 SELECT user_id::VARCHAR AS claim_key, event_id::VARCHAR AS statement_id, CASE WHEN gone THEN 'unverified' ELSE verdict END AS verdict,
  round(CASE WHEN gone THEN least(confidence, 0.3) WHEN settled >= 2 THEN least(best + least(0.05 * (settled - 1), 0.10), 0.98) ELSE confidence END, 6)::DOUBLE AS confidence,
  CASE WHEN gone THEN 'conflicted' WHEN settled >= 2 THEN 'corroborated' ELSE 'single' END AS status FROM y""")
def stream_ledger(spark, d):
    """The ledger on a stream of occurrences, with event-time timers; what stands when all has been read."""
    ship_package(spark)

    def plan(events):
        said = events.select(F.col("user_id").cast("string").alias("claim_key"), F.col("event_id").cast("string").alias("statement_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), F.expr(SAID).alias("verdict"), (F.lit(0.5) + F.lit(0.1) * (F.col("event_id") % 5)).cast("double").alias("confidence"))
        return L.timed_ledger(said, KEEP)

    return L.latest(run_table(spark, d, "events", plan, "update"))
