"""Queries of the provenance, set, page and audit-line operators over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens.operators import joins as J
from claimlens.operators import reports as R
from claimlens.queries import query
from claimlens.queries_speech import blocks
from claimlens.sources import manifests as M
from claimlens.storage import table


@query("""WITH s AS (SELECT *, CASE WHEN turn > min(turn) OVER w AND role IS NOT DISTINCT FROM lag(role) OVER w THEN 0 ELSE 1 END AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 i AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM s)
 SELECT conv_id, island::BIGINT AS island, min(role) AS speaker, bool_or(length(text) > 120) AS withdrawn, min(turn)::DOUBLE AS start, max(turn)::DOUBLE AS timecode, count(*) AS n FROM i GROUP BY 1, 2""")
def page_blocks(spark, d):
    s = blocks(spark, d).select("conv_id", "seq", F.col("role").alias("speaker"), F.col("start").alias("timestamp"), (F.length("text") > 120).alias("withdrawn"))
    return R.page_blocks(s, ["conv_id"], ["seq"])


FLAT = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"


@query(f"""WITH q AS (SELECT item_id, CASE WHEN length(text) > 220 THEN 'en' END AS domain, {FLAT} AS f FROM benchmark UNION ALL SELECT -1 - n_nationkey, NULL, lower(n_name) FROM nation),
 s AS (SELECT doc_id, lang, n_chars, {FLAT} AS f FROM documents),
 h AS (SELECT item_id, min(doc_id) FILTER (n_chars <= 2000) AS source_id, min(doc_id) FILTER (n_chars > 2000) AS brief FROM q JOIN s ON contains(s.f, q.f) AND (domain IS NULL OR domain = lang) WHERE length(q.f) >= 12 GROUP BY 1)
 SELECT q.item_id, source_id IS NOT NULL AS found, source_id, CASE WHEN length(f) < 12 THEN 'too short' WHEN source_id IS NOT NULL THEN 'primary source' WHEN brief IS NOT NULL THEN 'brief only' ELSE 'not found' END AS reason FROM q LEFT JOIN h ON h.item_id = q.item_id""")
def quote_reasons(spark, d):
    """Short documents stand for sources, long ones for briefs; the names of nations are quotes too short or of one word."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    q = table(spark, d, "benchmark").select("item_id", F.when(F.length("text") > 220, "en").alias("domain"), flat(F.col("text")).alias("flat"))
    q = q.union(table(spark, d, "nation").select(-1 - F.col("n_nationkey"), F.lit(None), F.lower("n_name")))
    s = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.col("lang").alias("domain"), flat(F.col("text")).alias("flat"), "n_chars")
    return J.provenance(q, s.filter("n_chars <= 2000").drop("n_chars"), s.filter("n_chars > 2000").drop("n_chars"))


@query("(SELECT 'left' AS side, doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) a) UNION ALL (SELECT 'right', doc_id FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents) b)")
def only_in_either(spark, d):
    return R.only_in_either(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT n_name AS domain FROM nation WHERE n_regionkey = 1 UNION SELECT n_name FROM nation WHERE n_regionkey = 2")
def fact_check_domains(spark, d):
    return M.fact_check_domains(table(spark, d, "nation").select(F.col("n_regionkey").alias("rank"), F.col("n_name").alias("domain")))


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) q WHERE n <= 5")
def first_examples(spark, d):
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    return R.first_examples(table(spark, d, "lineitem"), ["l_suppkey"], order, 5).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("SELECT count(*) AS claims, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (n > 1 AND k = 1) AS corroborated, count(*) FILTER (k > 1) AS conflicted FROM (SELECT l_suppkey, l_linenumber, count(*) AS n, count(DISTINCT l_returnflag) AS k FROM lineitem GROUP BY 1, 2) q")
def ledger_counters(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("occurrences"), F.count_distinct("l_returnflag").alias("k"))
    return R.ledger_counters(g.withColumn("status", F.when(F.col("k") > 1, "conflicted").when(F.col("occurrences") > 1, "corroborated").otherwise("single")))


@query("""SELECT conv_id, 'terms=[' || string_agg(DISTINCT role, ', ' ORDER BY role) || '] domains=' || CASE WHEN count(*) > 2 THEN '[long]' ELSE '-' END || ' sources=-' || CASE WHEN count(*) > 3 THEN ' TRAP' ELSE '' END AS line FROM conversations GROUP BY 1""")
def routing_lines(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("terms"), F.count("*").alias("n"))
    none = F.array().cast("array<string>")
    return g.select("conv_id", R.routing_line(F.col("terms"), F.when(F.col("n") > 2, F.array(F.lit("long"))).otherwise(none), none, F.col("n") > 3).alias("line"))


STATUSES = ["confirmed", "divergent", "absent", "no_witness", "no_quantity"]


@query("""WITH s AS (SELECT *, ['confirmed', 'divergent', 'absent', 'no_witness', 'no_quantity'][l_linenumber % 5 + 1] AS status, l_linenumber % 5 = 1 AND l_quantity > 40 AS drifted FROM lineitem)
 SELECT l_orderkey, l_linenumber, CASE WHEN status = 'confirmed' THEN 'confirmed by an independent transcription (' || l_linestatus || ')' WHEN drifted THEN l_returnflag || ' is heard by ' || l_linestatus || ' among other words: not corroborated'
 WHEN status = 'divergent' THEN 'transcriptions differ: ' || l_returnflag || ' here, ' || CASE WHEN l_quantity < 10 THEN 'something else' ELSE 'a, b, c' END || ' in ' || l_linestatus WHEN status = 'absent' THEN l_linestatus || ' reports no figure here: not judged'
 WHEN status = 'no_witness' THEN 'only one transcription: no independent source' ELSE 'no figure to corroborate' END AS note FROM s""")
def corroboration_notes(spark, d):
    none = F.array().cast("array<string>")
    figures = F.when(F.col("l_linenumber") % 5 == 1, F.array("l_returnflag")).otherwise(none)
    status = F.get(F.array(*map(F.lit, STATUSES)), F.col("l_linenumber") % 5)
    heard = F.when(F.col("l_quantity") >= 10, F.array(*map(F.lit, "abcd"))).otherwise(none)
    note = R.corroboration_note(status, F.col("l_linestatus"), figures, F.when(F.col("l_quantity") > 40, figures).otherwise(none), heard)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", note.alias("note"))


@query("SELECT doc_id, CASE WHEN n_chars > 500 THEN substr(md5(text), 1, 11) END AS video FROM documents")
def video_ids(spark, d):
    t = table(spark, d, "documents")
    url = F.concat(F.when(F.col("n_chars") > 500, "https://www.youtube.com/watch?v=").otherwise("https://example.org/"), F.substring(F.md5("text"), 1, 11), F.lit("&t=3"))
    return t.select("doc_id", M.video_id(url).alias("video"))
