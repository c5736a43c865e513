"""Queries of the texts judges are given, of run counters and of audit rows over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens.operators import aggregates as A
from claimlens.plans import prompts as P
from claimlens.queries import EV, VERDICTS, nearest_figure, occurrences, query
from claimlens.storage import table

_BUDGET = 900
_S = "lang AS domain, doc_id AS source_key, 'producer : ' || source || ' (rank ' || (1 + doc_id % 3) || ')' || chr(10) || 'measure  : ' || n_chars || chr(10) || 'vintage  : ' || (2000 + doc_id % 20) || CASE WHEN doc_id % 2 = 0 THEN ' letters' ELSE '' END || chr(10) || 'url      : doc:' || doc_id AS head"


@query(f"""WITH r AS (SELECT item_id, i, CASE WHEN i = 2 THEN 'fr' ELSE 'en' END AS domain, CASE WHEN item_id % 4 <> i THEN item_id * 7 + i * 13 END AS k FROM benchmark, (VALUES (0), (1), (2), (3)) v(i)),
 n AS (SELECT item_id, greatest(count(k), 1) AS n FROM r GROUP BY 1), s AS (SELECT {_S}, text FROM documents),
 e AS (SELECT r.item_id, i, '--- PRIMARY SOURCE: ' || k || ' ---' || chr(10) || head || chr(10) || chr(10) || substring(coalesce(text, ''), 1, ({_BUDGET} // n)::INT) || chr(10) AS e FROM r JOIN n USING (item_id) JOIN s ON s.domain = r.domain AND s.source_key = k)
 SELECT n.item_id, count(e)::INT AS sources, coalesce(string_agg(e, chr(10) ORDER BY i), '{P.NO_SOURCE}') AS evidence FROM n LEFT JOIN e USING (item_id) GROUP BY 1""")
def evidence_texts(spark, d):
    """Benchmark items ask for four documents each, one of them null or of another language; documents stand for the stored sources."""
    i, k = F.col("item_id"), F.col("doc_id")
    r = table(spark, d, "benchmark").select("item_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos"))
    r = r.select("item_id", "pos", F.when(F.col("pos") == 2, "fr").otherwise("en").alias("domain"), F.when(i % 4 != F.col("pos"), (i * 7 + F.col("pos") * 13).cast("string")).alias("source_key"))
    s = table(spark, d, "documents").select(
        F.col("lang").alias("domain"), k.cast("string").alias("source_key"), F.col("source").alias("producer"), (1 + k % 3).alias("rank"), F.col("n_chars").alias("measure"),
        (2000 + k % 20).alias("vintage"), F.when(k % 2 == 0, "letters").alias("unit"), F.concat(F.lit("doc:"), k).alias("url"), "text",
    )
    return P.evidence_texts(r, s, "item_id", _BUDGET)


@query("""WITH s AS (SELECT l_orderkey, count(*) AS n, string_agg('  - ' || l_linenumber || ' -- ' || l_partkey || ' (' || l_returnflag || ', ' || year(l_shipdate) || ')', chr(10) ORDER BY l_linenumber::VARCHAR, '  - ' || l_linenumber || ' -- ' || l_partkey || ' (' || l_returnflag || ', ' || year(l_shipdate) || ')') AS s FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
 SELECT o_orderkey::VARCHAR AS domain, '  - ' || o_orderkey || ' (' || coalesce(n, 0) || ' primary source(s))' AS line, o_orderpriority || chr(10) || chr(10) || 'Primary sources in this domain:' || chr(10) || coalesce(s, '') AS orientation FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
def domain_orientations(spark, d):
    """Orders stand for domains, their finished lines for sources; some orders have none."""
    domains = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("domain"), F.col("o_orderpriority").alias("brief"))
    x = table(spark, d, "lineitem").filter("l_linestatus = 'F'")
    s = x.select(F.col("l_orderkey").cast("string").alias("domain"), F.col("l_linenumber").cast("string").alias("source_key"), F.col("l_partkey").cast("string").alias("measure"), F.col("l_returnflag").alias("producer"), F.year("l_shipdate").cast("string").alias("vintage"))
    return P.orientations(domains, s)


@query("""SELECT conv_id, '  conversation ' || conv_id || ':' || chr(10) || string_agg('    - ' || role || ' ' || turn, chr(10) ORDER BY turn) || CASE WHEN count(*) > 3 THEN chr(10) || '    -> ' || count(*) || ' turns' ELSE '' END AS text FROM conversations GROUP BY 1""")
def trap_texts(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    measures = F.transform("t", lambda x: F.concat_ws(" ", x["role"], x["turn"].cast("string")))
    note = F.when(F.size("t") > 3, F.concat(F.size("t").cast("string"), F.lit(" turns")))
    return P.trap_texts(g.select("conv_id", F.concat(F.lit("conversation "), "conv_id").alias("subject"), measures.alias("measures"), note.alias("note")), "conv_id")


_Q = "(SELECT sum(CASE WHEN (o_orderkey + i) % 4 <> 0 THEN 0 ELSE 1 END) FROM (VALUES (0), (1), (2)) x(i) WHERE i <= o_orderkey % 3)"


@query(f"""SELECT count(*) AS statements, count(*) AS verified, count(*) FILTER (verdict = 'unverified') AS unverified, round(count(*) FILTER (verdict = 'unverified') / count(*), 6) AS abstention, count(*) FILTER (verdict = 'false') AS reds,
 count(*) FILTER (o_orderkey % 5 > 1) AS triggered, sum({_Q})::BIGINT AS unverified_quotes, count(*) FILTER (confidence < 0.65) AS escalated FROM ({VERDICTS}) v""")
def run_counters(spark, d):
    """All counters of a run; statements cite one to three sources, doubtful ones go to a second judge."""
    k = F.col("o_orderkey")
    sources = F.transform(F.sequence(F.lit(0).cast("long"), k % 3), lambda i: F.struct(((k + i) % 4 != 0).alias("quote_verified")))
    spans = F.when(k % 5 > 1, F.array(F.lit("number"))).otherwise(F.array().cast("array<string>"))
    s = occurrences(spark, d).withColumn("sources", sources).withColumn("triggers", spans)
    return A.run_stats(s.withColumn("strong_verdict", F.when(F.col("confidence") < 0.65, F.col("verdict"))))


@query(f"""WITH s AS (SELECT v.event_id, (SELECT min(abs(c.t - v.t)) FROM ({EV}) c WHERE c.user_id = v.user_id AND c.event_type = 'click') AS x FROM ({EV}) v WHERE event_type = 'view'),
 k AS (SELECT CASE WHEN x IS NULL THEN 'absent' WHEN x <= 86400 THEN 'confirmed' ELSE 'divergent' END AS status FROM s)
 SELECT status, count(*) AS n, round(count(*) / (SELECT count(*) FROM k), 3)::DOUBLE AS share FROM k GROUP BY 1""")
def agreement_by_status(spark, d):
    x = F.col("distance")
    return A.status_counts(nearest_figure(spark, d).select(F.when(x.isNull(), "absent").when(x <= 86400, "confirmed").otherwise("divergent").alias("status")))


@query(f"""WITH v AS (SELECT o_custkey, o_orderkey, verdict, confidence FROM ({VERDICTS}) q),
 g AS (SELECT o_custkey, CASE WHEN count(*) FILTER (verdict <> 'unverified') < 2 THEN 'single' WHEN count(DISTINCT verdict) FILTER (verdict <> 'unverified') = 1 THEN 'corroborated' ELSE 'conflicted' END AS status FROM v GROUP BY 1 HAVING count(*) > 1)
 SELECT o_custkey, status, o_orderkey AS statement_id, verdict, round(confidence, 3)::DOUBLE AS confidence FROM v JOIN g USING (o_custkey)""")
def audit_occurrences(spark, d):
    return A.audit_occurrences(occurrences(spark, d).withColumnRenamed("o_orderkey", "statement_id"), "o_custkey")
