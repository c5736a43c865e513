"""Queries of attribution, citations, explained thresholds, findings and the specified behaviour over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens.functions.numbers import POINT_BARS, RELATIVE_BARS
from claimlens.functions.text import ACCENTED, PLAIN
from claimlens.functions.triggers import triggers
from claimlens.operators import guardrails as G
from claimlens.operators import reports as R
from claimlens.plans import chain as P
from claimlens.plans.citations import checked_citations
from claimlens.plans.speech import NO_TURN, UNKNOWN, attributed_blocks
from claimlens.queries import SHORT, VERDICTS, occurrences, query, rendered
from claimlens.storage import ship_package, spread, table

TURNS = """SELECT conv_id, turn // 2 AS k, min(turn) + 0.3 + 0.3 * (turn // 2 % 2) AS a, max(turn) + 1.3 AS b, min(role) AS speaker, (conv_id + turn // 2) % 5 <> 4 AS accepted,
 CASE WHEN min(role) = 'user' THEN 'candidate' ELSE 'moderator' END AS role, 0.5 + 0.1 * (turn // 2 % 4) AS similarity FROM conversations GROUP BY conv_id, turn // 2"""


@query(f"""WITH t AS ({TURNS}), o AS (SELECT c.conv_id, c.turn, c.text, k, least(turn + 1, b) - greatest(turn, a) AS s FROM conversations c LEFT JOIN t ON t.conv_id = c.conv_id AND a < turn + 1 AND b > turn),
 h AS (SELECT conv_id, turn, any_value(text) AS text, arg_max(k, (s, -k)) AS k, max(s) AS s FROM o GROUP BY 1, 2),
 j AS (SELECT h.conv_id, h.turn, h.text, coalesce(accepted, false) AS known, CASE WHEN coalesce(accepted, false) THEN speaker ELSE '{UNKNOWN}' END AS speaker, CASE WHEN coalesce(accepted, false) THEN role ELSE '' END AS role,
  coalesce(similarity, 0) AS similarity, CASE WHEN accepted THEN '' WHEN accepted IS NULL THEN '{NO_TURN}' ELSE 'disagreement' END AS note FROM h LEFT JOIN t ON t.conv_id = h.conv_id AND t.k = h.k AND h.s >= 0.5),
 c AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker AND lag(role) OVER w = role THEN 0 ELSE 1 END AS n FROM j WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 i AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM c)
 SELECT conv_id, block::BIGINT AS block, min(turn)::DOUBLE AS start, max(turn) + 1.0::DOUBLE AS stop, min(speaker) AS speaker, min(role) AS role, trim(string_agg(trim(text), ' ' ORDER BY turn)) AS text, round(max(similarity), 6)::DOUBLE AS similarity,
 bool_or(known) AS identified, bool_or(role = 'candidate') AS analysed, arg_min(note, turn) AS note, count(*) AS captions FROM i GROUP BY 1, 2""")
def attribution_chain(spark, d):
    """Turns of two captions each, begun late so that some captions straddle a change of speaker and belong to nobody."""
    c = table(spark, d, "conversations")
    k = F.floor(F.col("turn") / 2)
    t = c.groupBy("conv_id", k.alias("turn_seq")).agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.min("role").alias("speaker"))
    s = F.col("turn_seq")
    turns = t.select(
        "conv_id", "turn_seq", (F.col("lo") + 0.3 + 0.3 * (s % 2)).alias("r_start"), (F.col("hi") + 1.3).alias("r_stop"), ((F.col("conv_id") + s) % 5 != 4).alias("accepted"),
        "speaker", F.when(F.col("speaker") == "user", "candidate").otherwise("moderator").alias("role"), (0.5 + 0.1 * (s % 4)).alias("similarity"), F.lit("disagreement").alias("reason"),
    )
    captions = c.select("conv_id", F.col("turn").alias("seq"), F.col("turn").cast("double").alias("l_start"), (F.col("turn") + 1).cast("double").alias("l_stop"), F.trim("text").alias("text"))
    return attributed_blocks(captions, turns, "conv_id").withColumn("similarity", F.round("similarity", 6))


_FLAT = f"trim(regexp_replace(regexp_replace(lower(translate(text, '{ACCENTED}', '{PLAIN}')), '[.\\-_·•]{{2,}}', ' ', 'g'), '[\\s\\x0B\\x1C-\\x1F\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'))"


@query(f"""WITH q AS (SELECT item_id // 3 AS statement_id, item_id, CASE WHEN item_id % 2 = 0 THEN 'en' END AS domain, CASE WHEN item_id % 4 = 0 THEN '2020' END AS date, {_FLAT} AS f FROM benchmark),
 s AS (SELECT doc_id, lang, source, {_FLAT} AS f FROM documents),
 h AS (SELECT item_id, min(doc_id) AS doc_id FROM q JOIN s ON contains(s.f, q.f) AND (domain IS NULL OR domain = lang) WHERE length(q.f) >= 12 GROUP BY 1)
 SELECT statement_id, coalesce(string_agg('doc:' || s.doc_id || ' ' || source || ' ' || (1 + s.doc_id % 3) || ' ' || coalesce(date, lang), ',' ORDER BY q.item_id) FILTER (s.doc_id IS NOT NULL), '') AS sources, count(*) FILTER (s.doc_id IS NULL) AS rejected
 FROM q LEFT JOIN h ON h.item_id = q.item_id LEFT JOIN s ON s.doc_id = h.doc_id GROUP BY 1""")
def cited_sources(spark, d):
    """Passages cited by statements of three quotes each, documents as the stored sources."""
    i = F.col("item_id")
    c = table(spark, d, "benchmark").select(F.floor(i / 3).alias("statement_id"), i.alias("pos"), F.when(i % 2 == 0, "en").alias("domain"), F.col("text").alias("quote"), F.when(i % 4 == 0, "2020").alias("data_date"))
    k = F.col("doc_id")
    s = table(spark, d, "documents").select(k.alias("source_id"), F.col("lang").alias("domain"), "text", F.concat(F.lit("doc:"), k).alias("url"), F.col("source").alias("producer"), (1 + k % 3).alias("rank"), F.col("lang").alias("vintage"))
    out = checked_citations(c, s)
    return out.select("statement_id", F.array_join(F.transform("sources", lambda x: F.concat_ws(" ", x["url"], x["domain"], x["rank"].cast("string"), x["data_date"])), ",").alias("sources"), "rejected")


_E = f"CASE WHEN unit = 'points' THEN {POINT_BARS[0]} ELSE {RELATIVE_BARS[0]} END"
_A = f"CASE WHEN unit = 'points' THEN {POINT_BARS[1]} ELSE {RELATIVE_BARS[1]} END"
_WRITTEN = "CASE WHEN unit = 'points' THEN replace(printf('%.2f', gap), '.', ',') || CASE WHEN gap >= 2 THEN ' points' ELSE ' point' END ELSE round(gap * 100)::BIGINT || '%' END"


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 5 = 0 THEN 'unverified' WHEN l_suppkey % 5 < 3 THEN 'exact' ELSE 'false' END AS verdict, round(l_discount * 5, 2)::DOUBLE AS gap, CASE WHEN l_linenumber % 2 = 0 THEN 'points' ELSE 'relative' END AS unit, 1 + l_partkey % 2 AS rank FROM lineitem)
 SELECT l_orderkey, l_linenumber, CASE WHEN verdict = 'unverified' THEN verdict WHEN gap <= {_E} THEN 'exact' WHEN gap <= {_A} THEN 'approximate' WHEN verdict = 'false' AND rank = 1 THEN 'false' WHEN verdict = 'exact' THEN 'unverified' ELSE 'approximate' END AS verdict,
 CASE WHEN verdict <> 'unverified' AND gap <= {_E} THEN 'approximate_magnitude' ELSE '' END AS tags,
 concat_ws(' ', CASE WHEN verdict = 'exact' AND gap > {_A} THEN '(Withdrawn: called exact with a gap of ' || {_WRITTEN} || '.)' END, CASE WHEN verdict <> 'unverified' AND unit = 'points' THEN '(Gap in points: ' || {_WRITTEN} || '.)' END) AS note FROM s""")
def explained_thresholds(spark, d):
    k = F.col("l_suppkey") % 5
    s = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(k == 0, "unverified").when(k < 3, "exact").otherwise("false").alias("verdict"), F.lit(0.9).alias("confidence"), F.round(F.col("l_discount") * 5, 2).alias("gap"),
        F.when(F.col("l_linenumber") % 2 == 0, "points").otherwise("relative").alias("unit"), (1 + F.col("l_partkey") % 2).alias("rank"), F.array().cast("array<string>").alias("tags"), F.lit("").alias("note"),
    )
    return G.explained_thresholds(s).select("l_orderkey", "l_linenumber", "verdict", F.array_join("tags", ",").alias("tags"), "note")


@query(f"""WITH s AS (SELECT *, 'Élu n° ' || (o_orderkey % 7) AS speaker FROM ({VERDICTS}) v WHERE verdict IN ('exact', 'approximate', 'false') AND confidence >= 0.75 AND o_orderkey % 3 <> 0)
 SELECT o_custkey AS claim, arg_min(speaker, o_orderkey) AS speaker, 'élu-n--' || (min(o_orderkey) % 7) AS slug, min(o_orderkey) AS statement_id, arg_min(verdict, o_orderkey) AS verdict, arg_min(confidence, o_orderkey)::DOUBLE AS confidence, count(*) AS occurrences FROM s GROUP BY 1""")
def findings_by_speaker(spark, d):
    k = F.col("o_orderkey")
    o = occurrences(spark, d).select(k.alias("statement_id"), F.concat(F.lit("Élu n° "), k % 7).alias("speaker"), F.col("o_custkey").alias("claim"), k.alias("at"), "verdict", "confidence", F.array(F.struct((k % 3 != 0).alias("quote_verified"))).alias("sources"), F.lit(False).alias("withdrawn"))
    return R.findings(o, "claim", "at")


@query("""WITH g AS (SELECT s_nationkey AS speaker, s_suppkey % 3 AS topic, avg(s_acctbal) AS b FROM supplier GROUP BY 1, 2), p AS (SELECT speaker, topic, CASE WHEN b > 5000 THEN 1 WHEN b < 2000 THEN -1 ELSE 0 END AS published FROM g),
 c AS (SELECT c_custkey, c_nationkey AS speaker, c_custkey % 3 AS topic, CASE WHEN c_acctbal > 5000 THEN 1 WHEN c_acctbal < 2000 THEN -1 ELSE 0 END AS position FROM customer)
 SELECT c_custkey, CASE WHEN published IS NULL THEN 'absent' WHEN position = published THEN 'consistent' WHEN sign(position) = -sign(published) THEN 'contradicted' ELSE 'divergent' END AS coherence FROM c LEFT JOIN p ON p.speaker = c.speaker AND p.topic = c.topic""")
def pledge_coherence(spark, d):
    side = lambda b: F.when(b > 5000, 1).when(b < 2000, -1).otherwise(0)
    p = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("speaker"), (F.col("s_suppkey") % 3).alias("topic")).agg(side(F.avg("s_acctbal")).alias("published"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("speaker"), (F.col("c_custkey") % 3).alias("topic"), side(F.col("c_acctbal")).alias("position"))
    return P.coherence(c, p).select("c_custkey", "coherence")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount * 10 <= 0.6 AND -l_quantity / 25 >= -1.0 AND l_tax * 40 <= 2.4")
def clear_speech(spark, d):
    s = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("no_speech_prob"), (-F.col("l_quantity") / 25).alias("avg_logprob"), (F.col("l_tax") * 40).alias("compression_ratio"))
    return P.clear_speech(s).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_orderkey - 3.0::DOUBLE AS l_start, o_orderkey + 3.0::DOUBLE AS l_stop, (o_orderkey % 90) || ' %' AS text FROM orders WHERE o_orderkey % 6 = 3")
def relisten_intervals(spark, d):
    ship_package(spark)
    s = spread(rendered(spark, d, SHORT)).select(F.col("o_orderkey").alias("statement_id"), F.col("o_orderkey").cast("double").alias("timestamp"), triggers(F.col("text")).alias("triggers"))
    return P.relisten(s).withColumnRenamed("statement_id", "o_orderkey")
