"""Queries of the transcript, enrolment and report operators over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens.functions import text as T
from claimlens.operators import reports as R
from claimlens.operators import transcripts as S
from claimlens.queries import CASES, EV, GOLD, IV, MADE, RENDER, VERDICTS, cases, ev, gold_tables, iv, occurrences, query, rendered
from claimlens.storage import ship_package, table

# ---- transcripts: a conversation is a transcript, a turn a block of one second


def blocks(spark, d):
    return table(spark, d, "conversations").select("conv_id", F.col("turn").alias("seq"), F.col("turn").cast("double").alias("start"), (F.col("turn") + 1).cast("double").alias("stop"), "role", "text")


@query("SELECT conv_id, turn AS seq FROM conversations WHERE turn + 1 > 1 AND turn < 3")
def time_slice(spark, d):
    return S.time_slice(blocks(spark, d), 1.0, 3.0).select("conv_id", "seq")


WINDOWS = "SELECT conv_id, min(turn) + 1 AS lo, min(turn) + 2 AS hi FROM conversations GROUP BY 1"


def speech_windows(spark, d):
    return blocks(spark, d).groupBy("conv_id").agg((F.min("start") + 1).alias("lo"), (F.min("start") + 2).alias("hi")).withColumn("window_id", F.col("conv_id"))


@query(f"SELECT w.conv_id AS window_id, coalesce(string_agg(c.text, ' ' ORDER BY turn), '') AS text FROM ({WINDOWS}) w LEFT JOIN conversations c ON c.conv_id = w.conv_id AND turn + 1 >= lo AND turn <= hi GROUP BY 1")
def window_text(spark, d):
    return S.text_within(blocks(spark, d), speech_windows(spark, d), ["conv_id"], "window_id")


@query(f"SELECT window_id, CASE WHEN length(t) > 400 THEN substr(t, 1, 400) || '…' ELSE t END AS text FROM (SELECT w.conv_id AS window_id, coalesce(trim(string_agg(c.text, ' ' ORDER BY turn)), '') AS t FROM ({WINDOWS}) w LEFT JOIN conversations c ON c.conv_id = w.conv_id AND turn + 1 > lo AND turn < hi GROUP BY 1) q")
def spoken_text(spark, d):
    return S.text_within(blocks(spark, d), speech_windows(spark, d), ["conv_id"], "window_id", closed=False, limit=S.EXTRACT)


@query("SELECT role, role IS NOT NULL AS identified, role = 'user' AS analysed, count(*) AS n FROM conversations GROUP BY 1, 2, 3")
def analysed_roles(spark, d):
    b = blocks(spark, d).withColumn("speaker_id", F.col("role"))
    return S.analysed(b, ("user",)).groupBy("role", "identified", "analysed").agg(F.count("*").alias("n"))


SPANS = "SELECT l_orderkey, l_linenumber, l_linenumber::DOUBLE AS start, l_linenumber + l_quantity / 8.0 AS stop FROM lineitem"


def spans(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("double").alias("start"), (F.col("l_linenumber") + F.col("l_quantity") / 8.0).alias("stop"))


@query(f"SELECT l_orderkey, l_linenumber FROM ({SPANS}) s WHERE stop - start >= 2 AND least(stop, 8.0) - start >= 2")
def usable_windows(spark, d):
    return S.usable_windows(spans(spark, d), 8.0).select("l_orderkey", "l_linenumber")


@query(f"SELECT l_orderkey, l_linenumber FROM ({SPANS}) s WHERE stop - start >= 3")
def enrolment_segments(spark, d):
    return S.enrolment_segments(spans(spark, d)).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, coalesce(string_agg(l_suppkey, ',' ORDER BY l_linenumber, l_suppkey), '') AS windows FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def segment_windows(spark, d):
    w = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("seq"), "l_suppkey")
    s = S.segment_windows(table(spark, d, "orders").select("o_orderkey"), w, "o_orderkey", "l_suppkey")
    return s.select("o_orderkey", F.array_join(F.col("windows").cast("array<string>"), ",").alias("windows"))


@query("SELECT o_orderkey, coalesce(l_extendedprice, o_totalprice)::DOUBLE AS price FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 + o_orderkey % 7")
def composite_lookup(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (1 + F.col("o_orderkey") % 7).alias("n"), "o_totalprice")
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("n"), F.col("l_extendedprice").alias("price"))
    return S.lookup(o, t, ["o_orderkey", "n"], "price", F.col("o_totalprice")).select("o_orderkey", F.col("price").cast("double").alias("price"))


KEYS = [("land", "k1"), ("land", "k2"), ("budget", "k3")]


@query(f"""WITH r AS (SELECT o_orderkey AS statement_id, CASE o_orderkey % 2 WHEN 0 THEN 'land' ELSE 'budget' END AS domain, ['k' || (o_custkey % 5), 'k' || (o_orderkey % 4)] AS keys FROM orders),
 s(domain, k) AS (VALUES {', '.join(map(str, KEYS))}), l AS (SELECT domain, list(k) AS ks FROM s GROUP BY 1), f AS (SELECT statement_id, list_filter(keys, lambda x: list_contains(ks, x)) AS kept FROM r LEFT JOIN l USING (domain))
 SELECT statement_id, array_to_string(kept, ',') AS keys, CASE WHEN len(kept) = 0 THEN 'unverified' ELSE 'exact' END AS verdict, CASE WHEN len(kept) = 0 THEN 0.0 ELSE 0.9 END::DOUBLE AS confidence FROM f""")
def route_or_abstain(spark, d):
    key = lambda c, n: F.concat(F.lit("k"), F.col(c) % n)
    r = table(spark, d, "orders").select(F.col("o_orderkey").alias("statement_id"), F.when(F.col("o_orderkey") % 2 == 0, "land").otherwise("budget").alias("domain"), F.array(key("o_custkey", 5), key("o_orderkey", 4)).alias("keys"), F.lit("exact").alias("verdict"), F.lit(0.9).cast("double").alias("confidence"))
    return S.route(r, spark.createDataFrame(KEYS, "domain string, source_key string")).select("statement_id", F.array_join("keys", ",").alias("keys"), "verdict", "confidence")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'unverified' END AS verdict FROM orders")
def brief_gate(spark, d):
    b = table(spark, d, "orders").select("o_orderkey", F.lit(None).cast("string").alias("verdict"), F.when(F.col("o_orderkey") % 3 != 0, F.array(F.lit("k1"))).otherwise(F.array().cast("array<string>")).alias("source_keys"))
    return S.brief_gate(b).select("o_orderkey", "verdict")


@query(f"SELECT o_orderkey FROM (SELECT o_orderkey, {RENDER} AS t FROM orders) r JOIN ({VERDICTS}) v USING (o_orderkey) WHERE verdict IN ('false', 'exact') AND contains(lower(t), 'plus haut')")
def page_filter(spark, d):
    s = rendered(spark, d).join(occurrences(spark, d).select("o_orderkey", "verdict"), "o_orderkey")
    return S.page_filter(s, ["false", "exact"], "Plus Haut").select("o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 40")
def first_statements(spark, d):
    return S.first_statements(table(spark, d, "orders"), ["o_orderdate", "o_orderkey"], 40).select("o_orderkey")


@query(f"SELECT verdict AS label, count(*) AS n FROM ({CASES}) c WHERE verdict IN ('exact', 'approximate', 'false') AND quoted GROUP BY 1")
def decidable_items(spark, d):
    c = cases(spark, d).select(F.col("verdict").alias("label"), F.when(F.col("quoted"), F.col("gap")).alias("gap"))
    return S.decidable(c).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (quality <> 0) AS judged, count(*) FILTER (quality = 0) AS unreachable FROM labels")
def reachable_items(spark, d):
    return S.reachable(table(spark, d, "labels").select(F.when(F.col("quality") == 0, "non").when(F.col("toxic") == 1, "oui").alias("reachable")))


PANEL = [("p1", "Anna The"), ("p2", "Bob That"), ("p3", "Jean-Luc De-La Which"), ("p4", "With")]


@query(f"""WITH b AS (SELECT doc_id, lower(translate(text, '{T.ACCENTED}', '{T.PLAIN}')) AS t FROM documents), p(id, form) AS (VALUES ('p2', 'that'), ('p3', 'de-la which'), ('p3', 'de la which'), ('p4', 'with'))
 SELECT DISTINCT doc_id, id FROM b JOIN p ON contains(t, form)""")
def mention_scan(spark, d):
    return S.mentions(table(spark, d, "documents").select("doc_id", "text"), PANEL).select("doc_id", "id")


@query("""WITH a AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN upper(n_name) WHEN 1 THEN ' N' || n_nationkey WHEN 2 THEN 'nobody' ELSE lower(n_name) END AS said FROM supplier JOIN nation ON n_nationkey = s_nationkey)
 SELECT s_suppkey, CASE s_suppkey % 4 WHEN 2 THEN 'nobody' ELSE (SELECT 'n' || n_nationkey FROM nation WHERE lower(trim(said)) IN (lower(n_name), 'n' || n_nationkey)) END AS person FROM a""")
def person_lookup(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("nom"), F.col("n_nationkey").alias("k"))
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("k"))
    said = F.expr("CASE s_suppkey % 4 WHEN 0 THEN upper(nom) WHEN 1 THEN concat(' N', k) WHEN 2 THEN 'nobody' ELSE lower(nom) END")
    return S.person_of(s.select("s_suppkey", said.alias("said")), n.select("id", "nom"), "said").select("s_suppkey", "person")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0)")
def enrolled_skip(spark, d):
    pieces = table(spark, d, "orders").filter("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("person"))
    return S.not_enrolled(table(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("person")), pieces).select("c_custkey")


@query()
def caption_folds(spark, d):
    """Every conversation as rolling captions: each cue repeats the second half of the one before. Tests hold the fold to brute force."""
    ship_package(spark)
    b = blocks(spark, d)
    half = lambda c: F.array_join(F.slice(F.split(c, r"\s+"), 1, 6), " ")
    cues = b.withColumn("text", F.concat_ws(" ", half(F.col("text")), half(F.col("text"))))
    return S.caption_fold(cues, "conv_id")


# ---- reports

@query("SELECT event_type, n, row_number() OVER (ORDER BY n DESC, f)::INTEGER AS place FROM (SELECT event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1) q")
def ranked_counts(spark, d):
    return R.ranked_counts(table(spark, d, "events"), "event_type", "event_id").withColumn("place", F.col("place").cast("int"))


@query(f"SELECT event_type AS speaker, round(sum(s), 1)::DOUBLE AS seconds, round(sum(s) / sum(sum(s)) OVER (), 3)::DOUBLE AS share FROM (SELECT event_type, round(stop - t) AS s FROM ({IV}) i WHERE stop IS NOT NULL) q GROUP BY 1")
def speaker_seconds(spark, d):
    b = iv(spark, d).filter("stop is not null").select(F.col("event_type").alias("speaker"), F.lit(0.0).alias("start"), F.round(F.col("stop") - F.col("t")).alias("stop"))
    return R.speaker_seconds(b)


DECISIONS = f"SELECT event_type = 'view' AS accepted, CASE event_type WHEN 'click' THEN 'below threshold (' || user_id || ')' WHEN 'error' THEN 'overlap' ELSE 'margin (0.01)' END AS reason, round(stop - t) AS s FROM ({IV}) i WHERE stop IS NOT NULL"


def decisions(spark, d):
    why = F.expr("CASE event_type WHEN 'click' THEN concat('below threshold (', user_id, ')') WHEN 'error' THEN 'overlap' ELSE 'margin (0.01)' END")
    return iv(spark, d).filter("stop is not null").select((F.col("event_type") == "view").alias("accepted"), why.alias("reason"), F.lit(0.0).alias("start"), F.round(F.col("stop") - F.col("t")).alias("stop"))


@query(f"SELECT trim(split_part(reason, '(', 1)) AS reason, round(sum(s), 1)::DOUBLE AS seconds FROM ({DECISIONS}) q WHERE NOT accepted GROUP BY 1")
def abstentions_by_reason(spark, d):
    return R.abstentions(decisions(spark, d))


@query(f"SELECT round(sum(s), 1)::DOUBLE AS total_seconds, round(sum(s) FILTER (accepted), 1)::DOUBLE AS attributed_seconds, round(sum(s) FILTER (accepted) / sum(s), 3)::DOUBLE AS attributed_share FROM ({DECISIONS}) q")
def attributed_share(spark, d):
    return R.attributed(decisions(spark, d))


EVAL = f"SELECT g.verdict AS expected, CASE WHEN g.id % 5 = 0 THEN 'unverified' ELSE m.verdict END AS given, CASE WHEN g.id % 2 = 0 THEN 'mecanique' ELSE 'depend_du_seuil' END AS robustness FROM ({GOLD}) g JOIN ({MADE}) m USING (id)"


@query(f"""SELECT count(*) AS judged, count(*) FILTER (given = 'unverified') AS abstentions, count(*) FILTER (expected = 'unverified') AS abstentions_expected, count(*) FILTER (robustness = 'mecanique') AS mechanical,
 count(*) FILTER (robustness = 'mecanique' AND given = expected) AS mechanical_right, count(*) FILTER (given = 'false' AND expected <> 'false') AS false_reds FROM ({EVAL}) e""")
def evaluation_metrics(spark, d):
    g, m = gold_tables(spark, d)
    j = g.withColumnRenamed("verdict", "expected").join(m.withColumnRenamed("verdict", "given"), "id")
    return R.evaluation(j.select("expected", F.when(F.col("id") % 5 == 0, "unverified").otherwise(F.col("given")).alias("given"), F.when(F.col("id") % 2 == 0, "mecanique").otherwise("depend_du_seuil").alias("robustness")))


@query(f"SELECT (SELECT string_agg(verdict || '=' || n, ',' ORDER BY verdict) FROM (SELECT verdict, count(*) AS n FROM ({CASES}) c GROUP BY 1) q) AS verdicts, (SELECT string_agg(agreement || '=' || n, ',' ORDER BY agreement) FROM (SELECT agreement, count(*) AS n FROM ({CASES}) c GROUP BY 1) q) AS categories")
def verdict_maps(spark, d):
    m = R.verdict_maps(cases(spark, d).select("verdict", F.col("agreement").alias("category")))
    line = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias(c)
    return m.select(line("verdicts"), line("categories"))


@query("SELECT l_linestatus AS source, count(*) FILTER (l_returnflag = 'A') AS \"A\", count(*) FILTER (l_returnflag = 'N') AS \"N\", count(*) FILTER (l_returnflag = 'R') AS \"R\" FROM lineitem GROUP BY 1")
def bench_tally(spark, d):
    return R.tally(table(spark, d, "lineitem").select(F.col("l_linestatus").alias("source"), "l_returnflag"), "source", "l_returnflag", ["A", "N", "R"])


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_type, t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t) AS r FROM ({EV}) x), w AS (SELECT user_id, event_type, r, t AS last, 1 AS n FROM e WHERE r = 1
 UNION ALL SELECT e.user_id, e.event_type, e.r, CASE WHEN e.t - w.last >= 86400 THEN e.t ELSE w.last END, CASE WHEN e.t - w.last >= 86400 THEN w.n + 1 ELSE w.n END FROM w JOIN e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.r = w.r + 1),
 c AS (SELECT user_id, event_type, max(n) AS n, min(last) FILTER (r = 1) AS first FROM w GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first, event_type DESC) AS place, sum(n) OVER (PARTITION BY user_id) AS total FROM c)
 SELECT user_id AS cluster, event_type AS id, n::INTEGER AS mentions, round(n / total, 6)::DOUBLE AS share FROM k WHERE place = 1""")
def name_votes(spark, d):
    ship_package(spark)
    v = ev(spark, d).select(F.col("user_id").alias("cluster"), F.col("event_type").alias("id"), "t")
    return R.name_votes(v, 86400.0).withColumn("share", F.round("share", 6))


@query("""WITH c AS (SELECT p_partkey AS cluster, p_brand || p_size AS id, 0.4 + (p_partkey % 7) / 10.0 AS share, p_partkey % 9 AS mentions, 0.5 + (p_partkey % 5) / 10.0 AS cohesion FROM part),
 s AS (SELECT * FROM c WHERE round(share, 6) >= 0.6 AND mentions >= 3 AND round(cohesion, 6) >= 0.6) SELECT cluster FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM s) q WHERE n = 1""")
def named_clusters(spark, d):
    c = table(spark, d, "part").select(F.col("p_partkey").alias("cluster"), F.concat("p_brand", F.col("p_size").cast("string")).alias("id"), F.round(0.4 + (F.col("p_partkey") % 7) / 10.0, 6).alias("share"), (F.col("p_partkey") % 9).alias("mentions"), F.round(0.5 + (F.col("p_partkey") % 5) / 10.0, 6).alias("cohesion"))
    return R.named_clusters(c).select("cluster")


CLIPS = "SELECT l_orderkey, l_quantity > 5 AS usable, CASE WHEN l_linenumber % 4 <> 0 OR l_orderkey % 2 = 0 THEN CASE WHEN l_orderkey % 3 = 0 THEN 'S1' ELSE 'S' || l_returnflag END END AS who FROM lineitem"


@query(f"""SELECT l_orderkey, CASE WHEN count(DISTINCT who) FILTER (usable) > 1 THEN 'plusieurs' WHEN count(*) FILTER (usable) >= 3 AND count(who) FILTER (usable) = count(*) FILTER (usable) THEN min(who) FILTER (usable) ELSE '' END AS confirmed FROM ({CLIPS}) c GROUP BY 1""")
def confirmation(spark, d):
    who = F.when((F.col("l_linenumber") % 4 != 0) | (F.col("l_orderkey") % 2 == 0), F.when(F.col("l_orderkey") % 3 == 0, "S1").otherwise(F.concat(F.lit("S"), "l_returnflag")))
    return R.confirmation(table(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity") > 5).alias("usable"), who.alias("who")), "l_orderkey")


SECTION = "CASE WHEN p_size < 17 THEN 'speeches' WHEN p_size < 34 THEN 'programme' ELSE 'other' END"


@query(f"""WITH p AS (SELECT p_brand AS slug, count(*) FILTER (s = 'speeches') AS speeches, count(*) FILTER (s = 'programme') AS programme, count(*) FILTER (s = 'other') AS other FROM (SELECT p_brand, {SECTION} AS s FROM part) q GROUP BY 1),
 t AS (SELECT *, speeches + programme + other AS total FROM p)
 SELECT *, speeches >= 3 AS voice_enrolable, programme > 0 AS coherence_available, row_number() OVER (ORDER BY total DESC, slug)::INTEGER AS place, (SELECT median(total) FROM t)::DOUBLE AS median FROM t""")
def dossier_report(spark, d):
    return R.dossier_report(table(spark, d, "part").select(F.col("p_brand").alias("slug"), F.expr(SECTION).alias("section")), "slug", ["speeches", "programme", "other"], "speeches", "programme").withColumn("place", F.col("place").cast("int"))


@query(r"SELECT conv_id, count(*) AS blocks, round(max(turn + 1) / 60.0, 2)::DOUBLE AS minutes, sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')))::BIGINT AS words, (max(turn + 1) / 2.0)::DOUBLE AS speed FROM conversations GROUP BY 1")
def transcript_size(spark, d):
    return R.transcript_size(blocks(spark, d), "conv_id", F.lit(2.0))


@query("SELECT l_orderkey AS statement_id, l_suppkey % 3 + 1 AS rank, count(*) AS n FROM lineitem GROUP BY 1, 2")
def audit_records(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("statement_id")).agg(F.collect_list(F.struct(F.lit("land").alias("domain"), (F.col("l_suppkey") % 3 + 1).alias("rank"), F.lit("q").alias("quote"))).alias("sources")).withColumns({"verdict": F.lit("exact"), "confidence": F.lit(0.9)})
    return R.audit_records(s, "v1").groupBy("statement_id", "rank").agg(F.count("*").alias("n"))
