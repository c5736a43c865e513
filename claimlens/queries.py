"""Registry of the queries over the driver's tables and their SQL.

The tables do not hold the domain, so statements are rendered from rows by the same expression in both engines.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimlens.functions import numbers as N
from claimlens.functions import text as T
from claimlens.functions.triggers import deserves_verification, triggers
from claimlens.operators import aggregates as A
from claimlens.operators import clusters as C
from claimlens.operators import folds as FO
from claimlens.operators import guardrails as G
from claimlens.operators import joins as J
from claimlens.operators import windows as W
from claimlens.plans import chain as P
from claimlens.storage import materialise, ship_package, spread, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- stated values against their source

LINE = "sum(l_extendedprice * (1 - l_discount) * (1 + l_tax))"
STATED = f"SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice AS stated, src FROM orders LEFT JOIN (SELECT l_orderkey, {LINE} AS src FROM lineitem GROUP BY l_orderkey) s ON o_orderkey = l_orderkey"
BUCKET = "CASE WHEN src IS NULL THEN 'unverified' WHEN round(abs(stated - src) / abs(src), 6) <= 0.05 THEN 'exact' WHEN round(abs(stated - src) / abs(src), 6) <= 0.25 THEN 'approximate' ELSE 'beyond' END"
VERDICTS = f"SELECT o_orderkey, o_custkey, o_orderdate, CASE {BUCKET} WHEN 'beyond' THEN 'false' ELSE {BUCKET} END AS verdict, 0.5 + 0.1 * (o_orderkey % 5) AS confidence FROM ({STATED}) q"


def stated(spark, d):
    src = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.expr(LINE).alias("src"))
    return table(spark, d, "orders").join(src, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_custkey", "o_orderdate", F.col("o_totalprice").alias("stated"), "src")


def relative_gap():
    return F.round(F.abs(F.col("stated") - F.col("src")) / F.abs(F.col("src")), 6)


def occurrences(spark, d):
    b = N.bucket(relative_gap(), N.RELATIVE_BARS)
    return stated(spark, d).select("o_orderkey", "o_custkey", "o_orderdate", F.when(b == "beyond", "false").otherwise(b).alias("verdict"), (F.lit(0.5) + F.lit(0.1) * (F.col("o_orderkey") % 5)).alias("confidence"))


@query(f"SELECT {BUCKET} AS verdict, count(*) AS n FROM ({STATED}) q GROUP BY 1")
def stated_vs_source(spark, d):
    return stated(spark, d).groupBy(N.bucket(relative_gap(), N.RELATIVE_BARS).alias("verdict")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN g <= 0.3 THEN 'exact' WHEN g <= 1.0 THEN 'approximate' ELSE 'beyond' END AS verdict, count(*) AS n FROM (SELECT round(abs(l_discount - l_tax) * 100, 6) AS g FROM lineitem) q GROUP BY 1")
def points_gap(spark, d):
    g = F.round(F.abs(F.col("l_discount") - F.col("l_tax")) * 100, 6)
    return table(spark, d, "lineitem").select(g.alias("g")).groupBy(N.bucket(F.col("g"), N.POINT_BARS).alias("verdict")).agg(F.count("*").alias("n"))


SWEEP = [(e, a) for e in (0.1, 0.3, 0.5) for a in (0.5, 1.0, 2.0)]
LABEL = "CASE l_linenumber % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'approximate' ELSE 'false' END"


@query(f"""WITH i AS (SELECT round(abs(l_discount - l_tax) * 100, 6) AS gap, {LABEL} AS label FROM lineitem),
 g(exact_bar, approx_bar) AS (VALUES {', '.join(f'({e}::DOUBLE, {a}::DOUBLE)' for e, a in SWEEP)})
 SELECT 'points' AS unit, exact_bar, approx_bar, count(*) FILTER ((CASE WHEN gap <= exact_bar THEN 'exact' WHEN gap <= approx_bar THEN 'approximate' ELSE 'false' END) = label) AS reproduced, count(*) AS items
 FROM i JOIN g ON approx_bar > exact_bar GROUP BY 2, 3""")
def threshold_sweep(spark, d):
    items = table(spark, d, "lineitem").select(F.round(F.abs(F.col("l_discount") - F.col("l_tax")) * 100, 6).alias("gap"), F.expr(LABEL).alias("label"), F.lit("points").alias("unit"))
    return A.threshold_sweep(items, spark.createDataFrame(SWEEP, "exact_bar double, approx_bar double"))


KIND = "CASE o_orderkey % 3 WHEN 0 THEN 'percent' WHEN 1 THEN 'magnitude' ELSE 'year' END"


@query(f"""SELECT o_orderkey, CASE WHEN {KIND} = 'percent' THEN 'points' WHEN {KIND} = 'magnitude' THEN 'relative' END AS unit,
 CASE WHEN {KIND} = 'percent' THEN round(abs(stated - src), 1) WHEN {KIND} = 'magnitude' THEN round(abs(stated - src) / abs(src), 5) END AS gap FROM ({STATED}) q""")
def measured_gap(spark, d):
    k = F.expr(KIND)
    gap, unit = N.value_pair(k, F.col("stated"), k, F.col("src"))
    # a missing source is no zero source
    return stated(spark, d).select("o_orderkey", unit.alias("unit"), F.when(F.col("src").isNotNull(), F.when(unit == "points", F.round(gap, 1)).otherwise(F.round(gap, 5))).alias("gap"))


# ---- guardrails

CASES = """SELECT l_orderkey * 10 + l_linenumber AS statement_id,
 CASE l_linenumber % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'approximate' WHEN 2 THEN 'false' ELSE 'too_vague' END AS verdict, 0.9 AS confidence,
 round(abs(l_discount - l_tax) * 100, 6) AS gap, 'points' AS unit, CASE l_returnflag WHEN 'A' THEN 'confirmed' WHEN 'N' THEN 'no_quantity' ELSE 'divergent' END AS agreement,
 CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS rank, l_suppkey % 5 <> 0 AS quoted, l_partkey % 2 = 0 AS corroborated FROM lineitem"""


def cases(spark, d):
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("statement_id"),
        F.expr("CASE l_linenumber % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'approximate' WHEN 2 THEN 'false' ELSE 'too_vague' END").alias("verdict"),
        F.lit(0.9).alias("confidence"),
        F.round(F.abs(F.col("l_discount") - F.col("l_tax")) * 100, 6).alias("gap"),
        F.lit("points").alias("unit"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 'confirmed' WHEN 'N' THEN 'no_quantity' ELSE 'divergent' END").alias("agreement"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("rank"),
        (F.col("l_suppkey") % 5 != 0).alias("quoted"),
        (F.col("l_partkey") % 2 == 0).alias("corroborated"),
    ).withColumn("note", F.lit(None).cast("string"))


BARS = "CASE WHEN v NOT IN ('exact', 'approximate', 'false') THEN v WHEN gap <= 0.3 THEN 'exact' WHEN gap <= 1.0 THEN 'approximate' WHEN v = 'false' AND rank = 1 THEN 'false' WHEN v = 'exact' THEN 'unverified' ELSE 'approximate' END"


@query(f"""WITH c AS ({CASES}), g AS (SELECT *, CASE WHEN agreement = 'divergent' THEN 'unverified' ELSE verdict END AS v0, CASE WHEN agreement = 'divergent' THEN 0.0 ELSE confidence END AS c0 FROM c),
 q AS (SELECT * EXCLUDE (c0), CASE WHEN NOT quoted THEN 'unverified' ELSE v0 END AS v1, CASE WHEN NOT quoted THEN least(c0, 0.3) ELSE c0 END AS c0 FROM g), r AS (SELECT *, CASE WHEN v1 = 'false' AND rank <> 1 THEN 'unverified' ELSE v1 END AS v FROM q),
 t AS (SELECT *, {BARS} AS w, CASE WHEN v = 'exact' AND gap > 1.0 THEN least(c0, 0.3) ELSE c0 END AS c1 FROM r)
 SELECT verdict, confidence, count(*) AS n FROM (SELECT CASE WHEN w = 'false' AND NOT corroborated THEN 'unverified' ELSE w END AS verdict, CASE WHEN w = 'false' AND NOT corroborated THEN least(c1, 0.3) ELSE c1 END::DOUBLE AS confidence FROM t) z GROUP BY 1, 2""")
def guardrail_chain(spark, d):
    c = cases(spark, d).withColumn("sources", F.array(F.struct(F.lit("q").alias("quote"), F.col("quoted").alias("quote_verified"), F.col("rank").alias("rank")))).drop("rank")
    return G.chain(c, strict=True, unlocked=True).groupBy("verdict", F.col("confidence").cast("double").alias("confidence")).agg(F.count("*").alias("n"))


@query(f"WITH r AS (SELECT *, verdict AS v FROM ({CASES}) c) SELECT verdict, {BARS} AS checked, rank, count(*) AS n FROM r GROUP BY 1, 2, 3")
def threshold_verdicts(spark, d):
    v, _ = N.threshold_verdict(*(F.col(x) for x in ("verdict", "confidence", "gap", "unit", "rank")))
    return cases(spark, d).groupBy("verdict", v.alias("checked"), "rank").agg(F.count("*").alias("n"))


@query(f"SELECT agreement, CASE WHEN agreement = 'divergent' THEN 'unverified' ELSE verdict END AS verdict, agreement <> 'divergent' AS allowed, count(*) AS n FROM ({CASES}) c GROUP BY 1, 2, 3")
def gate(spark, d):
    return G.gate(cases(spark, d)).groupBy("agreement", "verdict", "allowed").agg(F.count("*").alias("n"))


@query(f"SELECT CASE WHEN verdict = 'false' THEN 'unverified' ELSE verdict END AS verdict, CASE WHEN verdict = 'false' THEN 0.3 ELSE 0.9 END::DOUBLE AS confidence, count(*) AS n FROM ({CASES}) c GROUP BY 1, 2")
def guard_red(spark, d):
    return G.red_guard(cases(spark, d), unlocked=False).groupBy("verdict", F.col("confidence").cast("double").alias("confidence")).agg(F.count("*").alias("n"))


@query(f"SELECT rank, CASE WHEN verdict = 'false' AND rank <> 1 THEN 'unverified' ELSE verdict END AS verdict, count(*) AS n FROM ({CASES}) c GROUP BY 1, 2")
def rank_cap(spark, d):
    return G.rank_cap(cases(spark, d)).groupBy("rank", "verdict").agg(F.count("*").alias("n"))


@query(f"SELECT verdict, rank, CASE verdict WHEN 'false' THEN rank = 1 WHEN 'exact' THEN rank IN (1, 2) ELSE true END AS allowed, count(*) AS n FROM ({CASES}) c GROUP BY 1, 2, 3")
def allowed_by_rank(spark, d):
    return cases(spark, d).groupBy("verdict", "rank", N.allowed_by_rank(F.col("verdict"), F.col("rank")).alias("allowed")).agg(F.count("*").alias("n"))


@query(f"SELECT verdict, count(*) AS n FROM ({CASES}) c WHERE verdict IN ('exact', 'approximate', 'false') AND quoted AND NOT corroborated GROUP BY 1")
def promotable(spark, d):
    c = cases(spark, d).withColumn("sources", F.array(F.struct(F.col("quoted").alias("quote_verified")))).withColumn("withdrawn", F.col("corroborated"))
    return G.promotable(c).groupBy("verdict").agg(F.count("*").alias("n"))


@query(f"""WITH c AS ({CASES}), s AS (SELECT verdict AS weak, CASE WHEN quoted THEN CASE WHEN corroborated THEN 'exact' ELSE verdict END END AS strong FROM c)
 SELECT CASE WHEN strong IS NULL OR strong = weak THEN weak ELSE 'unverified' END AS verdict, CASE WHEN strong IS NULL THEN 0.9 WHEN strong = weak THEN 0.95 ELSE 0.3 END::DOUBLE AS confidence, count(*) AS n FROM s GROUP BY 1, 2""")
def escalation(spark, d):
    c = cases(spark, d).withColumn("strong", F.when(F.col("quoted"), F.when(F.col("corroborated"), "exact").otherwise(F.col("verdict"))))
    v, p = N.escalate(F.col("verdict"), F.col("confidence"), F.col("strong"), F.lit(0.95))
    return c.groupBy(v.alias("v"), p.alias("p")).agg(F.count("*").alias("n")).select(F.col("v").alias("verdict"), F.col("p").cast("double").alias("confidence"), "n")


@query(f"""WITH c AS ({CASES}), runs AS (SELECT statement_id // 10 AS k, verdict FROM c) SELECT verdict, count(*) AS n FROM (SELECT k, CASE WHEN min(verdict) = max(verdict) THEN min(verdict) ELSE 'unverified' END AS verdict FROM runs GROUP BY k) q GROUP BY 1""")
def run_dispersion(spark, d):
    r = cases(spark, d).select(F.floor(F.col("statement_id") / 10).alias("statement_id"), "verdict")
    return G.dispersion(r).groupBy("verdict").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS statements, count(*) AS verified, count(*) FILTER (verdict = 'unverified') AS unverified, round(count(*) FILTER (verdict = 'unverified') / count(*), 6) AS abstention, count(*) FILTER (verdict = 'false') AS reds FROM ({VERDICTS}) v")
def run_stats(spark, d):
    return A.run_stats(occurrences(spark, d))


# ---- ledger

SETTLED = "verdict IN ('exact', 'approximate', 'false')"


@query(f"""SELECT o_custkey, count(*) AS occurrences, count(*) FILTER ({SETTLED}) AS settled, max(confidence)::DOUBLE AS highest,
 CASE WHEN count(*) FILTER ({SETTLED}) < 2 THEN 'single' WHEN count(DISTINCT verdict) FILTER ({SETTLED}) = 1 THEN 'corroborated' ELSE 'conflicted' END AS status FROM ({VERDICTS}) v GROUP BY 1""")
def ledger_status(spark, d):
    return A.ledger_status(occurrences(spark, d), "o_custkey").withColumn("highest", F.col("highest").cast("double"))


@query(f"""SELECT o_custkey, round(least(max(confidence) + least(0.05 * greatest(count(*) FILTER ({SETTLED}) - 1, 0), 0.10), 0.98), 6)::DOUBLE AS confidence FROM ({VERDICTS}) v GROUP BY 1""")
def corroborated_confidence(spark, d):
    s = A.ledger_status(occurrences(spark, d), "o_custkey")
    return s.select("o_custkey", F.round(N.corroborated_confidence(F.col("highest"), F.col("settled")), 6).cast("double").alias("confidence"))


@query(f"""WITH v AS ({VERDICTS}), l AS (SELECT *, count(*) FILTER ({SETTLED}) OVER w AS settled, min(CASE WHEN {SETTLED} THEN verdict END) OVER w AS lo, max(CASE WHEN {SETTLED} THEN verdict END) OVER w AS hi,
   count(*) FILTER (verdict <> 'unverified') OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
   FROM v WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)),
 s AS (SELECT *, CASE WHEN settled < 2 THEN 'single' WHEN lo = hi THEN 'corroborated' ELSE 'conflicted' END AS status FROM l),
 b AS (SELECT *, lag(status) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM s)
 SELECT o_orderkey, status, CASE WHEN status = 'conflicted' AND coalesce(before, '') <> 'conflicted' THEN earlier ELSE 0 END AS retracts FROM b""")
def ledger_revisions(spark, d):
    return W.ledger(occurrences(spark, d), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "status", F.col("retracts").cast("long").alias("retracts"))


@query(f"SELECT o_custkey, arg_min(verdict, o_orderkey) AS verdict, count(*) AS occurrences FROM ({VERDICTS}) v GROUP BY 1")
def first_finding(spark, d):
    return occurrences(spark, d).groupBy("o_custkey").agg(F.min_by("verdict", "o_orderkey").alias("verdict"), F.count("*").alias("occurrences"))


@query(f"SELECT v.o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'unverified' ELSE verdict END AS verdict FROM ({VERDICTS}) v")
def apply_revisions(spark, d):
    o = occurrences(spark, d).withColumnRenamed("o_orderkey", "statement_id")
    r = o.filter("statement_id % 7 = 0").select("statement_id", F.lit("unverified").alias("new_verdict"), F.lit(0.3).alias("new_confidence"))
    return G.apply_revisions(o, r).select(F.col("statement_id").alias("o_orderkey"), "verdict")


@query(f"SELECT o_orderkey, o_orderkey % 11 = 0 AS withdrawn, CASE WHEN o_orderkey % 11 <> 0 THEN verdict END AS verdict FROM ({VERDICTS}) v")
def withdrawals(spark, d):
    o = occurrences(spark, d).withColumnRenamed("o_orderkey", "statement_id")
    return G.withdraw(o, o.filter("statement_id % 11 = 0").select("statement_id")).select(F.col("statement_id").alias("o_orderkey"), "withdrawn", "verdict")


# ---- rendered statements and triggers

RENDER = "concat('En ', year(o_orderdate), ', la hausse est de ', o_orderkey % 90, ' % par rapport a ', 1 + o_custkey % 40, ' milliards d''euros pour ', o_orderkey % 500, ' logements', CASE o_orderkey % 4 WHEN 0 THEN ', le plus haut record.' WHEN 1 THEN ' grace a nous.' WHEN 2 THEN ', la plupart disent.' ELSE '.' END)"
SHORT = "CASE o_orderkey % 6 WHEN 0 THEN 'je vais agir' WHEN 1 THEN 'la plupart le disent' WHEN 2 THEN 'bonjour' WHEN 3 THEN concat(o_orderkey % 90, ' % des gens') WHEN 4 THEN 'selon vous rien' ELSE 'des milliers attendent et je vais repondre' END"


def rendered(spark, d, e=RENDER):
    return table(spark, d, "orders").select("o_orderkey", F.expr(e.replace("''", "\\'")).alias("text"))


@query(f"""WITH s AS (SELECT {RENDER} AS t FROM orders),
 m AS (SELECT regexp_matches(t, '[0-9]+ %') AS pct, regexp_matches(t, 'euros') AS amount, regexp_matches(t, '^En [0-9]') AS y, regexp_matches(t, 'le plus haut|record') AS sup, t FROM s),
 k(type, n) AS (SELECT 'percentage', count(*) FROM m WHERE pct UNION ALL SELECT 'amount', count(*) FROM m WHERE amount UNION ALL SELECT 'date_or_period', count(*) FROM m WHERE y
  UNION ALL SELECT 'superlative', 2 * count(*) FROM m WHERE sup UNION ALL SELECT 'comparative', count(*) FROM m UNION ALL SELECT 'vague_quantifier', count(*) FROM m WHERE contains(t, 'la plupart')
  UNION ALL SELECT 'causality', count(*) FROM m WHERE contains(t, 'grace a') UNION ALL SELECT 'number', count(*) FROM m WHERE contains(t, 'logements'))
 SELECT type, n, sum(n) OVER ()::BIGINT AS total, round(sum(n) OVER () / 60.0, 2)::DOUBLE AS per_minute FROM k WHERE n > 0""")
def trigger_density(spark, d):
    ship_package(spark)
    return A.trigger_density(spread(rendered(spark, d)).select(triggers(F.col("text")).alias("triggers")), 60.0)


@query(f"SELECT count(*) AS statements, count(*) FILTER (o_orderkey % 6 <> 2) AS with_triggers, count(*) FILTER (o_orderkey % 6 IN (3, 4)) AS candidates, count(*) FILTER (o_orderkey % 6 <> 2 OR length({SHORT}) > 40) AS degree2 FROM orders")
def trigger_funnel(spark, d):
    ship_package(spark)
    s = spread(rendered(spark, d, SHORT)).withColumn("tr", triggers(F.col("text")))
    return s.agg(F.count("*").alias("statements"), F.count_if(F.size("tr") > 0).alias("with_triggers"), F.count_if(deserves_verification(F.col("tr"))).alias("candidates"), F.count_if((F.size("tr") > 0) | (F.length("text") > 40)).alias("degree2"))


@query("""WITH q AS (SELECT o_orderkey, 'year' AS kind, year(o_orderdate)::DOUBLE AS value FROM orders UNION ALL SELECT o_orderkey, 'percent', (o_orderkey % 90)::DOUBLE FROM orders
 UNION ALL SELECT o_orderkey, 'magnitude', (1 + o_custkey % 40) * 1e9 FROM orders UNION ALL SELECT o_orderkey, 'magnitude', (o_orderkey % 500)::DOUBLE FROM orders)
 SELECT kind, count(*) AS n, sum(value)::DOUBLE AS total FROM q GROUP BY 1""")
def figures_extract(spark, d):
    ship_package(spark)
    q = spread(rendered(spark, d)).select(F.explode_outer(N.quantities(F.col("text"))).alias("q")).filter("q.kind is not null")
    return q.groupBy("q.kind").agg(F.count("*").alias("n"), F.sum("q.value").alias("total"))


@query("""WITH a AS (SELECT o_custkey, 1 + o_custkey % 40 AS v FROM orders GROUP BY 1), p AS (SELECT 1 + p_size % 40 AS v, count(*) AS n FROM part GROUP BY 1)
 SELECT a.o_custkey, coalesce(p.n, 0) AS matches FROM a LEFT JOIN p ON a.v = p.v""")
def quantity_match(spark, d):
    ship_package(spark)
    q = lambda df, k: df.select(k, F.explode_outer(N.not_years(N.quantities(F.col("t")))).alias("q")).filter("q.kind is not null").select(k, "q.kind", "q.value")
    a = q(table(spark, d, "orders").select("o_custkey").distinct().select("o_custkey", F.expr("concat(1 + o_custkey % 40, ' milliards')").alias("t")), "o_custkey")
    p = q(table(spark, d, "part").select("p_partkey", F.expr("concat(1 + p_size % 40, ' milliards')").alias("t")), "p_partkey").groupBy("kind", "value").agg(F.count("*").alias("n"))
    return a.join(p, ["kind", "value"], "left").select("o_custkey", F.coalesce("n", F.lit(0)).alias("matches"))


# ---- text of documents

@query(r"""SELECT doc_id, len(s) AS n, list_max(list_transform(s, lambda x: length(x))) AS longest FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?…])\s+([A-ZÀÉÈÊÎÔÙ])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents) q""")
def sentence_split(spark, d):
    s = T.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.array_max(F.transform(s, F.length)).cast("long").alias("longest"))


_STOP = ", ".join(f"'{w}'" for w in T.CLAIM_STOPWORDS)


# digit groups are joined without lookaround: one pass joins every second gap, so a second one joins the rest
_JOIN = "regexp_replace({}, '([0-9])[\\s\u00a0\u202f]([0-9])', '\\1\\2', 'g')"


@query(f"""SELECT md5(array_to_string(list_filter(regexp_extract_all({_JOIN.format(_JOIN.format(f"lower(translate(text, '{T.ACCENTED}', '{T.PLAIN}'))"))}, '[a-z0-9]+(?:[.,][0-9]+)?'), lambda t: t NOT IN ({_STOP})), ' ')) AS claim_key, count(*) AS n, min(doc_id) AS first
 FROM documents GROUP BY 1 HAVING count(*) > 1""")
def repeated_claims(spark, d):
    return table(spark, d, "documents").groupBy(F.md5(T.claim_key(F.col("text"))).alias("claim_key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[0-9]{7,}')) AS n FROM documents WHERE regexp_matches(text, '[0-9]{7,}')")
def aberrant_integers(spark, d):
    n = F.size(T.aberrant_integers(F.col("text")))
    return table(spark, d, "documents").select("doc_id", n.cast("long").alias("n")).filter("n > 0")


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?…])\s+([A-ZÀÉÈÊÎÔÙ])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents),
 e AS (SELECT doc_id, unnest(s) AS t, generate_subscripts(s, 1) - 1 AS i FROM s)
 SELECT doc_id, i::INTEGER AS "index", round(10.0 * sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i) / sum(length(t)) OVER (PARTITION BY doc_id), 4)::DOUBLE AS timestamp FROM e""")
def statement_times(spark, d):
    b = table(spark, d, "documents").select("doc_id", F.lit(0.0).alias("start"), F.lit(10.0).alias("stop"), "text", F.col("source").alias("speaker"))
    return P.split_statements(b, "doc_id").select("doc_id", "index", F.round("timestamp", 4).alias("timestamp"))


@query(f"SELECT doc_id, trim(regexp_replace(lower(translate(source || ' ' || lang, '{T.ACCENTED}', '{T.PLAIN}')), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents")
def slugs(spark, d):
    return table(spark, d, "documents").select("doc_id", T.slug(F.concat_ws(" ", "source", "lang")).alias("slug"))


@query()
def longest_repeats(spark, d):
    ship_package(spark)
    return table(spark, d, "documents").select("doc_id", T.longest_repeat(F.col("text")).alias("longest"))


@query(r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM pages")
def page_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.strip_tags(F.col("html"))).alias("text_md5"))


@query("SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&t=' ELSE '?t=' END || (page_id % 4000) || 's' AS url, CASE WHEN page_id % 4000 >= 3600 THEN '1:' || lpad(((page_id % 4000 - 3600) // 60)::VARCHAR, 2, '0') ELSE (page_id % 4000 // 60)::VARCHAR END || ':' || lpad((page_id % 4000 % 60)::VARCHAR, 2, '0') AS clock FROM pages")
def url_timestamp(spark, d):
    s = F.col("page_id") % 4000
    return table(spark, d, "pages").select("page_id", T.with_time(F.col("url"), s).alias("url"), T.clock(s).alias("clock"))


RANKS = [("example.org", 1), ("m.example.com", 2), ("example.net/en", 2), ("example.com", 3)]


@query(f"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(lower(url), '^https?://', ''), '^www\\.', '') AS ref FROM pages), e(entry, rank) AS (VALUES {', '.join(map(str, RANKS))})
 SELECT page_id, (SELECT min(rank) FROM e WHERE CASE WHEN contains(entry, '/') THEN rtrim(ref, '/') = entry OR starts_with(ref, entry || '/') ELSE split_part(ref, '/', 1) = entry OR ends_with(split_part(ref, '/', 1), '.' || entry) END) AS rank FROM p""")
def domain_rank(spark, d):
    return table(spark, d, "pages").select("page_id", T.domain_rank(F.col("url"), RANKS).alias("rank"))


@query("SELECT item_id, (SELECT min(doc_id) FROM documents d WHERE contains(trim(regexp_replace(lower(d.text), '\\s+', ' ', 'g')), trim(regexp_replace(lower(b.text), '\\s+', ' ', 'g')))) AS source_id FROM benchmark b WHERE length(text) >= 12")
def quote_provenance(spark, d):
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    q = table(spark, d, "benchmark").filter(F.length("text") >= 12).select("item_id", flat(F.col("text")).alias("flat"))
    s = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), flat(F.col("text")).alias("flat"))
    return J.containment(q, s)


@query("SELECT conv_id, role, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY 1, 2")
def speaker_text(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return g.select("conv_id", "role", F.array_join("t.text", " ").alias("text"))


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1")
def json_props(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.from_json("props", "k bigint")["k"]).alias("k"))


# ---- gold comparison and sets

GOLD = "SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'exact' WHEN toxic = 1 THEN 'false' ELSE 'approximate' END AS verdict FROM labels"
MADE = "SELECT doc_id AS id, CASE WHEN n_chars > 2000 THEN 'exact' WHEN n_chars > 1000 THEN 'approximate' ELSE 'false' END AS verdict FROM documents"


def gold_tables(spark, d):
    g = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "exact").when(F.col("toxic") == 1, "false").otherwise("approximate").alias("verdict"))
    m = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") > 2000, "exact").when(F.col("n_chars") > 1000, "approximate").otherwise("false").alias("verdict"))
    return g, m


@query(f"""WITH j AS (SELECT g.verdict AS g, m.verdict AS p FROM ({GOLD}) g FULL JOIN ({MADE}) m ON g.id = m.id)
 SELECT count(*) FILTER (g IS NOT NULL AND p IS NOT NULL) AS compared, round(count(*) FILTER (g = p) / greatest(count(*) FILTER (g IS NOT NULL AND p IS NOT NULL), 1), 3)::DOUBLE AS agreement,
 count(*) FILTER (p = 'false' AND g IN ('exact', 'approximate')) AS false_positives, count(*) FILTER (g = 'false' AND p <> 'false') AS missed_falses, count(*) FILTER (p IS NULL) AS only_gold, count(*) FILTER (g IS NULL) AS only_produced FROM j""")
def gold_compare(spark, d):
    return A.gold_compare(*gold_tables(spark, d))


@query(f"SELECT id, 'gold' AS side FROM (SELECT id FROM ({GOLD}) EXCEPT SELECT id FROM ({MADE})) UNION ALL SELECT id, 'both' FROM (SELECT id FROM ({GOLD}) INTERSECT SELECT id FROM ({MADE})) UNION ALL SELECT id, 'made' FROM (SELECT id FROM ({MADE}) EXCEPT SELECT id FROM ({GOLD}))")
def only_in_reference(spark, d):
    g, m = (x.select("id") for x in gold_tables(spark, d))
    return g.subtract(m).withColumn("side", F.lit("gold")).unionByName(g.intersect(m).withColumn("side", F.lit("both"))).unionByName(m.subtract(g).withColumn("side", F.lit("made")))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def verdict_counters(spark, d):
    return table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


# ---- events as intervals, islands and neighbours

EV = "SELECT event_id, user_id, event_type, value, epoch(ts)::DOUBLE AS t FROM events"
IV = f"SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS stop FROM ({EV}) e"


def ev(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))


def iv(spark, d):
    return ev(spark, d).withColumn("stop", F.lead("t").over(Window.partitionBy("user_id").orderBy("t", "event_id")))


ISLANDS = "SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY t, event_id) AS island FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) THEN 0 ELSE 1 END AS c FROM ({EV}) e) q".replace("{EV}", EV)


@query(f"SELECT user_id, island::BIGINT AS island, min(event_type) AS event_type, count(*) AS n, round(max(t) - min(t), 3)::DOUBLE AS seconds, round(max(value), 6)::DOUBLE AS top FROM ({ISLANDS}) i GROUP BY 1, 2")
def islands(spark, d):
    i = W.islands(ev(spark, d), ["user_id"], ["t", "event_id"], F.col("event_type"))
    return i.groupBy("user_id", "island").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.round(F.max("t") - F.min("t"), 3).alias("seconds"), F.round(F.max("value"), 6).alias("top"))


@query(f"WITH g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= 21600 THEN 0 ELSE 1 END AS c FROM ({EV}) e), i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY t, event_id) AS island FROM g) SELECT user_id, island::BIGINT AS island, count(*) AS n, round(max(t) - min(t), 3)::DOUBLE AS seconds FROM i GROUP BY 1, 2")
def gap_merge(spark, d):
    i = W.gap_merge(ev(spark, d), ["user_id"], ["t", "event_id"], F.col("t"), F.col("t"), 21600.0)
    return i.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.round(F.max("t") - F.min("t"), 3).alias("seconds"))


@query(f"""WITH RECURSIVE e AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS r FROM ({EV}) x), w AS (SELECT user_id, r, t, t AS start, 0 AS block FROM e WHERE r = 1
 UNION ALL SELECT e.user_id, e.r, e.t, CASE WHEN e.t - w.start < 86400 THEN w.start ELSE e.t END, CASE WHEN e.t - w.start < 86400 THEN w.block ELSE w.block + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1)
 SELECT user_id, block::INTEGER AS block, count(*)::INTEGER AS n, round(max(t) - min(t), 3)::DOUBLE AS seconds FROM w GROUP BY 1, 2""")
def capped_blocks(spark, d):
    e = ev(spark, d).withColumn("u", F.col("t"))
    ship_package(spark)
    return FO.capped_blocks(e, ["user_id"], "t", "u", "event_id", 86400.0).select("user_id", "block", "n", F.round(F.col("stop") - F.col("start"), 3).alias("seconds"))


@query(f"WITH i AS ({ISLANDS}), r AS (SELECT user_id, island, count(*) AS n FROM i GROUP BY 1, 2) SELECT user_id, sum(n - 1)::BIGINT AS repeats, round(sum(n - 1) / sum(n), 4)::DOUBLE AS share, max(n) AS longest FROM r GROUP BY 1")
def repetition_runs(spark, d):
    r = W.islands(ev(spark, d), ["user_id"], ["t", "event_id"], F.col("event_type")).groupBy("user_id", "island").agg(F.count("*").alias("n"))
    return r.groupBy("user_id").agg(F.sum(F.col("n") - 1).alias("repeats"), F.round(F.sum(F.col("n") - 1) / F.sum("n"), 4).alias("share"), F.max("n").alias("longest"))


@query(f"SELECT user_id, event_id FROM (SELECT *, coalesce(count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM ({EV}) e) q WHERE u < 3")
def active_clips(spark, d):
    return W.active_clips(ev(spark, d), ["user_id"], ["t", "event_id"], F.col("event_type") != "error").select("user_id", "event_id")


@query(f"""WITH RECURSIVE e AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS r FROM ({EV}) x), w AS (SELECT user_id, r, t AS last, 1 AS n FROM e WHERE r = 1
 UNION ALL SELECT e.user_id, e.r, CASE WHEN e.t - w.last >= 172800 THEN e.t ELSE w.last END, CASE WHEN e.t - w.last >= 172800 THEN w.n + 1 ELSE w.n END FROM w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1)
 SELECT user_id, max(n)::INTEGER AS mentions FROM w GROUP BY 1""")
def spaced_mentions(spark, d):
    ship_package(spark)
    return FO.spaced(ev(spark, d), ["user_id"], "t", 172800.0).select("user_id", F.col("n").alias("mentions"))


@query(f"""WITH i AS ({IV}), c AS (SELECT event_id, user_id, t - 20000 AS a, t + 20000 AS b FROM i WHERE event_type = 'click'), k AS (SELECT event_id AS turn, user_id, t AS a, stop AS b FROM i WHERE stop IS NOT NULL AND stop - t < 400000 AND event_type <> 'click'),
 o AS (SELECT c.event_id, turn, greatest(0, least(c.b, k.b) - greatest(c.a, k.a)) / (c.b - c.a) AS share FROM c JOIN k ON c.user_id = k.user_id AND c.b > k.a AND c.a < k.b),
 r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY share DESC, turn) AS n FROM o)
 SELECT c.event_id, CASE WHEN share >= 0.5 THEN turn END AS turn_seq, round(share, 6)::DOUBLE AS share FROM c LEFT JOIN r ON r.event_id = c.event_id AND n = 1""")
def interval_best_overlap(spark, d):
    i = iv(spark, d)
    c = i.filter("event_type = 'click'").select("event_id", "user_id", (F.col("t") - 20000).alias("l_start"), (F.col("t") + 20000).alias("l_stop"))
    k = i.filter("stop is not null and stop - t < 400000 and event_type <> 'click'").select(F.col("event_id").alias("turn_seq"), "user_id", F.col("t").alias("r_start"), F.col("stop").alias("r_stop"))
    return J.best_overlap(c, k, "event_id", 100000.0, by=["user_id"]).select("event_id", "turn_seq", F.round("share", 6).alias("share"))


@query(f"SELECT round(sum(s), 3)::DOUBLE AS total, round(sum(s) FILTER (event_type = 'error'), 3)::DOUBLE AS unattributed, round(sum(s) FILTER (event_type = 'view'), 3)::DOUBLE AS not_analysed, round(sum(s) FILTER (event_type NOT IN ('error', 'view')), 3)::DOUBLE AS analysed_seconds FROM (SELECT event_type, round(stop - t) AS s FROM ({IV}) i WHERE stop IS NOT NULL) q")
def coverage_report(spark, d):
    b = iv(spark, d).filter("stop is not null").select(F.round(F.col("stop") - F.col("t")).alias("seconds"), (F.col("event_type") != "error").alias("identified"), (F.col("event_type") != "view").alias("analysed"))
    return A.speech_coverage(b)


@query(f"""WITH i AS (SELECT * FROM ({IV}) q WHERE stop IS NOT NULL), m AS (SELECT event_id, user_id, t, stop FROM i WHERE event_type = 'purchase'),
 s AS (SELECT m.event_id AS mention_id, i.event_type AS cluster, sum(i.stop - i.t) AS seconds, min(i.event_id) AS f FROM m JOIN i ON m.user_id = i.user_id AND i.t BETWEEN m.stop + 5 AND m.stop + 200000 GROUP BY 1, 2),
 a AS (SELECT m.event_id AS mention_id, arg_min(i.event_type, i.event_id) AS asker FROM m JOIN i ON m.user_id = i.user_id AND m.t BETWEEN i.t AND i.stop GROUP BY 1),
 r AS (SELECT s.*, row_number() OVER (PARTITION BY s.mention_id ORDER BY seconds DESC, f) AS n FROM s LEFT JOIN a USING (mention_id) WHERE cluster IS DISTINCT FROM asker AND seconds >= 10)
 SELECT mention_id, cluster FROM r WHERE n = 1""")
def look_ahead_votes(spark, d):
    i = iv(spark, d).filter("stop is not null")
    m = i.filter("event_type = 'purchase'").select(F.col("event_id").alias("mention_id"), "user_id", F.col("t").alias("start"), "stop")
    s = i.select(F.col("event_id").alias("seq"), "user_id", F.col("event_type").alias("cluster"), F.col("t").alias("s_start"), F.col("stop").alias("s_stop"))
    return J.look_ahead_votes(m, s, 5.0, 200000.0, 10.0, 200000.0, by=["user_id"])


@query(f"SELECT v.event_id, round((SELECT min(abs(c.t - v.t)) FROM ({EV}) c WHERE c.user_id = v.user_id AND c.event_type = 'click'), 3)::DOUBLE AS distance FROM ({EV}) v WHERE event_type = 'view'")
def nearest_figure(spark, d):
    e = ev(spark, d)
    return J.nearest_occurrence(e.filter("event_type = 'view'"), e.filter("event_type = 'click'"), ["user_id"], "event_id", "t", "t").select("event_id", F.round("distance", 3).alias("distance"))


@query()
def greedy_pairs(spark, d):
    ship_package(spark)
    e = ev(spark, d).select("user_id", F.col("event_id").alias("id"), "t", "event_type")
    return J.greedy_nearest(e.filter("event_type = 'view'").drop("event_type"), e.filter("event_type = 'click'").drop("event_type"), "user_id", 3600.0)


@query(f"""WITH s AS (SELECT v.event_id, (SELECT min(abs(c.t - v.t)) FROM ({EV}) c WHERE c.user_id = v.user_id AND c.event_type = 'click') AS x FROM ({EV}) v WHERE event_type = 'view'),
 k AS (SELECT CASE WHEN x IS NULL THEN 'absent' WHEN x <= 86400 THEN 'confirmed' ELSE 'divergent' END AS status FROM s)
 SELECT count(*) AS statements, count(*) AS with_figures, count(*) FILTER (status = 'confirmed') AS corroborated, round(count(*) FILTER (status = 'confirmed') / count(*), 3)::DOUBLE AS corroborated_share, round(count(*) FILTER (status <> 'confirmed') / count(*), 3)::DOUBLE AS blocked_share FROM k""")
def agreement_report(spark, d):
    x = F.col("distance")
    n = nearest_figure(spark, d).select(F.when(x.isNull(), "absent").when(x <= 86400, "confirmed").otherwise("divergent").alias("status"))
    return A.agreement_report(n)


PAD = 43200


@query(f"""WITH e AS (SELECT *, floor(value) AS f FROM ({EV}) x), v AS (SELECT * FROM e WHERE event_type = 'view'), w AS (SELECT * FROM e WHERE event_type IN ('click', 'purchase')),
 j AS (SELECT v.event_id, w.event_type AS witness, bool_or(w.f = v.f) AS hit FROM v JOIN w ON w.t BETWEEN v.t - {PAD} AND v.t + {PAD} GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY CASE WHEN hit THEN 0 ELSE 1 END, witness) AS n FROM j)
 SELECT v.event_id AS statement_id, CASE WHEN n IS NULL THEN 'absent' WHEN hit THEN 'confirmed' ELSE 'divergent' END AS status, witness FROM v LEFT JOIN r ON r.event_id = v.event_id AND n = 1""")
def family_witness(spark, d):
    e = ev(spark, d).withColumn("f", F.floor("value").cast("double"))
    none = F.array().cast("array<string>")
    req = e.filter("event_type = 'view'").select(F.col("event_id").alias("statement_id"), F.lit("view").alias("family"), F.col("t").alias("start"), F.col("t").alias("stop"), F.array(F.struct(F.lit("magnitude").alias("kind"), F.col("f").alias("value"))).alias("figures"), none.alias("words"))
    heard = e.filter("event_type in ('click', 'purchase')").select(F.col("event_type").alias("witness"), F.when(F.col("event_type") == "click", 1).otherwise(2).alias("witness_seq"), F.col("event_type").alias("w_family"), "t", F.lit("magnitude").alias("kind"), F.col("f").alias("value"), none.alias("around"), F.lit(0).alias("position"))
    return J.corroborate(req, heard, float(PAD), 0.2)


ANCHOR = "((v.user_id % 4 = w.user_id % 4)::INT + (v.event_id % 3 = w.event_id % 3)::INT + (v.user_id % 5 = w.user_id % 5)::INT) / 3.0"


@query(f"""WITH e AS (SELECT *, floor(value) AS f FROM ({EV}) x), v AS (SELECT * FROM e WHERE event_type = 'view'), w AS (SELECT * FROM e WHERE event_type IN ('click', 'purchase')),
 j AS (SELECT v.event_id, abs(w.t - v.t) AS away, {ANCHOR} AS anchor FROM v JOIN w ON w.f = v.f AND w.t BETWEEN v.t - {PAD} AND v.t + {PAD}),
 g AS (SELECT * FROM (VALUES ({PAD / 4}), ({PAD / 2}), ({PAD}.0)) p(pad), (VALUES (0.0), (0.3), (0.6)) a(min_anchor)),
 r AS (SELECT pad, min_anchor, count(DISTINCT event_id) AS c FROM g LEFT JOIN j ON away <= pad AND anchor >= min_anchor GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM v)
 SELECT pad::DOUBLE AS pad, min_anchor::DOUBLE AS min_anchor, n AS statements, n AS with_figures, c AS corroborated, round(c / greatest(n, 1), 3)::DOUBLE AS coverage, true AS kept FROM r, n""")
def settings_sweep(spark, d):
    e = ev(spark, d).withColumn("f", F.floor("value").cast("double"))
    words = F.array(*(F.concat(F.lit(p), F.expr(x).cast("string")) for p, x in (("a", "user_id % 4"), ("b", "event_id % 3"), ("c", "user_id % 5"))))
    req = e.filter("event_type = 'view'").select(F.col("event_id").alias("statement_id"), F.lit("view").alias("family"), F.col("t").alias("start"), F.col("t").alias("stop"), F.array(F.struct(F.lit("magnitude").alias("kind"), F.col("f").alias("value"))).alias("figures"), words.alias("words"))
    heard = e.filter("event_type in ('click', 'purchase')").select(F.col("event_type").alias("witness"), F.when(F.col("event_type") == "click", 1).otherwise(2).alias("witness_seq"), F.lit("heard").alias("w_family"), "t", F.lit("magnitude").alias("kind"), F.col("f").alias("value"), words.alias("around"), F.lit(0).alias("position"))
    return J.settings_sweep(req, heard, [PAD / 4, PAD / 2, float(PAD)], [0.0, 0.3, 0.6])


WITNESS = "CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 END"
FAMILY = "CASE WHEN event_type = 'view' THEN substr('ABC', CAST(1 + user_id % 3 AS INT), 1) WHEN event_type = 'purchase' THEN 'B' ELSE 'A' END"
LISTED = "coalesce(string_agg({}, ',' ORDER BY {}){}, '')"


@query(f"""WITH e AS (SELECT *, floor(value) AS f, {FAMILY} AS family, {WITNESS} AS seq FROM ({EV}) x), v AS (SELECT * FROM e WHERE event_type = 'view' AND event_id % 9 <> 0),
 q AS (SELECT event_id, family, t, i, f + i AS f FROM v, (VALUES (0), (1)) g(i)),
 n AS (SELECT v.event_id, w.event_id AS place, w.event_type AS witness, w.seq, w.t, w.f, {ANCHOR} AS anchor FROM v JOIN e w ON w.seq IS NOT NULL AND w.family <> v.family AND w.t BETWEEN v.t - {PAD} AND v.t + {PAD}),
 h AS (SELECT q.event_id, i, witness, seq, bool_or(anchor >= 0.3) AS anchored FROM q JOIN n ON n.event_id = q.event_id AND n.f = q.f GROUP BY ALL),
 p AS (SELECT s.event_id, s.witness, s.seq, count(*) FILTER (anchored) = 2 AS whole FROM (SELECT DISTINCT event_id, witness, seq FROM n) s LEFT JOIN h ON h.event_id = s.event_id AND h.witness = s.witness GROUP BY ALL),
 b AS (SELECT event_id, arg_min(witness, seq + CASE WHEN whole THEN 0 ELSE 10 END) AS witness, bool_or(whole) AS whole FROM p GROUP BY 1),
 c AS (SELECT e.event_id, CASE WHEN e.event_id % 9 = 0 THEN 'no_quantity' WHEN b.event_id IS NULL THEN 'absent' WHEN whole THEN 'confirmed' ELSE 'divergent' END AS status,
        CASE WHEN e.event_id % 9 <> 0 THEN coalesce(b.witness, CASE WHEN family = 'A' THEN 'purchase' ELSE 'click' END) END AS witness FROM e LEFT JOIN b ON b.event_id = e.event_id WHERE event_type = 'view'),
 f AS (SELECT q.event_id, {LISTED.format("q.f::BIGINT", "q.i", " FILTER (anchored)")} AS matched, {LISTED.format("q.f::BIGINT", "q.i", " FILTER (anchored IS NOT TRUE)")} AS missing, {LISTED.format("q.f::BIGINT", "q.i", " FILTER (NOT anchored)")} AS unanchored
       FROM q JOIN c ON c.event_id = q.event_id LEFT JOIN h ON h.event_id = q.event_id AND h.i = q.i AND h.witness = c.witness GROUP BY 1),
 k AS (SELECT c.event_id, n.f, row_number() OVER (PARTITION BY c.event_id ORDER BY n.t, n.place) AS r FROM c JOIN n ON n.event_id = c.event_id AND n.witness = c.witness WHERE status = 'divergent'),
 l AS (SELECT event_id, string_agg(f::BIGINT, ',' ORDER BY r) AS heard FROM k WHERE r <= 6 GROUP BY 1)
 SELECT c.event_id AS statement_id, status, witness, coalesce(matched, '') AS matched, coalesce(missing, '') AS missing, coalesce(unanchored, '') AS unanchored, coalesce(heard, '') AS heard
 FROM c LEFT JOIN f ON f.event_id = c.event_id LEFT JOIN l ON l.event_id = c.event_id""")
def corroboration_evidence(spark, d):
    """Every view states its value and the next one; clicks, purchases and errors are three transcriptions of two families."""
    e = ev(spark, d).withColumns({"f": F.floor("value").cast("double"), "family": F.expr(FAMILY), "witness_seq": F.expr(WITNESS)})
    words = F.array(*(F.concat(F.lit(p), F.expr(x).cast("string")) for p, x in (("a", "user_id % 4"), ("b", "event_id % 3"), ("c", "user_id % 5"))))
    figure = lambda x: F.struct(F.lit("magnitude").alias("kind"), x.alias("value"), x.cast("long").cast("string").alias("raw"))
    figures = F.when(F.col("event_id") % 9 != 0, F.array(figure(F.col("f")), figure(F.col("f") + 1))).otherwise(F.array().cast("array<struct<kind:string,value:double,raw:string>>"))
    req = e.filter("event_type = 'view'").select(F.col("event_id").alias("statement_id"), "family", F.col("t").alias("start"), F.col("t").alias("stop"), figures.alias("figures"), words.alias("words"))
    said = e.filter("witness_seq is not null").select(F.col("event_type").alias("witness"), "witness_seq", F.col("family").alias("w_family"), "t", F.lit("magnitude").alias("kind"), F.col("f").alias("value"), F.col("f").cast("long").cast("string").alias("raw"), F.col("event_id").alias("place"), words.alias("around"), F.lit(0).alias("position"))
    who = said.select("witness", "witness_seq", "w_family").distinct()
    return J.evidence(req, said, who, float(PAD), 0.3).select("statement_id", "status", "witness", *(F.array_join(c, ",").alias(c) for c in ("matched", "missing", "unanchored", "heard")))


# ---- voices

@query("""WITH u AS (SELECT label, unnest(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
 m AS (SELECT label, i, avg(v) AS m FROM u GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY 1)
 SELECT label::VARCHAR AS speaker_id, (SELECT count(*) FROM embeddings e WHERE e.label = n.label) AS members, round(n.n, 4)::DOUBLE AS cohesion FROM n""")
def voice_enrol(spark, d):
    """The mean cosine of members with their scaled mean is the mean's own length."""
    return prints(spark, d).select("speaker_id", "members", F.round("cohesion", 4).alias("cohesion"))


def prints(spark, d):
    return materialise(A.centroids(table(spark, d, "embeddings").select(F.col("label").cast("string").alias("label"), "embedding"), "label", "embedding"), "prints")


CENTRE = """WITH u AS (SELECT label, unnest(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
 m AS (SELECT label, i, avg(v) AS m FROM u GROUP BY 1, 2), c AS (SELECT label::VARCHAR AS id, list(m ORDER BY i) AS c FROM m GROUP BY 1)"""


@query(CENTRE + """, s AS (SELECT vec_id, id, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), c) AS s FROM embeddings, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, id) AS n FROM s),
 t AS (SELECT vec_id, max(id) FILTER (n = 1) AS id, max(s) FILTER (n = 1) AS a, max(s) FILTER (n = 2) AS b FROM r GROUP BY 1)
 SELECT vec_id, CASE WHEN round(a, 6) >= 0.2 AND round(a - b, 6) >= 0.06 THEN id END AS speaker_id, CASE WHEN round(a, 6) < 0.2 THEN 'below threshold' WHEN round(a - b, 6) < 0.06 THEN 'margin' ELSE 'accepted' END AS reason FROM t""")
def voice_identify(spark, d):
    ship_package(spark)
    return J.identify(table(spark, d, "embeddings"), prints(spark, d), "vec_id", "embedding", 0.20, 0.06).select("vec_id", "speaker_id", "reason")


@query()
def voice_clusters(spark, d):
    """Every label's vectors as one recording, at five distances; SQL cannot express the merging."""
    ship_package(spark)
    e = table(spark, d, "embeddings").withColumn("recording", F.col("label").cast("string"))
    return C.average_clusters(e, "recording", "vec_id", "embedding")


@query()
def cluster_sweep(spark, d):
    return C.cluster_sweep(voice_clusters(spark, d), "recording")


@query(CENTRE + " SELECT id AS speaker_id FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.id <> c.id AND list_cosine_similarity(o.c, c.c) > 0.2)")
def centroid_separation(spark, d):
    ship_package(spark)
    return J.separated(prints(spark, d), 0.20).select("speaker_id")


WIN = "SELECT l_orderkey AS turn, l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS seq, CASE WHEN l_quantity > 10 THEN 'S' || (l_suppkey % 3) END AS speaker_id, l_discount AS similarity FROM lineitem"


def voice_windows(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("turn"), (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_quantity") > 10, F.concat(F.lit("S"), F.col("l_suppkey") % 3)).alias("speaker_id"), F.col("l_discount").alias("similarity"))


MAJ = f"""WITH w AS ({WIN}), g AS (SELECT turn, speaker_id, count(*) AS c, min(seq) AS f FROM w WHERE speaker_id IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY turn ORDER BY c DESC, f) AS n FROM g),
 t AS (SELECT turn, count(*) AS n_windows, count(speaker_id) AS accepted FROM w GROUP BY 1), m AS (SELECT t.*, r.speaker_id, c / accepted AS share FROM t LEFT JOIN r ON r.turn = t.turn AND n = 1)"""


@query(MAJ + " SELECT turn, n_windows, accepted, speaker_id, round(share, 6)::DOUBLE AS share FROM m")
def majority_identity(spark, d):
    return A.majority_identity(voice_windows(spark, d), "turn").select("turn", "n_windows", "accepted", "speaker_id", F.round("share", 6).alias("share"))


LADDER = "CASE WHEN turn % 10 = 0 THEN 'overlap' WHEN n_windows < 2 THEN 'too few windows' WHEN accepted = 0 THEN 'none accepted' WHEN share < 0.75 THEN 'disagreement' WHEN speaker_id = 'S2' THEN 'unknown print' ELSE 'attributed' END"


@query(MAJ + f" SELECT turn, {LADDER} AS reason, CASE WHEN {LADDER} = 'attributed' THEN speaker_id END AS speaker_id FROM m")
def consensus(spark, d):
    w = voice_windows(spark, d)
    over = w.select("turn").distinct().withColumn("overlap", F.col("turn") % 10 == 0)
    return A.consensus(A.majority_identity(w, "turn"), over, spark.createDataFrame([("S0",), ("S1",)], "speaker_id string"), "turn").select("turn", "reason", "speaker_id")


# ---- dossiers, clips, briefs

@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS n FROM lineitem) q WHERE n <= 5")
def top_clips(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("n")).filter("n <= 5").drop("n")


@query("SELECT l_orderkey, arg_max(w, (s, w)) AS who, max(s)::DOUBLE AS seconds FROM (SELECT l_orderkey, 'S' || (l_suppkey % 4) AS w, sum(l_quantity) AS s FROM lineitem GROUP BY 1, 2) q GROUP BY 1")
def dominant_speaker(spark, d):
    r = table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("S"), F.col("l_suppkey") % 4).alias("who"), F.col("l_quantity").alias("q"))
    return A.dominant(r, ["l_orderkey"], "who", "q")


FORMS = [("housing", "logement"), ("money", "milliard"), ("money", "euro"), ("record", "record")]
DOMAINS = [("housing", "land"), ("money", "budget"), ("money", "debt"), ("record", "nowhere")]
KEYS = [("land", "k3"), ("land", "k4"), ("budget", "k1"), ("budget", "k2"), ("debt", "k0")]
MEASURES = [("housing", "built"), ("money", "deficit"), ("money", "spending"), ("record", "peak")]


@query("SELECT o_orderkey, 'housing,money' || CASE WHEN o_orderkey % 4 = 0 THEN ',record' ELSE '' END AS terms, 'budget,debt,land' AS domains, 'k0,k1,k2' AS source_keys, true AS trap FROM orders")
def brief_compose(spark, d):
    b = P.compose_brief(rendered(spark, d).withColumnRenamed("o_orderkey", "statement_id"), spark.createDataFrame(FORMS, "term string, form string"), spark.createDataFrame(DOMAINS, "term string, domain string"), spark.createDataFrame(KEYS, "domain string, source_key string"), spark.createDataFrame(MEASURES, "term string, measure string"))
    return b.select(F.col("statement_id").alias("o_orderkey"), *(F.array_join(c, ",").alias(c) for c in ("terms", "domains", "source_keys")), "trap")


@query("SELECT 'money' AS term, count(*) AS n FROM orders UNION ALL SELECT 'housing', count(*) FROM orders UNION ALL SELECT 'record', count(*) FROM orders WHERE o_orderkey % 4 = 0")
def keyword_join(spark, d):
    s = rendered(spark, d).select("o_orderkey", T.normalise(F.col("text")).alias("flat"))
    return J.keyword_terms(s, spark.createDataFrame(FORMS, "term string, form string"), "o_orderkey", "flat").groupBy("term").agg(F.count("*").alias("n"))


# ---- specified behaviour

@query("""WITH s AS (SELECT DISTINCT ON (p_brand, p_size) p_brand AS measure, p_size AS vintage, max(p_retailprice) OVER (PARTITION BY p_brand, p_size) AS value FROM part), c AS (SELECT p_partkey AS claim_id, p_brand AS measure, 25 AS upto FROM part)
 SELECT claim_id, (SELECT arg_max(value, vintage) FROM s WHERE s.measure = c.measure AND vintage <= upto)::DOUBLE AS value_then, (SELECT arg_max(value, vintage) FROM s WHERE s.measure = c.measure)::DOUBLE AS value_now FROM c""")
def staleness(spark, d):
    p = table(spark, d, "part")
    s = p.groupBy(F.col("p_brand").alias("measure"), F.col("p_size").alias("vintage")).agg(F.max("p_retailprice").alias("value"))
    return P.staleness(p.select(F.col("p_partkey").alias("claim_id"), F.col("p_brand").alias("measure"), F.lit(25).alias("at")), s).select("claim_id", "value_then", "value_now")


@query("SELECT l_orderkey AS claim_id, arg_max(v, (n, -v)) AS value FROM (SELECT l_orderkey, (l_quantity::BIGINT % 5)::DOUBLE AS v, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1, 2) q WHERE n >= 2 GROUP BY 1")
def three_family_arbitration(spark, d):
    return P.arbitrate(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_returnflag").alias("family"), (F.col("l_quantity").cast("long") % 5).cast("double").alias("value")))


@query(f"SELECT o_custkey AS speaker, verdict, count(*) AS n FROM ({VERDICTS}) v GROUP BY 1, 2")
def speaker_counters(spark, d):
    return occurrences(spark, d).groupBy(F.col("o_custkey").alias("speaker"), "verdict").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_events(spark, d):
    """Extension: daily counts; the streaming form takes the same expression with a watermark."""
    return table(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("start"), "event_type").agg(F.count("*").alias("n")).withColumn("start", F.col("start").cast("timestamp_ntz"))


from claimlens import queries_chain as _chain, queries_records as _records, queries_speech as _speech, queries_streams as _streams, queries_texts as _texts  # noqa: E402, F401  (register their queries here)
