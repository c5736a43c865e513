"""The queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens.llm import ann, bpe, exact_dedup, lm, packing, pii, quality, simhash, source_audit, substring_dedup, target_resample, token_counts, url_filter
from claimlens.storage import ship_package, table


def op1_token_counts(spark, sf_dir):
    ship_package(spark)
    return token_counts.suffix_sums(token_counts.length_histogram(table(spark, sf_dir, "documents")))


def op2_url_filter(spark, sf_dir):
    ship_package(spark)
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.RULES)


def op3_simhash(spark, sf_dir):
    ship_package(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark, sf_dir):
    ship_package(spark)
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="max")


def op5_lm_scores(spark, sf_dir):
    ship_package(spark)
    return lm.score(table(spark, sf_dir, "documents"))


def op6_packing(spark, sf_dir):
    ship_package(spark)
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op7_pii(spark, sf_dir):
    ship_package(spark)
    return pii.digests(pii.personal_data(table(spark, sf_dir, "documents")))


def op8_quality(spark, sf_dir):
    ship_package(spark)
    scored = quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.drop("text_key")


def op9_nearest(spark, sf_dir):
    ship_package(spark)
    return ann.nearest(table(spark, sf_dir, "embeddings"), "id % 50 = 0")


def op10_bpe(spark, sf_dir):
    ship_package(spark)
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"))


def op11_target_resample(spark, sf_dir):
    ship_package(spark)
    return target_resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_source_audit(spark, sf_dir):
    ship_package(spark)
    return source_audit.audit(table(spark, sf_dir, "documents"))


def op13_substring_dedup(spark, sf_dir):
    ship_package(spark)
    found = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


_ALL = (op1_token_counts, op2_url_filter, op3_simhash, op4_exact_dedup, op5_lm_scores, op6_packing, op7_pii, op8_quality, op9_nearest, op10_bpe, op11_target_resample, op12_source_audit, op13_substring_dedup)
QUERIES = {f.__name__: f for f in _ALL}

_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES = {
    "op2_url_filter": f"""
        WITH u AS (SELECT row_number() OVER () AS r, page_id,
                          coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
                          coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
             rules(verdict, h, p) AS (VALUES {_RULES}),
             hits AS (SELECT u.r, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
                      FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY u.r)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN hits USING (r)""",
    "op4_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) AS s FROM documents),
             n AS (SELECT *, max(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
                          row_number() OVER (PARTITION BY s ORDER BY doc_id DESC NULLS LAST) = 1 AS kept FROM d)
        SELECT doc_id, keep_id, group_size, kept, s AS text_sha256 FROM n""",
}

#: op11: lower-cased words of a table's texts, and the runs of one and two of them.
_NAMES = lambda of: rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {of}"
_RUNS = lambda of: f"SELECT r, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM {of}"

ORACLES |= {
    "op11_target_resample": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_NAMES('documents')}),
         b AS (SELECT 0 AS r, {_NAMES('benchmark')}),
         df AS ({_RUNS('d')}), bf AS ({_RUNS('b')}),
         dc AS (SELECT f, r, count(*) AS n FROM df GROUP BY ALL), bc AS (SELECT f, count(*) AS n FROM bf GROUP BY ALL),
         steps AS (SELECT list_transform(range(256), lambda v: list_reduce(list_prepend(v, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab),
         hexed AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM dc UNION SELECT f FROM bc) u),
         crc AS (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
                        lambda a, y: xor(a >> 8, tab[(xor(a, y) & 255) + 1]))) % 10000 AS bucket FROM hexed, steps),
         s AS (SELECT bucket, sum(n) AS n FROM dc JOIN crc USING (f) GROUP BY 1), t AS (SELECT bucket, sum(n) AS n FROM bc JOIN crc USING (f) GROUP BY 1),
         gains AS (SELECT k.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
                          / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
                   FROM (SELECT unnest(range(10000)) AS bucket) k LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
         w AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS g FROM dc JOIN crc USING (f) JOIN gains USING (bucket) GROUP BY 1),
         sc AS (SELECT d.r, doc_id, len(d.w) AS words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce((g - ((g % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
                       ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (r)),
         z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM sc),
         p AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id ASC NULLS LAST) AS place, count(*) FILTER (words >= 20) OVER () AS n FROM z)
        SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM p""",
    "op12_source_audit": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
         t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
         k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
         c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
         g AS (SELECT DISTINCT lang, source FROM d),
         a AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
         p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM a),
         lt AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
         l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM lt),
         pv AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
         rows_ AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(pv.value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
                     LEFT JOIN pv ON pv.lang = x.lang AND pv.source = x.source AND pv.item = y.source
                   UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM rows_) z WHERE part = 'pair' OR rank <= 200""",
    "op13_substring_dedup": r"""
        WITH d AS (SELECT row_number() OVER (ORDER BY doc_id ASC NULLS LAST) AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
         p AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
         s AS (SELECT r, i, word, string_agg(word, ' ') OVER x AS run, count(*) OVER x AS n FROM p WINDOW x AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
         g AS (SELECT r, i, word, n = 20 AND row_number() OVER (PARTITION BY run ORDER BY n = 20 DESC, r, i) > 1 AS again FROM s),
         c AS (SELECT r, i, word, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM g),
         k AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)""",
}
