"""How far the sources of a language diverge, by joint count histograms.

Terms are counted per language and source; a language keeps the terms of at least ``least`` of its documents. Every source
(and the language as a whole) gives each kept term a smoothed probability in units of 1/SCALE, which depends on the term's count
alone. The divergence of two sources sums f over all kept terms, so it is enough to know how many terms have count c in one source and c' in
the other: the joint histogram of the pair. Tasks tally the (count, count) combinations of terms that both hold; the combinations with a
zero, terms that only one holds or neither, follow from each source's own histogram less what the pair shares, and from the number of kept terms. f is
evaluated once a combination, times its multiplicity. All arithmetic is exact: integers, and decimals where a product passes 64 bits.

Work per term is the pairs of sources that hold it, work per pair the distinct combinations; terms are dealt out over all tasks, so a language or a
source that holds most of the rows is split. The report itself has a row for each pair of sources of a language.

Cases: null text, language and source count as empty; a source without kept terms takes part with counts of zero; a language without kept terms has pairs of
value 0 and no terms; a very long text is counted in one pass; values that tie go by the item's UTF-8 order; repeated rows each count; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.rows import body_of
from claimlens.storage import materialise

SCALE = 1_000_000_000
_HELD = 300_000
_PAIRS = 1 << 20
_SALTS = 16
#: Letters and bytes from 0x80 on make terms, A-Z become lower case, all else ends a term.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; every group also has a row of the empty term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out():
            for (of, src), (n, d) in held.items():
                terms = list(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([of] * (len(terms) + 1), pa.string()), pa.array([src] * (len(terms) + 1), pa.string()), pa.array([b"", *terms], pa.binary()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(d.__getitem__, terms)], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )

        for b in batches:
            for i, (of, src, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))):
                n, d = held.setdefault((of, src), (Counter(), Counter()))
                terms = t.as_py().translate(_FOLD).split()
                n.update(terms)
                d.update(set(terms))
                if i % 64 == 0 and sum(len(x) for x, _ in held.values()) > _HELD:
                    yield from out()
                    held.clear()
        yield from out()

    rows = docs.select(body_of(lang).alias("lang"), body_of(source).alias("source"), body_of(text).cast("binary").alias("text"))
    counts = rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return counts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def tallies(kept: DataFrame) -> DataFrame:
    """(lang, a, b, ca, cb, m): terms of counts ca and cb in sources a < b; negative where they are to be taken off the combinations with a zero."""

    def distinct(pair, ca, cb, m):
        at = np.lexsort((cb, ca, pair))
        pair, ca, cb, m = pair[at], ca[at], cb[at], m[at]
        first = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (ca[1:] != ca[:-1]) | (cb[1:] != cb[:-1])]) if len(pair) else at
        return pair[first], ca[first], cb[first], np.add.reduceat(m, first) if len(first) else m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, dict[str, int]] = {}  # a language's sources, numbered as they appear
        held: dict[str, list[tuple]] = {}

        def out(of: str):
            pair, ca, cb, m = (np.concatenate(x) for x in zip(*held.pop(of)))
            pair, ca, cb, m = distinct(pair, ca, cb, m)
            zero = np.zeros_like(ca)
            parts = [(pair, ca, cb, m), distinct(pair, ca, zero, -m), distinct(pair, zero, cb, -m), distinct(pair, zero, zero, m)]
            pair, ca, cb, m = (np.concatenate(x) for x in zip(*parts))
            known = np.array(list(names[of]), object)
            a, b = known[pair >> 32], known[pair & 0xFFFFFFFF]
            turn = np.array([x.encode() > y.encode() for x, y in zip(a, b)], bool)
            a, b, ca, cb = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, cb, ca), np.where(turn, ca, cb)
            return pa.RecordBatch.from_arrays([pa.array([of] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(ca), pa.array(cb), pa.array(m)], ["lang", "a", "b", "ca", "cb", "m"])

        def add(of: str, pair, ca, cb):
            parts = held.setdefault(of, [])
            parts.append(distinct(pair, ca, cb, np.ones(len(pair), np.int64)))
            if sum(len(p[0]) for p in parts) > _PAIRS:
                held[of] = [distinct(*(np.concatenate(x) for x in zip(*parts)))]
                if len(held[of][0][0]) > _PAIRS // 2:
                    yield out(of)

        for b in batches:
            langs, lists = b.column(0).to_pylist(), b.column(1)
            sizes = lists.value_lengths().to_numpy()
            sources, counts = lists.flatten().field("source").to_pylist(), lists.flatten().field("n").to_numpy()
            term, of_row = np.repeat(np.arange(len(sizes)), sizes), np.array(langs, object)
            for of in set(langs):
                known = names.setdefault(of, {})
                mine = np.flatnonzero((of_row == of)[term])
                code = np.array([known.setdefault(sources[i], len(known)) for i in mine], np.int64)
                at = np.lexsort((code, term[mine]))
                t, code, n = term[mine][at], code[at], counts[mine][at]
                left, k = np.arange(len(t)), 1
                while True:  # a term's entry k places on; those without one drop out, so the steps cost no more than the pairs
                    left = left[left + k < len(t)]
                    left = left[t[left + k] == t[left]]
                    if not len(left):
                        break
                    for cut in range(0, len(left), _PAIRS):
                        x = left[cut : cut + _PAIRS]
                        yield from add(of, (code[x] << 32) | code[x + k], n[x], n[x + k])
                    k += 1
        for of in list(held):
            yield out(of)

    return kept.select("lang", "by").mapInArrow(run, "lang string, a string, b string, ca long, cb long, m long")


def _p(n: Column, total: Column, terms: Column) -> Column:
    """Smoothed probability of a count, from 1."""
    top, low = (F.lit(SCALE).cast("decimal(38,0)") * (n + 1)).cast("decimal(38,0)"), (total + terms).cast("decimal(38,0)")
    return F.call_function("div", top, low) + 1


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): for every source its divergence from each other one (``pair``) and the ``top`` terms it favours (``term``)."""
    counts = materialise(term_counts(docs, lang, source, text), "terms")
    per_term = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("by"))  # an entry a source
    kept = materialise(per_term.filter(F.col("docs") >= least).drop("docs"), "kept")
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_n"))
    shares = kept.select("lang", "term", "total", F.explode("by").alias("x")).select("lang", "x.source", "term", "x.n", "total")
    sums = shares.groupBy("lang", "source").agg(F.sum("n").alias("n_all"))
    groups = counts.filter("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = materialise(groups.select("lang", "source", F.coalesce("n_all", F.lit(0)).alias("n_all"), F.coalesce("terms", F.lit(0)).alias("terms"), "lang_n"), "groups")

    # a language's sources meet in several tasks
    others = groups.groupBy("lang").agg(F.collect_list(F.struct(F.col("source").alias("b"), F.col("n_all").alias("nb"))).alias("others")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    pairs = groups.select("lang", F.col("source").alias("a"), F.col("n_all").alias("na"), "terms", F.pmod(F.xxhash64("source"), F.lit(_SALTS)).cast("int").alias("salt")).join(others, ["lang", "salt"])
    pairs = materialise(pairs.select("lang", "a", "na", "terms", F.explode("others").alias("o")).filter("o.b > a").select("lang", "a", F.col("o.b").alias("b"), "na", F.col("o.nb").alias("nb"), "terms"), "pairs")
    own = shares.groupBy("lang", "source", "n").agg(F.count("*").alias("m")).groupBy("lang", "source").agg(F.collect_list(F.struct("n", "m")).alias("own"))  # an entry a distinct count
    zero, name = F.lit(0).cast("long"), ["lang", "a", "b", "ca", "cb", "m"]
    cells = tallies(kept).unionByName(pairs.select("lang", "a", "b", zero.alias("ca"), zero.alias("cb"), F.col("terms").alias("m")))
    for side, at in (("a", "ca"), ("b", "cb")):
        seen = pairs.select("lang", "a", "b").join(own.withColumnRenamed("source", side), ["lang", side]).select("lang", "a", "b", F.explode("own").alias("x"))
        cells = cells.unionByName(seen.select("lang", "a", "b", *((F.col("x.n") if c == at else zero).alias(c) for c in ("ca", "cb")), F.col("x.m").alias("m")).select(name))
        cells = cells.unionByName(seen.groupBy("lang", "a", "b").agg((-F.sum("x.m")).alias("m")).select("lang", "a", "b", zero.alias("ca"), zero.alias("cb"), "m"))
    cells = cells.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m")).filter("m <> 0")
    cells = cells.join(pairs, ["lang", "a", "b"]).withColumns({"pa": _p(F.col("ca"), F.col("na"), F.col("terms")), "pb": _p(F.col("cb"), F.col("nb"), F.col("terms"))})
    pa_, pb_ = F.col("pa"), F.col("pb")
    sums = cells.groupBy("lang", "a", "b").agg(F.sum(F.col("m") * _f(pa_, pb_)).alias("ab"), F.sum(F.col("m") * _f(pb_, pa_)).alias("ba"))
    both = pairs.select("lang", "a", "b").join(sums, ["lang", "a", "b"], "left").select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("ab").alias("value")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("ba").alias("value")))).alias("x"))
    both = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", F.coalesce("x.value", F.lit(0)).cast("long").alias("value"))

    favoured = shares.join(groups, ["lang", "source"]).withColumns({"p": _p(F.col("n"), F.col("n_all"), F.col("terms")), "q": _p(F.col("total"), F.col("lang_n"), F.col("terms"))}).filter("p > q")
    favoured = favoured.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("q")).cast("long").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return both.withColumn("rank", place).unionByName(favoured.withColumn("rank", place).filter(F.col("rank") <= top))
