"""Interval, nearest, containment, value and similarity joins.

Range predicates are turned into equi-joins on time buckets, so they
shuffle by key instead of planning as nested loops; a pair is found in the first bucket both sides share.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.functions.numbers import overlap_seconds
from claimlens.operators.scan import passes, quotes_within
from claimlens.operators.vectors import identify, separated  # noqa: F401
from claimlens.storage import materialise


# Fixed value: the letters a flattened quote needs to be looked for.
LEAST_QUOTE = 12

#: Letters of a glossary, with 16 a row besides, up to which it is sent to all tasks; a larger one is dealt by its forms' beginnings.
GLOSSARY = 8 << 20

#: Passes over the sources up to which quotes of four words or more are looked for by automata.
PASSES = 8


def _buckets(lo: Column, hi: Column, width: float) -> Column:
    return F.sequence(F.floor(lo / width), F.floor(F.greatest(lo, hi) / width))


def interval_pairs(left: DataFrame, right: DataFrame, width: float, by: list[str] | None = None, closed: bool = False) -> DataFrame:
    """All pairs whose [start, stop] overlap; left needs l_start, l_stop, right r_start, r_stop; ``by``: equal columns."""
    by = by or []
    a = left.withColumn("__b", F.explode(_buckets(F.col("l_start"), F.col("l_stop"), width)))
    b = right.withColumn("__b", F.explode(_buckets(F.col("r_start"), F.col("r_stop"), width)))
    touch = (F.col("l_stop") >= F.col("r_start")) & (F.col("l_start") <= F.col("r_stop")) if closed else (F.col("l_stop") > F.col("r_start")) & (F.col("l_start") < F.col("r_stop"))
    first = F.col("__b") == F.floor(F.greatest("l_start", "r_start") / width)
    return a.join(b, [*by, "__b"]).filter(touch & first).drop("__b")


def best_overlap(captions: DataFrame, turns: DataFrame, key: str, width: float = 60.0, min_share: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Every caption with its turn of the largest overlap share (ties: first turn_seq); below min_share the turn is null."""
    pairs = interval_pairs(captions, turns, width, by)
    length = F.col("l_stop") - F.col("l_start")
    share = F.when(length > 0, overlap_seconds(F.col("l_start"), F.col("l_stop"), F.col("r_start"), F.col("r_stop")) / length).otherwise(0.0)
    best = pairs.withColumn("share", share).groupBy(key).agg(F.max_by(F.struct("turn_seq", "share"), F.struct("share", -F.col("turn_seq"))).alias("b"))
    out = captions.join(best, key, "left")
    fine = F.col("b.share") >= min_share
    return out.withColumn("turn_seq", F.when(fine, F.col("b.turn_seq"))).withColumn("share", F.col("b.share")).drop("b")


def nearest_occurrence(left: DataFrame, right: DataFrame, on: list[str], key: str, left_time: str, right_time: str) -> DataFrame:
    """(key, distance): least time distance to an equal value, null where there is none.

    The right side's times are sorted once per value and the nearest is found with two window passes over the union,
    so a frequent value does not multiply rows.
    """
    u = left.select(*on, F.col(key).alias("k"), F.col(left_time).alias("t"), F.lit(1).alias("asks")).unionByName(right.select(*on, F.lit(None).cast(left.schema[key].dataType).alias("k"), F.col(right_time).alias("t"), F.lit(0).alias("asks")))
    w = Window.partitionBy(*on).orderBy("t", "asks")
    seen = F.when(F.col("asks") == 0, F.col("t"))
    u = u.withColumn("p", F.last(seen, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.first(seen, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return u.filter("asks = 1").select(F.col("k").alias(key), F.least(F.abs(F.col("t") - F.col("p")), F.abs(F.col("n") - F.col("t"))).alias("distance"))


def greedy_nearest(left: DataFrame, right: DataFrame, group: str, reach: float = 6.0) -> DataFrame:
    """One-to-one: left rows in order take the nearest unused right row within reach, the earlier one on ties.

    Both need group, id, t. Consumption depends on order, so a group's run of close rows stays together: gaps wider than
    the reach cut the group into independent runs first. Used rows are merged with their neighbours (union-find, to the next
    free row on either side), so a run of n rows costs n log n.
    """
    u = left.select(group, "id", F.col("t").cast("double").alias("t"), F.lit(0).alias("side")).unionByName(right.select(group, "id", F.col("t").cast("double").alias("t"), F.lit(1).alias("side")))
    w = Window.partitionBy(group).orderBy("t", "side", "id")
    u = u.withColumn("__cut", F.when(F.col("t") - F.lag("t").over(w) > reach, 1).otherwise(0)).withColumn("run", F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__cut")
    kind = left.schema["id"].dataType.simpleString()

    def pairs(f: pa.Table) -> Iterator[pa.RecordBatch]:
        """All runs of a table of whole runs, in order of run, t and id."""
        side, t, same = f["side"].to_numpy(), f["t"].to_numpy(), f.group_by([group, "run"], use_threads=False).aggregate([("t", "count")])["t_count"].to_pylist()
        one, two, at = [], [], 0
        for n in same:
            a, b = at + np.flatnonzero(side[at : at + n] == 0), at + np.flatnonzero(side[at : at + n] == 1)
            taken = [None if j is None else int(b[j]) for j in nearest_free(t[a].tolist(), t[b].tolist(), reach)]
            rest = sorted(set(b.tolist()) - set(taken))
            one += [*a.tolist(), *([None] * len(rest))]
            two += [*taken, *rest]
            at += n
        ids = f["id"].combine_chunks()
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(one, pa.int64())), ids.take(pa.array(two, pa.int64()))], ["left_id", "right_id"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            last = held.num_rows - 1
            begins = pc.or_(pc.not_equal(held["run"], held["run"][last]), pc.invert(_same(held[group], held[group][last])))
            cut = pc.sum(begins).as_py() or 0  # whole runs; the last one may go on
            if cut:
                yield from pairs(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield from pairs(held)

    dealt = u.repartition(group, "run").sortWithinPartitions(group, "run", "t", "id")
    return dealt.mapInArrow(match, f"left_id {kind}, right_id {kind}")


def _same(column: pa.ChunkedArray, value: pa.Scalar) -> pa.ChunkedArray:
    return pc.fill_null(pc.equal(column, value), False) if value.is_valid else pc.is_null(column)


def nearest_free(left: list[float], right: list[float], reach: float) -> list[int | None]:
    """For each left time in order the index of the nearest right time not yet taken, both sorted."""
    size = len(right)
    after, before = list(range(size + 1)), list(range(size + 1))  # free themselves, or a step towards the next free one; before is shifted by one

    def root(of: list[int], i: int) -> int:
        end = i
        while of[end] != end:
            end = of[end]
        while of[i] != end:
            of[i], i = end, of[i]
        return end

    out: list[int | None] = []
    for t in left:
        p = bisect_right(right, t)
        low, high = root(before, p) - 1, root(after, p)
        if low >= 0:
            low = root(after, bisect_left(right, right[low]))  # of equal times the first
        best = min(((abs(right[j] - t), right[j], j) for j in (low, high) if 0 <= j < size and abs(right[j] - t) <= reach), default=None)
        out.append(None if best is None else best[2])
        if best is not None:
            after[best[2]], before[best[2] + 1] = best[2] + 1, best[2]
    return out


def held_by(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """(item_id, source_id): every source that holds a quote; where both have a domain column, only sources of the quote's, if it is not null.

    Quotes of all lengths are looked for by automata, one pass over the sources each and no shuffle of texts. Where there are more than
    PASSES of them, a quote of four words or more, which may begin inside a word but whose second and third words are whole, meets the sources that
    hold that word pair, and only these are searched; the shorter ones still go by automata. A null quote or source text holds nothing, an empty
    quote lies in every text; of a repeated quote every item gets the sources.
    """
    narrow = "domain" in quotes.columns and "domain" in sources.columns
    reps = quotes.filter("flat is not null").groupBy("flat").agg(F.min("item_id").alias("rep"))
    pairs, parts = None, passes(reps)
    if parts > PASSES:
        short = F.size(F.split("flat", " ")) < 4
        pairs, reps = _by_word_pair(reps.filter(~short), sources, narrow), reps.filter(short)
        parts = passes(reps)
    hits = pairs
    if parts or hits is None:
        texts = sources if narrow else sources.select("source_id", "flat")
        found = quotes_within(reps, texts, max(parts, 1))
        hits = found if hits is None else hits.unionByName(found)
    of = quotes.select("item_id", "flat", *([F.col("domain").alias("q_domain")] if narrow else []))
    known = quotes.groupBy("flat").agg(F.min("item_id").alias("rep"))
    j = hits.join(of.join(known, "flat").drop("flat"), "rep")
    return (j.filter("q_domain is null or q_domain = domain") if narrow else j).select("item_id", "source_id")


def _by_word_pair(quotes: DataFrame, sources: DataFrame, narrow: bool) -> DataFrame:
    """(source_id, rep, domain if narrow): quotes of four words or more with the sources that hold them."""
    pair = lambda a, b: F.concat_ws(" ", a, b)
    w = F.split("flat", " ")
    # words beside their successors: an index into the split inside a lambda would split the text again for every word
    pairs = F.array_distinct(F.zip_with(w, F.slice(w, 2, F.size(w)), pair))
    held = sources.select("source_id", F.explode_outer(pairs).alias("k"))  # the plain explode has its array computed twice
    near = held.join(quotes.select("rep", pair(F.get(w, F.lit(1)), F.get(w, F.lit(2))).alias("k")), "k").select("source_id", "rep").distinct()
    texts = sources.select("source_id", F.col("flat").alias("s"), *(["domain"] if narrow else []))
    found = near.join(quotes.withColumnRenamed("flat", "q"), "rep").join(texts, "source_id").filter(F.col("s").contains(F.col("q")))
    return found.select("source_id", *(["domain"] if narrow else []), "rep")


def containment(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """(item_id, source_id): the first source whose flattened text contains the flattened quote; null if none.

    quotes: item_id, flat; sources: source_id, flat.
    """
    hits = held_by(quotes, sources)
    return quotes.select("item_id").join(hits.groupBy("item_id").agg(F.min("source_id").alias("source_id")), "item_id", "left")


def provenance(quotes: DataFrame, sources: DataFrame, briefs: DataFrame) -> DataFrame:
    """(item_id, found, source_id, reason): whether a primary source holds the quote; a brief orients but proves nothing.

    quotes: item_id, domain, flat; sources, briefs: source_id, domain, flat; the least source_id comes first. A quote's domain narrows the search
    only where sources have that domain.
    """
    known = sources.unionByName(briefs).select("domain").distinct().withColumn("__known", F.lit(True))
    q = quotes.join(known, "domain", "left").withColumn("domain", F.when(F.col("__known"), F.col("domain"))).drop("__known")
    q = materialise(q.select("item_id", "domain", "flat"), "quotes")
    long = q.filter(F.length("flat") >= LEAST_QUOTE)

    def first(of: DataFrame, name: str) -> DataFrame:
        return held_by(long, of).groupBy("item_id").agg(F.min("source_id").alias(name))

    j = q.join(first(sources, "source_id"), "item_id", "left").join(first(briefs, "__brief"), "item_id", "left")
    found = F.col("source_id").isNotNull()
    reason = F.when(F.length("flat") < LEAST_QUOTE, "too short").when(found, "primary source").when(F.col("__brief").isNotNull(), "brief only").otherwise("not found")
    return j.select("item_id", found.alias("found"), "source_id", reason.alias("reason"))


def keyword_terms(claims: DataFrame, forms: DataFrame, key: str, flat: str) -> DataFrame:
    """(key, term): terms one of whose forms begins at a word of the text. forms: term, form.

    Every word's beginning, as long as the longest form, meets the forms by the letters of the shortest; whole texts are not copied along.
    """
    size = F.length("form")
    least, most, letters = (x or 1 for x in forms.agg(F.min(size), F.max(size), F.sum(size + F.lit(16))).first())
    text = F.concat(F.lit(" "), F.regexp_replace(F.col(flat), r"(?U)[^\w]+", " "))
    starts = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?<= )(?=(.{{{least},{most}}}))"), 1))
    keyed = claims.select(key, F.explode_outer(starts).alias("__s")).withColumn("__k", F.substring("__s", 1, least))
    known = forms.withColumn("__k", F.substring("form", 1, least))
    return keyed.join(F.broadcast(known) if letters <= GLOSSARY else known, "__k").filter(F.col("__s").startswith(F.col("form"))).select(key, "term").distinct()


def look_ahead_votes(mentions: DataFrame, segments: DataFrame, after: float = 5.0, until: float = 90.0, least: float = 10.0, width: float = 120.0, by: list[str] | None = None) -> DataFrame:
    """(mention_id, cluster): the cluster that speaks most between stop+after and stop+until, the asker's excluded. ``by``: equal columns.

    mentions: mention_id, start, stop; segments: seq, cluster, s_start, s_stop."""
    by = by or []
    m = mentions.withColumn("l_start", F.col("stop") + after).withColumn("l_stop", F.col("stop") + until)
    begins = segments.withColumn("r_start", F.col("s_start")).withColumn("r_stop", F.col("s_start"))
    spoken = interval_pairs(m, begins, width, by, closed=True)
    point = mentions.select("mention_id", *by, F.col("start").alias("l_start"), F.col("start").alias("l_stop"))
    whole = segments.withColumn("r_start", F.col("s_start")).withColumn("r_stop", F.col("s_stop"))
    asker = interval_pairs(point, whole, width, by, closed=True).groupBy("mention_id").agg(F.min_by("cluster", "seq").alias("asker"))
    t = spoken.groupBy("mention_id", "cluster").agg(F.sum(F.col("s_stop") - F.col("s_start")).alias("seconds"), F.min("seq").alias("first"))
    t = t.join(asker, "mention_id", "left").filter(~F.col("cluster").eqNullSafe(F.col("asker")) & (F.col("seconds") >= least))
    return t.groupBy("mention_id").agg(F.max_by("cluster", F.struct("seconds", -F.col("first"))).alias("cluster"))


_PAIR = ["statement_id", "witness", "witness_seq"]


def _spoken(r: DataFrame, h: DataFrame, width: float) -> DataFrame:
    """(statement, witness) where a witness of another family gives any figure in the window.

    It follows from the first and last time of a witness's slots; only windows inside one slot, which the default width rules out from a pad
    of a second, look at single rows.
    """
    slot = lambda t: F.floor(t / width)
    within, other = F.col("t").between(F.col("lo"), F.col("hi")), F.col("family") != F.col("w_family")
    windows = r.select("statement_id", "family", "lo", "hi", F.explode(F.sequence(slot(F.col("lo")), slot(F.col("hi")))).alias("slot"))
    inside = slot(F.col("lo")) == slot(F.col("hi"))
    ends = h.groupBy("witness", "witness_seq", "w_family", "slot").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    spoke = windows.filter(~inside).join(ends, "slot").filter(other & (F.col("last") >= F.col("lo")) & (F.col("first") <= F.col("hi"))).select(*_PAIR)
    return spoke.union(windows.filter(inside).join(h, "slot").filter(other & within).select(*_PAIR)).distinct()


def _hits(required: DataFrame, heard: DataFrame, settings: list[tuple[float, float | None]]) -> DataFrame:
    """(statement, witness, i, hits array<boolean>): whether the i-th figure asked for is heard, for each setting of pad and least anchor (None: any words).

    Rows of a slot that say the same figure among the same words are one entry with its first and last time, and so are, once their anchors are known, all
    that statements with one figure and the same words ask of the slot: a window that reaches over the slot's border holds such a row just if
    the last is not before the window and the first is not after it. So rows that say the same do not pair up. Where the least pad is too
    small for its windows to leave a slot, every time is an entry of its own.
    """
    from claimlens.functions.text import anchor_ratio

    pads, levels = [p for p, _ in settings], list(dict.fromkeys(a for _, a in settings))
    short, pad = min(pads), max(pads)
    crossing = short >= 1.0 and pad <= 16 * short
    width = 1.5 * short if crossing else max(pad, 1.0)
    slot = lambda t: F.floor(t / width)
    # relative tolerance is below a thousandth of a cell on this scale, so equal values lie in one cell or two neighbours
    cell = lambda v: F.floor(F.signum(v) * F.log1p(F.abs(v)) * 1e6)
    v, w = F.col("asked_value"), F.col("value")
    slack = F.lit(1e-9) * F.greatest(F.abs(v), F.lit(1.0))

    said = heard.withColumns({"slot": slot(F.col("t")), "cell": cell(w)}).groupBy(*_PAIR[1:], "w_family", "kind", "value", "cell", "around", "position", "slot", *([] if crossing else ["t"])).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    asks = required.select("statement_id", "family", "start", "stop", "words", F.posexplode("figures").alias("i", "q")).select("statement_id", "family", "start", "stop", "words", F.xxhash64("words").alias("__w"), "i", F.col("q.kind").alias("kind"), F.col("q.value").alias("asked_value"))
    asks = asks.withColumn("slot", F.explode(F.sequence(slot(F.col("start") - pad), slot(F.col("stop") + pad))))
    same = ["family", "kind", "asked_value", "__w", "slot"]
    classes = asks.select(*same, "words").distinct().withColumn("cell", F.explode(F.array_distinct(F.array(cell(v - slack), cell(v + slack)))))
    met = classes.join(said, ["kind", "cell", "slot"]).filter((F.col("family") != F.col("w_family")) & (F.abs(v - w) <= slack))
    met = met.withColumn("__a", anchor_ratio(F.col("words"), F.col("around"), F.col("position")))
    of = lambda a, c: c if a is None else F.when(F.col("__a") >= a, c)
    ends = [f(of(a, F.col(c))).alias(f"__{c}{k}") for k, a in enumerate(levels) for f, c in ((F.min, "first"), (F.max, "last"))]
    # without a border to cross times do not fall together
    known = met.groupBy(*same, "words", *_PAIR[1:], *([] if crossing else ["first"])).agg(*ends).withColumnRenamed("words", "__words")
    told = asks.join(known, same).filter(F.col("words").eqNullSafe(F.col("__words")))
    within = lambda p, k: F.coalesce((F.col(f"__last{k}") >= F.col("start") - p) & (F.col(f"__first{k}") <= F.col("stop") + p), F.lit(False))
    return told.groupBy(*_PAIR, "i").agg(F.array(*(F.bool_or(within(p, levels.index(a))) for p, a in settings)).alias("hits")).filter(F.exists("hits", lambda x: x))


def _windowed(required: DataFrame, heard: DataFrame, pad: float, width: float | None) -> tuple[DataFrame, DataFrame, float]:
    width = width or max(pad, 1.0)
    return required.withColumns({"lo": F.col("start") - pad, "hi": F.col("stop") + pad}), heard.withColumn("slot", F.floor(F.col("t") / width)), width


def corroborate(required: DataFrame, heard: DataFrame, pad: float = 20.0, min_anchor: float = 0.2, width: float | None = None) -> DataFrame:
    """(statement_id, status, witness): all required figures must be heard from one witness of another family.

    required: statement_id, family, start, stop, figures array<struct<kind,value>>, words array<string>;
    heard: witness, witness_seq, w_family, t, kind, value, around array<string>, position int.

    Figures meet by kind, value and time slot, so rows of other values never pair up.
    """
    r, h, width = _windowed(required, heard, pad, width)
    met = _hits(required, heard, [(pad, min_anchor)])
    found = _spoken(r, h, width).withColumn("i", F.lit(None).cast("int")).union(met.select(*_PAIR, "i")).groupBy(*_PAIR).agg(F.count_distinct("i").alias("n"))

    j = required.join(found, "statement_id", "left")
    status = F.when(F.size("figures") == 0, "no_quantity").when(F.col("witness").isNull(), "absent").when(F.col("n") == F.size("figures"), "confirmed").otherwise("divergent")
    rank = F.when(status == "confirmed", 0).when(status == "divergent", 1).otherwise(2)
    return j.groupBy("statement_id").agg(F.min_by(F.struct(status.alias("status"), F.col("witness").alias("witness")), F.struct(rank, F.coalesce("witness_seq", F.lit(0)))).alias("b")).select("statement_id", "b.status", "b.witness")


HEARD = 6  # Fixed value: figures of a witness that are listed instead


def evidence(required: DataFrame, heard: DataFrame, witnesses: DataFrame, pad: float = 20.0, min_anchor: float = 0.2, width: float | None = None) -> DataFrame:
    """(statement_id, status, witness, matched, missing, unanchored, heard): the whole outcome of corroboration, figures as they were said.

    As ``corroborate``, but every independent transcription is a witness, also one that says nothing in the window: a statement is ``absent`` by the
    first of them if none gives a figure, and ``no_witness`` if there is none of another family. unanchored: missing figures that the witness
    gives among other words. heard: of a divergent witness the first figures in the window.

    required and heard as for ``corroborate``, with ``raw`` beside kind and value, and ``place`` (order among equal t) in heard; witnesses: witness, witness_seq,
    w_family. First the witness is chosen from counts per statement and witness, then evidence is gathered for the chosen ones alone.
    """
    r, h, width = _windowed(required, heard, pad, width)
    figures = F.size("figures")
    equal = materialise(_hits(required, heard, [(pad, None), (pad, min_anchor)]).select(*_PAIR, "i", F.col("hits")[1].alias("anchored")), "equal")
    spoke = _spoken(r, h, width).withColumns({"i": F.lit(None).cast("int"), "anchored": F.lit(False)})
    per = spoke.unionByName(equal).groupBy(*_PAIR).agg(F.count_if("anchored").alias("n"))
    ranked = required.select("statement_id", figures.alias("asked")).join(per, "statement_id")
    whole = F.col("n") == F.col("asked")
    best = ranked.groupBy("statement_id").agg(F.min_by(F.struct("witness", whole.alias("whole")), F.struct(F.when(whole, 0).otherwise(1), "witness_seq")).alias("b"))

    # the first witness of all, and the first of another family than that: one of them is independent of any statement, or none is
    order = witnesses.select("witness", "witness_seq", "w_family").orderBy("witness_seq", "witness")
    one = order.first()
    two = order.filter(F.col("w_family") != F.lit(one["w_family"])).first() if one else None
    none = F.lit(None).cast("string")
    first = none
    for w in (two, one):
        first = F.when(F.col("family") != F.lit(w["w_family"]), F.lit(w["witness"])).otherwise(first) if w else first
    j = required.join(best, "statement_id", "left")
    status = F.when(figures <= 0, "no_quantity").when(first.isNull(), "no_witness").when(F.col("b").isNull(), "absent").when(F.col("b.whole"), "confirmed").otherwise("divergent")
    by = F.when(status.isin("no_quantity", "no_witness"), none).otherwise(F.coalesce("b.witness", first))
    chosen = materialise(j.select("statement_id", "start", "stop", "figures", status.alias("status"), by.alias("witness")), "chosen")

    said = chosen.select("statement_id", "witness", F.posexplode("figures").alias("i", "q")).join(equal.drop("witness_seq"), ["statement_id", "witness", "i"], "left")
    told = said.groupBy("statement_id").agg(F.array_sort(F.collect_list(F.struct("i", F.col("q.raw").alias("raw"), "anchored"))).alias("f"))  # the figures of one statement
    of = lambda keep: F.transform(F.filter("f", keep), lambda x: x["raw"])
    told = told.select("statement_id", of(lambda x: F.coalesce(x["anchored"], F.lit(False))).alias("matched"), of(lambda x: ~F.coalesce(x["anchored"], F.lit(False))).alias("missing"), of(lambda x: x["anchored"].eqNullSafe(F.lit(False))).alias("unanchored"))

    # rows of a witness are numbered in each slot; a window asks for the few after its begin and the first few of later slots, by number
    slot = lambda t: F.floor(t / width)
    windows = chosen.filter("status = 'divergent'").select("witness", (F.col("start") - pad).alias("t"), F.lit(0).alias("side"), "statement_id", (F.col("stop") + pad).alias("hi")).withColumn("slot", slot(F.col("t")))
    both = windows.unionByName(h.select("witness", "slot", "t", "place", "raw", F.lit(1).alias("side")), allowMissingColumns=True)
    both = both.withColumn("n", F.sum("side").over(Window.partitionBy("witness", "slot").orderBy("t", "side", "place").rowsBetween(Window.unboundedPreceding, 0)))
    both = materialise(both, "numbered")
    few = lambda n: F.explode(F.sequence(n + 1, n + HEARD))
    begun, last = both.filter("side = 0"), slot(F.col("hi"))
    later = begun.withColumn("slot", F.explode(F.when(last > F.col("slot"), F.sequence(F.col("slot") + 1, last)))).withColumn("n", few(F.lit(0).cast("long")))
    keys = ["witness", "slot", "n"]
    sought = begun.withColumn("n", few(F.col("n"))).select("statement_id", "hi", *keys).union(later.select("statement_id", "hi", *keys))
    near = sought.join(both.filter("side = 1").select(*keys, "t", "raw"), keys).filter("t <= hi")
    instead = near.groupBy("statement_id").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("slot", "n", "raw"))), 1, HEARD), lambda x: x["raw"]).alias("heard"))
    empty = F.array().cast("array<string>")
    out = chosen.drop("figures").join(told, "statement_id", "left").join(instead, "statement_id", "left")
    return out.select("statement_id", "status", "witness", *(F.coalesce(c, empty).alias(c) for c in ("matched", "missing", "unanchored", "heard")))


def settings_sweep(required: DataFrame, heard: DataFrame, pads: list[float], anchors: list[float], must_block: list | None = None, must_confirm: list | None = None) -> DataFrame:
    """(pad, min_anchor, statements, with_figures, corroborated, coverage, kept) of every pair of settings, in one pass.

    kept: every statement of ``must_block`` is not confirmed and every one of ``must_confirm`` is. Inputs as for ``corroborate``.
    """
    settings = [(float(p), float(a)) for p in pads for a in anchors]
    every = range(len(settings))
    per = _hits(required, heard, settings).groupBy("statement_id", "witness").agg(*(F.count_if(F.col("hits")[k]).alias(f"__n{k}") for k in every))
    j = required.select("statement_id", F.size("figures").alias("asked")).join(per, "statement_id", "left")
    one = j.groupBy("statement_id").agg(F.bool_or(F.coalesce(F.col("asked") != 0, F.lit(True))).alias("asks"), *(F.coalesce(F.bool_or(F.col(f"__n{k}") == F.col("asked")), F.lit(False)).alias(f"__c{k}") for k in every))
    bad = lambda c: (F.col("statement_id").isin(must_block or []) & c) | (F.col("statement_id").isin(must_confirm or []) & ~c)
    row = lambda k: F.struct(F.lit(settings[k][0]).alias("pad"), F.lit(settings[k][1]).alias("min_anchor"), F.count_if(f"__c{k}").alias("corroborated"), (F.count_if(bad(F.col(f"__c{k}"))) == 0).alias("kept"))
    total = one.agg(F.count("*").alias("statements"), F.count_if("asks").alias("with_figures"), F.array(*map(row, every)).alias("__s"))
    coverage = F.round(F.col("corroborated") / F.greatest("with_figures", F.lit(1)), 3).alias("coverage")
    return total.select("statements", "with_figures", F.inline("__s")).select("pad", "min_anchor", "statements", "with_figures", "corroborated", coverage, "kept")


def best_setting(sweep: DataFrame) -> DataFrame:
    """Of the kept settings the smallest pad, then the largest anchor."""
    return sweep.filter("kept").orderBy("pad", F.desc("min_anchor")).limit(1)
