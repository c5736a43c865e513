"""Personal data by patterns and by information-theoretic sanitisation.

Base spans (e-mail, IP, card, phone) are the protected entities. Other terms of their documents may
reveal them as well: from corpus co-occurrence, p is the probability of the entity in a document that holds the term, estimated by
n_te / n_t (documents with both, documents with the term) at the lower end of Wilson's interval, one-sided at 95 % (``z``), as a single
document proves little. What the term leaves unknown about the entity is -log2 p bits; what it tells is log2(p * N / n_e), n_e
documents of N holding the entity. A term discloses an entity if at most 2 bits are left (p of ``disclosure``, 0.25, or more) and it tells at least one.
The bar lies on p, which does not depend on N, so a term is judged alike in a corpus of hundreds and of billions of documents.
Such terms are added as spans wherever they stand in documents with the
entity: generalised to their class, or removed from p of ``removal`` on. A term is a run of letters and digits.

Documents without an entity are never changed.

Cases: null text counts as empty; repeated rows are each judged and counted; an entity that all documents hold is told by nothing and
protects nothing; terms that tie all go; a very long text is scanned whole in one pass, in proportion to its length; an empty table gives an
empty result; extra columns are ignored (``sanitise`` keeps them).
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.rows import body_of, text_key
from claimlens.storage import materialise

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, written so that a failed attempt is not repeated inside the same run of characters.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]").search
_TERM = re.compile(r"[^\W_]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_BITS = 1 << 24


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    pos, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            pos = m.end()
            yield start, pos
        at = text.find("@", max(at + 1, pos))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind then start: leftmost, non-overlapping per kind."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m[0].split("."))]
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and _luhn(d):
                out.append((2, m.start(), m.end()))
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def entity_of(kind: int, value: str) -> str:
    """E-mails without case, numbers without punctuation."""
    return f"{KINDS[kind]}:{value.lower() if kind == 0 else value if kind == 1 else ''.join(c for c in value if c.isdigit())}"


def terms_of(text: str) -> set[str]:
    return {w.lower() for w in set(_TERM.findall(text))}


def outside(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    """(lower-cased term, start, end) of the terms that touch none of the spans."""
    taken, i, reach = sorted(spans), 0, -1
    for m in _TERM.finditer(text):
        while i < len(taken) and taken[i][0] < m.end():
            reach, i = max(reach, taken[i][1]), i + 1
        if reach <= m.start():
            yield m[0].lower(), m.start(), m.end()


def generalise(term: str) -> str:
    """The class of a term: number, code (letters and digits), name (capitalised) or word."""
    if term.isdigit():
        return "<NUMBER>"
    if any(c.isdigit() for c in term):
        return "<CODE>"
    return "<NAME>" if term[0].isupper() else "<WORD>"


_SPAN = "struct<kind:int,start:long,stop:long>"
_SPAN_PA = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))
_MORE = "array<struct<kind:string,start:long,stop:long,share:double>>"


def scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row, text_key, spans, entities, terms, body) of every row; terms and body only where there are spans."""
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "row", "text_key", "spans", "entities", "terms", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, entities, terms, bodies = [], [], [], []
            for t in b.column(3):
                t = t.as_py()
                found = base_spans(t)
                spans.append([{"kind": k, "start": x, "stop": y} for k, x, y in found])
                entities.append(sorted({entity_of(k, t[x:y]) for k, x, y in found}))
                terms.append(sorted({w for w, _, _ in outside(t, [(x, y) for _, x, y in found])}) if found else [])
                bodies.append(t if found else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(spans, _SPAN_PA), pa.array(entities, pa.list_(pa.string())), pa.array(terms, pa.list_(pa.string())), pa.array(bodies, pa.string())], names)

    return docs.select(F.col(key), F.monotonically_increasing_id().alias("row"), text_key(key, text).alias("text_key"), body_of(text).alias("__cl_text")).mapInArrow(run, f"`{key}` {kind}, row long, text_key binary, spans array<{_SPAN}>, entities array<string>, terms array<string>, body string")


def document_frequency(docs: DataFrame, terms: DataFrame, text: str) -> DataFrame:
    """(term, n_t) over all documents for the given distinct terms.

    The words of a document are first tested against a bitmap of the terms' hashes, whose size is fixed at
    2 MB, so that few others are shuffled; the join that follows is exact.
    """
    bit = F.pmod(F.xxhash64("term"), F.lit(_BITS))
    maps = terms.select((F.floor(bit / 32768)).cast("long").alias("bucket"), F.pmod(bit, F.lit(32768)).alias("at")).groupBy("bucket").agg(F.expr("bitmap_construct_agg(at)").alias("bits")).collect()  # at most 512 rows of 4 KB
    bitmap = bytearray(_BITS // 8)
    for r in maps:
        bitmap[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = r["bits"]
    bitmap = bytes(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        h = xxhash.xxh64_intdigest
        known: dict[str, bool] = {}

        def wanted(w: str) -> bool:
            ok = known.get(w)
            if ok is None:
                if len(known) > 150_000:
                    known.clear()
                at = h(w.encode(), 42) % _BITS  # the bits are the low ones, signed or not
                ok = known[w] = bool(bitmap[at >> 3] >> (at & 7) & 1)
            return ok

        for b in batches:
            for t in b.column(0):
                seen.update(w for w in terms_of(t.as_py()) if wanted(w))
            if len(seen) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

    words = docs.select(body_of(text).alias("__cl_text")).mapInArrow(run, "term string, n long")
    return words.groupBy("term").agg(F.sum("n").alias("n_t")).join(terms, "term", "left_semi")


def share_of(n_te: Column, n_t: Column, z: float) -> Column:
    """The probability of an entity where a term stands, at the lower end of the interval for n_te / n_t."""
    p, n = n_te / n_t, n_t.cast("double")
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _alike(rows: DataFrame, what: str) -> DataFrame:
    """(what, n, one, two): rows that hold it and two digests of which these are. What stands in the same rows is alike."""
    return rows.groupBy(what).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("one"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("two"))


def revealing(docs: DataFrame, scanned: DataFrame, text: str, disclosure: float, z: float) -> DataFrame:
    """(row, term, share) of the terms that disclose an entity of their document, with the largest share of its entities.

    Entities that stand in the same documents have equal shares with every term, and so have terms; each such class is counted
    as one. A term seen once needs no pairs: all entities of its document have the same share with it. Of others, an entity must stand in at least
    k of the term's documents, so in one of any n - k + 1 of the n that hold entities: pairs are built in those with the fewest
    entities only, and counted in the rest. A document of very many terms and entities that also occur elsewhere costs what those other documents hold.
    """
    rows = scanned.filter(F.size("spans") > 0)
    total = docs.count()
    held = rows.select("row", F.explode("entities").alias("entity"))
    n_e = _alike(held, "entity").filter(F.col("n") < total)
    held = materialise(held.join(n_e, "entity").select("row", F.struct("n", "one", "two").alias("e")).distinct(), "held")
    words = rows.select("row", F.explode("terms").alias("term"))
    alike = materialise(_alike(words, "term"), "terms")
    alike = alike.join(document_frequency(docs, alike.select("term"), text), "term").select("term", F.struct("n_t", "n", "one", "two").alias("t"))
    words = materialise(words.join(alike, "term"), "words")
    tells = lambda share, n_e: share * F.lit(float(total)) >= 2 * n_e

    one = share_of(F.lit(1), F.lit(1), z)
    rarest = held.groupBy("row").agg(F.min("e.n").alias("n_e")).filter((one >= disclosure) & tells(one, F.col("n_e")))
    alone = words.filter("t.n_t = 1").join(rarest, "row").select("row", "term", one.alias("share"))

    n_t = F.col("t.n_t")
    # Wilson's bound reaches the bar at this many documents
    need = F.greatest(F.ceil(n_t * disclosure + z * F.sqrt(n_t * (disclosure * (1 - disclosure))) - 1e-9), F.lit(1))
    most = held.agg(F.max("e.n")).first()[0] or 0
    common = materialise(words.filter((n_t > 1) & (F.col("t.n") >= need) & (need <= most)).select("row", "t", need.alias("need")).distinct(), "common")
    size = held.groupBy("row").agg(F.count("*").alias("m"))
    place = F.row_number().over(Window.partitionBy("t").orderBy("m", "row"))
    begun = common.join(size, "row").withColumn("place", place).filter(F.col("place") <= F.col("t.n") - F.col("need") + 1)
    pairs = begun.join(held, "row").filter(F.col("e.n") >= F.col("need")).select("t", "e").distinct()
    pairs = materialise(pairs.join(common.select("t", "row"), "t").join(held, ["row", "e"]), "pairs")
    share = share_of(F.col("n_te"), n_t, z)
    told = pairs.groupBy("e", "t").agg(F.count("*").alias("n_te")).select("e", "t", share.alias("share")).filter((F.col("share") >= disclosure) & tells(F.col("share"), F.col("e.n")))
    told = pairs.join(told, ["e", "t"]).groupBy("row", "t").agg(F.max("share").alias("share"))
    return alone.unionByName(words.join(told, ["row", "t"]).select("row", "term", "share"))


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", disclosure: float = 0.25, removal: float = 0.7, z: float = 1.645) -> DataFrame:
    """(key, row, text_key, spans): spans is an array of (kind, start, stop, share); kind is email, ip, card, phone, term or removed_term."""
    found = materialise(scan(docs, key, text), "personal")
    base = F.transform("spans", lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), F.lit(None).cast("double").alias("share")))
    told = revealing(docs, found, text, disclosure, z).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("told"))

    @F.pandas_udf(_MORE)
    def places(body: pd.Series, spans: pd.Series, told: pd.Series) -> pd.Series:
        def one(t, s, shares):
            if t is None or shares is None:
                return []
            shares = dict(shares)
            hits = ((a, b, shares[w]) for w, a, b in outside(t, [(x["start"], x["stop"]) for x in s]) if w in shares)
            return sorted(({"kind": "removed_term" if v >= removal else "term", "start": a, "stop": b, "share": float(v)} for a, b, v in hits), key=lambda x: (x["kind"], x["start"]))

        return pd.Series([one(*x) for x in zip(body, spans, told)])

    cols = [key, "row", "text_key"]
    hit = found.join(told, "row").select(*cols, F.concat(base, places("body", "spans", "told")).alias("spans"))
    return found.join(told, "row", "left_anti").select(*cols, base.alias("spans")).unionByName(hit)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns from ``personal_data``."""
    line = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    of = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    return found.select(key, *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line("spans").alias("spans"))


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with the spans replaced by <EMAIL>, <IP>, <CARD>, <PHONE> or what ``generalise`` says, or nothing for removed terms. Other rows and columns stay."""
    found = personal_data(docs, key, text, **options).filter(F.size("spans") > 0)
    # equal (key, text) rows have equal spans
    found = found.dropDuplicates(["text_key"]).select(F.col("text_key").alias("__cl_key"), F.col("spans").alias("__cl_spans"))
    rows = docs.withColumn("__cl_key", text_key(key, text))

    @F.pandas_udf("string")
    def replace(texts, spans):
        def one(t, s):
            if t is None or s is None:
                return t
            out, at = [], 0
            for x in sorted(s, key=lambda x: (x["start"], -x["stop"])):
                if x["start"] < at:  # inside a span already replaced, or reaching over its end
                    at = max(at, x["stop"])
                    continue
                out += [t[at : x["start"]], "" if x["kind"] == "removed_term" else generalise(t[x["start"] : x["stop"]]) if x["kind"] == "term" else f"<{x['kind'].upper()}>"]
                at = x["stop"]
            return "".join(out) + t[at:]

        return texts.combine(spans, one)

    hit = rows.join(found, "__cl_key").withColumn(text, replace(F.col(text), F.col("__cl_spans")))
    rest = rows.join(found, "__cl_key", "left_anti")
    return rest.select(docs.columns).unionByName(hit.select(docs.columns))
