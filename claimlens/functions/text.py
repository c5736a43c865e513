"""Text scalars as Column expressions; Python only where no built-in can say it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The accent table.
ACCENTED = "àáâäãåÀÁÂÄÃÅèéêëÈÉÊËìíîïÌÍÎÏòóôöõÒÓÔÖÕùúûüÙÚÛÜçÇñÑÿŸ"
PLAIN = "aaaaaaAAAAAAeeeeEEEEiiiiIIIIoooooOOOOOuuuuUUUUcCnNyY"

# Function words dropped from claim keys.
CLAIM_STOPWORDS = """le la les un une des du de d l et ou a au aux en dans sur pour par avec sans il elle ils elles on nous
vous je tu ce cet cette ces y est sont ete etre avoir ont que qui quoi dont ne pas plus aujourd hui aussi donc alors meme
tout tous toute toutes compte compter existe reste fait faire""".split()

# Function words dropped from content words.
CONTENT_STOPWORDS = """le la les de des du un une et en a au aux que qui ce cette ces on il elle nous vous je tu ils elles
est sont ete pas ne plus moins pour dans sur avec par se sa son ses leur leurs mais ou donc car y d l c j n s qu the of""".split()


def strip_accents(c: Column) -> Column:
    """Length-preserving: one character for one."""
    return F.translate(c, ACCENTED, PLAIN)


def normalise(c: Column) -> Column:
    """Lower case, no accents, punctuation but %,. to spaces, spaces collapsed."""
    spaced = F.translate(strip_accents(F.lower(c)), "  ", "  ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, r"(?U)[^\w%,.\s]", " "), r"(?U)\s+", " "))


def flatten_quote(c: Column) -> Column:
    """For provenance: layout runs of two or more leader characters count as a space."""
    low = F.lower(strip_accents(c))
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[.\-_·•]{2,}", " "), r"(?U)\s+", " "))


def claim_key(c: Column) -> Column:
    """Figures stay, accents, case, punctuation and function words go; digit groups are joined."""
    joined = F.regexp_replace(F.lower(strip_accents(c)), "(?<=\\d)[\\s  ](?=\\d)", "")
    tokens = F.regexp_extract_all(joined, F.lit(r"([a-z0-9]+(?:[.,]\d+)?)"), 1)
    return F.array_join(F.filter(tokens, lambda t: ~t.isin(CLAIM_STOPWORDS)), " ")


def claim_figures(c: Column) -> Column:
    return F.regexp_extract_all(claim_key(c), F.lit(r"(\d+(?:[.,]\d+)?)"), 1)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def review_slug(c: Column) -> Column:
    """Every character but letters and digits as a dash, none at the ends; accents stay."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "-"), "^-+|-+$", "")


def sentences(c: Column) -> Column:
    parts = F.split(c, r"(?<=[.!?…])\s+(?=[A-ZÀÉÈÊÎÔÙ])")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def words(c: Column) -> Column:
    return F.filter(F.split(normalise(c), " "), lambda w: w != "")


def content_words(c: Column) -> Column:
    return F.array_distinct(F.filter(words(c), lambda w: (F.length(w) > 2) & ~w.isin(CONTENT_STOPWORDS) & ~w.rlike("^[0-9]")))


def anchor_ratio(wanted: Column, around: Column, position: Column, span: int = 12, least: int = 3) -> Column:
    """Share of the statement's content words within ``span`` words of a figure; 1 with too few to tell."""
    start = F.greatest(position - span, F.lit(0))
    near = F.slice(around, start + 1, position + span - start)
    return F.when(F.size(wanted) < least, F.lit(1.0)).otherwise(F.size(F.array_intersect(wanted, near)) / F.size(wanted))


def overlap_remainder(previous: Column, new: Column, longest: int = 25) -> Column:
    """What a rolling caption adds to the one before: the longest common suffix/prefix of words is dropped."""
    p, n = F.split(F.lower(F.trim(previous)), r"\s+"), F.split(F.lower(F.trim(new)), r"\s+")
    most = F.least(F.size(p), F.size(n), F.lit(longest))
    fits = F.filter(F.sequence(F.lit(1), most), lambda k: F.slice(p, F.size(p) - k + 1, k) == F.slice(n, F.lit(1), k))
    k = F.coalesce(F.array_max(fits), F.lit(0))
    raw = F.split(F.trim(new), r"\s+")
    return F.array_join(F.slice(raw, k + 1, F.size(raw)), " ")


def _longest_repeat(texts: pd.Series) -> pd.Series:
    """Most consecutive repeats of a phrase of one to eight words."""

    def one(t: str | None) -> int:
        w = (t or "").lower().split()
        best = 1 if w else 0
        for size in range(1, 9):
            run = 0
            for i in range(size, len(w)):
                run = run + 1 if w[i] == w[i - size] else 0
                best = max(best, run // size + 1)
        return best

    return texts.map(one).astype("int32")


def longest_repeat(text: Column) -> Column:
    return F.pandas_udf(_longest_repeat, "int")(text)


def aberrant_integers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(\d{7,})"), 1)


def _name_score(text: pd.Series, name: pd.Series) -> pd.Series:
    """exact: the name stands as words; recoverable: a word or pair of words is 0.72 similar; else lost."""
    from difflib import SequenceMatcher

    def one(t: str | None, n: str | None) -> str:
        w, n = (t or "").lower().split(), (n or "").lower()
        w = [x.strip(".,;:!?") for x in w]
        grams = w + [" ".join(p) for p in zip(w, w[1:])]
        if n in grams:
            return "exact"
        return "recoverable" if any(SequenceMatcher(None, g, n).ratio() >= 0.72 for g in grams) else "lost"

    return text.combine(name, one)


def name_score(text: Column, name: Column) -> Column:
    return F.pandas_udf(_name_score, "string")(text, name)


def surname(c: Column) -> Column:
    """All after the first name; a single word is itself."""
    parts = F.split(F.trim(c), r"\s+")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 2, F.size(parts)), " ")).otherwise(c)


def surname_forms_of(name: str, least: int = 1) -> list[str]:
    """All after the first name, lower-cased without accents, and the same with hyphens as spaces; forms shorter than ``least`` are left out."""
    flat = name.strip().lower().translate(str.maketrans(ACCENTED, PLAIN))
    last = flat.split(maxsplit=1)[-1] if flat else ""
    return [f for f in dict.fromkeys((last, last.replace("-", " "))) if len(f) >= least]


def figures_with_scale(c: Column) -> Column:
    """array<struct<figure, scale>>: every figure, digit groups joined, with the first scale word of the 40 characters behind it."""
    joined = F.regexp_replace(c, "(?<=\\d)[\\s\u00a0\u202f](?=\\d)", "")
    pattern = F.lit(r"(?s)(\d+(?:[.,]\d+)?)(?=(.{0,40}))")
    scale = lambda t: F.lower(F.regexp_extract(t, r"(?i)\b(milliards?|millions?|milliers?|%)\b", 1))
    return F.zip_with(F.regexp_extract_all(joined, pattern, 1), F.regexp_extract_all(joined, pattern, 2), lambda f, t: F.struct(F.translate(f, ",", ".").alias("figure"), scale(t).alias("scale")))


def domain_rank(url: Column, entries: list[tuple[str, int]]) -> Column:
    """Best rank of the entries a url falls under: a path entry by prefix, a host entry by itself or its subdomains. Entries are a short fixed list."""
    ref = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(url), "^https?://", ""), r"^www\.", ""), "/+$", "")
    host = F.substring_index(ref, "/", 1)
    fits = lambda e: (ref == e) | ref.startswith(e + "/") if "/" in e else (host == e) | host.endswith("." + e)
    return F.array_min(F.array(*[F.when(fits(e), r) for e, r in entries]))


def inline_refs(schema: dict) -> dict:
    """A JSON schema with every ``#/$defs`` reference replaced by what it names; recursive definitions are an error."""

    def walk(node, open_names: tuple = ()):
        if isinstance(node, list):
            return [walk(x, open_names) for x in node]
        if not isinstance(node, dict):
            return node
        name = node.get("$ref", "").removeprefix("#/$defs/")
        if name:
            if name in open_names:
                raise ValueError(f"recursive definition {name}")
            rest = {k: v for k, v in node.items() if k != "$ref"}
            return walk(schema["$defs"][name] | rest, (*open_names, name))
        return {k: walk(v, open_names) for k, v in node.items() if k != "$defs"}

    return walk(schema)


def model_json(c: Column) -> Column:
    """The outermost braces after any reasoning section."""
    body = F.element_at(F.split(c, "</think>"), -1)
    return F.nullif(F.regexp_extract(body, r"(?s)(\{.*\})", 1), F.lit(""))


def with_time(url: Column, seconds: Column) -> Column:
    return F.concat(url, F.when(url.contains("?"), "&t=").otherwise("?t="), F.floor(seconds).cast("string"), F.lit("s"))


def clock(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(r))).otherwise(F.concat_ws(":", m.cast("string"), two(r)))


def seconds_of(stamp: Column) -> Column:
    """[h:]m:s.ms of subtitles."""
    g = lambda i: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(stamp, r"(?:(\d+):)?(\d+):(\d+)[.,](\d+)", i), F.lit("")), F.lit("999999999")).cast("double"), F.lit(0.0))
    return g(1) * 3600 + g(2) * 60 + g(3) + g(4) / 1000


def html_text(c: Column, limit: int = 260) -> Column:
    cut = F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        cut = F.replace(cut, F.lit(raw), F.lit(safe))
    return cut


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))


def family_of(model: Column, families: dict[str, str]) -> Column:
    """Unknown models are their own family."""
    if not families:
        return model
    known = F.create_map(*[F.lit(x) for kv in families.items() for x in kv])
    return F.coalesce(known[model], model)


def checksum_matches(content: Column, checksum: Column) -> Column:
    return F.when(F.coalesce(checksum, F.lit("")) != "", F.sha2(content.cast("binary"), 256) == F.lower(checksum))


def clip_start(start: Column, legacy: Column) -> Column:
    """The start if there is one, else m:ss out of the legacy label."""
    m, s = (F.nullif(F.regexp_extract(legacy, r"(\d+):(\d{2})", i), F.lit("")).cast("double") for i in (1, 2))
    return F.coalesce(start, m * 60 + s)


def evidence(text: Column, sources: Column, budget: int = 40_000) -> Column:
    """A source's share of the budget."""
    return F.substring(text, F.lit(1), F.floor(F.lit(budget) / F.greatest(sources, F.lit(1))).cast("int"))
