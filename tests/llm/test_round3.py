"""Resampling, source audit and substring dedup against brute force and SQL."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from claimlens.llm import queries, source_audit, substring_dedup, target_resample

SCHEMA = "doc_id long, text string, lang string, source string, n long, p int, chunk int, rank string"


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def corpus(seed=5):
    rng = random.Random(seed)
    words = ["the", "The", "of", "Ünï", "É", "é", "日本", "x9", "9", "a-b", "c_d", "don't", "\x7f", "end."] + [f"w{chr(97 + i)}" for i in range(26)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(120):
        t = [rng.choice(words) for _ in range(rng.randint(0, 90))]
        if i % 5 == 0:
            t[len(t) // 2 : len(t) // 2] = passage
        if i % 9 == 0:
            t = passage[5:40] * 3
        rows.append((i, rng.choice([" ", "\n", "  ", "\t"]).join(t), rng.choice(["en", "de", None, "fr"]), rng.choice(["a", "a", "a", "b", "É", "z", None, "~"])))
    rows += [(200, None, "en", "a"), (201, "", "xx", None), (202, " \t\n", "xx", "only"), (None, " ".join(passage), "en", "b"), (3, rows[3][1], "en", "a"), (3, "other text " * 30, "en", "b"), (203, "loop " * 70_000, "en", "a"), (204, "k" * 50_000, "de", "a")]
    return [(*r, 1, 2, 3, "clash") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def features(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def test_resample(spark, docs, empty):
    target = [("the of the end",), (None,), ("Ünï É 9 9 wa wb",)]
    rows, s, t = corpus(), Counter(), Counter()
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    for r in rows:
        s.update(map(bucket, features(r[1])[1]))
    for (x,) in target:
        t.update(map(bucket, features(x)[1]))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (sum(s.values()) + 10000.0) / ((s[b] + 1.0) * (sum(t.values()) + 10000.0))))
    want, eligible = [], []
    for i, r in enumerate(rows):
        n, f = features(r[1])
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        want.append([r[0], len(f), weight, score, None])
        if n >= 20:
            eligible.append((-score, r[0] is None, r[0], i))
    drawn = sorted(eligible, key=lambda x: x[:2] + (x[2] or 0,))[: 25 * len(eligible) // 100]
    for place, x in enumerate(drawn, 1):
        want[x[3]][4] = place
    out = target_resample.resample(docs, spark.createDataFrame(target, "text string"))
    order = lambda r: [(x is None, x or 0) for x in r]
    assert sorted(map(tuple, out.collect()), key=order) == sorted(map(tuple, want), key=order)
    assert target_resample.resample(empty, empty).count() == 0
    assert target_resample.resample(docs, empty).count() == len(rows)


def test_resample_ties_and_string_keys(spark):
    rows = [("k1", "one two " * 20)] * 7 + [(None, "one two " * 20)] + [("k2", "one two " * 20)]
    out = target_resample.resample(spark.createDataFrame(rows, "name string, body string"), spark.createDataFrame([("two",)], "body string"), "name", "body", "body", percent=100)
    assert sorted(r["rank"] for r in out.collect()) == list(range(1, 10))
    assert out.select("weight").distinct().count() == 1


def test_runs():
    values, n = target_resample.runs_of(np.array([5, 1, 5, 5, 0], np.uint16))
    assert values.tolist() == [0, 1, 5] and n.tolist() == [1, 1, 3]
    assert [len(x) for x in target_resample.runs_of(np.zeros(0, np.uint16))] == [0, 0]


def audit_by_hand(rows, top):
    rows = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(r[1]))) for r in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        df = Counter(w for r in mine for w in set(r[2]))
        kept = [w for w, n in df.items() if n >= 3]
        by = {s: Counter() for _, s, _ in mine}
        for _, s, w in mine:
            by[s].update(x for x in w if df[x] >= 3)
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        whole = share(sum(by.values(), Counter()))
        p = {s: share(c) for s, c in by.items()}
        for s in by:
            pair = [(-sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o) for o in by if o != s]
            term = [(-((p[s][w] - whole[w]) ** 2 // whole[w]), w) for w in kept if by[s][w] and p[s][w] > whole[w]]
            for part, found in (("pair", pair), ("term", term)):
                found = sorted(found, key=lambda x: (x[0], x[1].encode()))[: top if part == "term" else None]
                out += [(lang, s, part, item, -v, i) for i, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("top", [200, 3])
def test_audit(docs, top):
    assert sorted(map(tuple, source_audit.audit(docs, top=top).collect())) == audit_by_hand(corpus(), top)


def test_audit_in_small_parts(docs, monkeypatch):
    monkeypatch.setattr(source_audit, "_PAIRS", 40)
    monkeypatch.setattr(source_audit, "_HELD", 10)
    assert sorted(map(tuple, source_audit.audit(docs).collect())) == audit_by_hand(corpus(), 200)


def test_audit_edges(spark, empty):
    assert source_audit.audit(empty).count() == 0
    one = spark.createDataFrame([("a b", "en", "s"), ("a", None, None), (None, None, "t")], "text string, lang string, source string")
    assert sorted(map(tuple, source_audit.audit(one).collect())) == [("", "", "pair", "t", 0, 1), ("", "t", "pair", "", 0, 1)]


def dedup_by_hand(rows, width):
    key = lambda r: (r[0] is None, r[0] or 0)
    seen, out = set(), []
    import xxhash

    for r in sorted(rows, key=lambda r: (*key(r), xxhash.xxh64_intdigest((r[1] or "").encode()) >> 1)):
        w = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            run = tuple(w[i : i + width])
            if run in seen:
                gone[i : i + width] = [True] * width
            seen.add(run)
        out.append((r[0], len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=lambda r: (*key(r), r[1:]))


@pytest.mark.parametrize(("width", "words", "cells"), [(20, 1 << 19, 24), (20, 300, 8), (7, 1000, 24), (1, 500, 24)])
def test_substrings(docs, width, words, cells):
    rows = [r for r in corpus() if width > 1 or r[0] not in (203,)]
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.dedup(docs.filter("doc_id is null or doc_id <> 203") if width == 1 else docs, width=width, words=words, cells=cells).collect()]
    assert sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1:])) == dedup_by_hand(rows, width)


def test_substring_spans(docs, empty, spark):
    for r in substring_dedup.dedup(docs).collect():
        assert sum(s["stop"] - s["start"] for s in r["removed"]) == r["n_removed"]
        assert r["n_words"] - r["n_removed"] == len(r["kept"].split())
    assert substring_dedup.dedup(empty).count() == 0
    with pytest.raises(TypeError):
        substring_dedup.dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_rolled_windows_tell_order_and_place():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**63, 400, np.uint64)
    h[200:260] = h[100:160]
    for width in (1, 2, 5, 20, 31):
        w = substring_dedup.rolled(h, width)
        assert len(w) == 400 - width + 1
        assert (w[200 : 260 - width + 1] == w[100 : 160 - width + 1]).all()
        assert len(set(w.tolist())) == len(w) - (60 - width + 1)
    swapped = h.copy()
    swapped[[3, 9]] = swapped[[9, 3]]
    assert substring_dedup.rolled(swapped, 20)[0] != substring_dedup.rolled(h, 20)[0]


@pytest.mark.parametrize("name", ["op11_target_resample", "op12_source_audit", "op13_substring_dedup"])
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    df = queries.QUERIES[name](spark, sf)
    want = con.execute(queries.ORACLES[name])
    assert [c[0] for c in want.description] == df.columns
    order = lambda r: [(x is None, str(x)) for x in r]
    assert sorted(map(tuple, df.collect()), key=order) == sorted(want.fetchall(), key=order)


def test_urls_of_very_long_hosts(spark):
    from claimlens.llm import url_filter

    long = "a." * 2_500_000
    rows = [(1, f"http://{long}example.com/en/7"), (2, "http://" + "b" * 10_000_000 + "/en/"), (3, f"http://{'x.' * 50_000}org/es/1"), (4, "http://" + "." * 200_000), (5, f"http://net/de/{'8' * 1_000_000}")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), url_filter.RULES).collect()}
    assert got == {1: ("example.com/en/7", "allow"), 2: (None, "allow"), 3: ("org/es/", "block"), 4: (None, "allow"), 5: ("net/de/", "allow")}
