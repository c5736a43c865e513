"""The ten operators against brute force on small fixtures with hard cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from claimlens.llm import ann, bpe, components, exact_dedup, packing, pii, quality, simhash, token_counts, url_filter
from claimlens.llm.tokenise import default_path, json_vocabulary_encoder, pattern, read_ranks

SCHEMA = "doc_id long, text string, lang string, component_id string, fp int"


def corpus(seed=0, n=160):
    rng = random.Random(seed)
    words = ["the", "of", "Ünïcode", "alpha", "BETA", "gamma,", "x\ny", "de", "la", "日本", "end."] + [f"w{i}" for i in range(120)]
    rows, base = [], [rng.choice(words) for _ in range(400)]
    for i in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(1, 90)))
        if i % 7 == 0:
            t = " ".join(base[:200])
        if i % 11 == 0:
            w = list(base[:300])
            w[rng.randrange(300)] = "changed"
            t = " ".join(w)
        rows.append((i, t))
    rows += [(900, None), (901, ""), (902, "  \t\n"), (903, "The Of"), (904, "THE OF"), (905, "a" * 3000 + " " + "b c " * 2000), (None, "null key"), (3, rows[3][1]), (903, "The Of"), (906, "mail a@b.co or +33 1 22 33 44 55")]
    return [(k, t, None if i % 5 else "xx", "clash", None) for i, (k, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts(docs, empty):
    enc = json_vocabulary_encoder(default_path("byte_bpe_50k.json"))
    lens = [len(enc(r[1] or "")) for r in corpus()]
    hist = token_counts.length_histogram(docs)
    got = {r["n_tokens"]: r for r in token_counts.suffix_sums(hist).collect()}
    assert set(got) == set(lens)
    for n, r in got.items():
        assert r["n_docs"] == lens.count(n)
        assert r["docs_at_least"] == sum(x >= n for x in lens)
        assert r["tokens_at_least"] == sum(x for x in lens if x >= n)
        assert r["docs_up_to"] == sum(x <= n for x in lens)
        assert r["truncated_tokens"] == sum(min(x, n) for x in lens)
    answers = token_counts.suffix_sums(hist)
    for limit in (0, 1, 17, 250, 10**6):
        assert token_counts.truncated_total(answers, limit).first()[0] == sum(min(x, limit) for x in lens)
    assert token_counts.quantile(answers, 0.5).first()[0] == min(n for n in lens if sum(x <= n for x in lens) >= len(lens) / 2)
    assert token_counts.suffix_sums(token_counts.length_histogram(empty)).count() == 0


def test_same_ids_as_the_tokenizers_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    enc = json_vocabulary_encoder(default_path("byte_bpe_50k.json"))
    rng = random.Random(4)
    for s in [r[1] or "" for r in corpus()] + ["".join(rng.choice("ab C'séñ 日🙂\n\t12.!<|endoftext|> ") for _ in range(50)) for _ in range(500)] + ["<|endoftext|> x"]:
        assert enc(s) == t.encode(s, add_special_tokens=False).ids


def test_urls(spark, tmp_path):
    cases = {
        "https://a.example.com/en/7x?q#f": ("a.example.com", "/en/7x", "example.com/en/7", "allow"),
        "https://EXAMPLE.com/en/81": ("example.com", "/en/81", "com/en/", "block"),
        "http://example.net/de/8": ("example.net", "/de/8", "example.net/de/8", "block"),
        "http://x.net/de/": ("x.net", "/de/", "net/de/", "allow"),
        "http://x.net/de": ("x.net", "/de", None, "allow"),
        "ftp://b.org/es/1://c": ("b.org", "/es/1://c", "org/es/", "block"),
        "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
        "http://h?x/en/": ("h", "", None, "allow"),
        "nothing": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "http://É.ORG/es/\nx": ("É.org", "/es/\nx", "org/es/", "block"),
    }
    rows = [(i, u, "x") for i, u in enumerate(cases)] + [(99, None, "x"), (0, list(cases)[0], "x")]
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, verdict string"), url_filter.RULES).collect()}
    assert got == {(i, *v) for i, v in enumerate(cases.values())} | {(99, "", "", None, "allow")}
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), url_filter.RULES).count() == 0
    # entries with equal digests are told apart by their strings
    url_filter.write_digest_array(url_filter.RULES, str(tmp_path / "d"))
    a = url_filter.DigestArray(str(tmp_path / "d"))
    a.keys = np.full(len(a.keys), xxhash.xxh64_intdigest(b"com/en/"), "<u8")
    assert a.string(int(a.probe([b"com/en/"])[0])) == b"com/en/" and a.probe([b"com/xx/"])[0] == -1


def brute_fingerprint(text, words=3):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    sh = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_classes(fps, keys, threshold=3):
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= threshold:
                up[max(find(i), find(j))] = min(find(i), find(j))
    low = defaultdict(list)
    for i, k in enumerate(keys):
        if k is not None:
            low[find(i)].append(k)
    return [min(low[find(i)], default=None) for i in range(len(fps))]


def test_simhash(docs, empty):
    rows = corpus()
    fps = [brute_fingerprint(r[1]) for r in rows]
    want = Counter(zip([r[0] for r in rows], [f"{f:016x}" for f in fps], brute_classes(fps, [r[0] for r in rows])))
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("cell", [8, 4096])
def test_links_find_every_pair_within_the_threshold(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(2)
    points = set()
    for c in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            f = base
            for _ in range(rng.randint(0, 5)):
                f ^= 1 << rng.randrange(64)
            points.add(f)
    points = sorted(points)
    want = brute_classes(points, points)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    root = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    got = defaultdict(set)
    for p, s in zip(points, signed):
        got[root.get(s, s)].add(p)
    wanted = defaultdict(set)
    for p, w in zip(points, want):
        wanted[w].add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, wanted.values()))


def test_components_of_a_long_path_and_a_hub(spark):
    e = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(None, 5), (7, 7)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_duplicates(docs, empty, keep):
    rows = [(r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")) for r in corpus()]
    groups = defaultdict(list)
    for k, t in rows:
        groups[t].append(k)
    best = {t: (max if keep == "max" else min)((k for k in ks if k is not None), default=None) for t, ks in groups.items()}
    got = exact_dedup.exact_duplicates(docs, keep=keep).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == Counter((k, best[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for k, t in rows)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)
    left = exact_dedup.drop_duplicates(docs, keep=keep)
    assert left.columns == docs.columns
    assert Counter((r["doc_id"], "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")) for r in left.collect()) == Counter((best[t], t) for t in groups)
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.drop_duplicates(empty).count() == 0


def test_equal_digests_of_different_texts_stay_apart(spark):
    rows = [(i, i, 5, bytes([i % 3]), 1) for i in range(9)]
    got = exact_dedup.merge_runs(spark.createDataFrame(rows, "id long, row long, d long, sha binary, size long")).collect()
    assert sorted((bytes(r["sha"]), r["keep_id"], r["cnt"]) for r in got) == [(b"\0", 6, 3), (b"\1", 7, 3), (b"\2", 8, 3)]


def test_packing(docs, empty):
    enc = json_vocabulary_encoder(default_path("byte_bpe_50k.json"))
    want = Counter((r[0], tuple(enc(r[1] or "") + [0])) for r in corpus())
    pieces = packing.pack(docs, capacity=256).collect()
    by_seq = defaultdict(list)
    for r in pieces:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by_seq.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 256
    total = sum(len(t) * n for (_, t), n in want.items())
    assert len(by_seq) * 256 <= 1.06 * total + 256
    seen = defaultdict(list)
    for r in pieces:
        seen[r["doc_id"], r["doc_tokens"]].append((r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())))
    for (k, t), n in want.items():
        assert sum(len(x) for _, x in seen[k, len(t)]) == sum(len(u) * m for (j, u), m in want.items() if j == k and len(u) == len(t))
        if n == 1 and sum(1 for j, u in want if j == k and len(u) == len(t)) == 1:
            assert sum((x for _, x in sorted(seen[k, len(t)])), ()) == t
    assert packing.pack(empty).count() == 0


def test_column_generation_is_near_the_bound():
    rng = np.random.default_rng(0)
    d = {int(n): int(c) for n, c in zip(*np.unique(rng.integers(1, 64, 5000), return_counts=True))}
    patterns = packing.column_generation(d, 64)
    for n, c in d.items():
        assert sum(x * p.get(n, 0) for x, p in patterns) == pytest.approx(c, rel=1e-6)
    assert all(sum(n * k for n, k in p.items()) <= 64 for _, p in patterns)
    assert sum(x for x, _ in patterns) <= 1.02 * max(sum(n * c for n, c in d.items()) / 64, 1)


#: The contract's patterns.
BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(text):
    out = []
    for k, p in BASE:
        for m in re.finditer(p, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            if k == "ip":
                ok = all(int(x) <= 255 for x in m[0].split("."))
            elif k == "phone":
                ok = 8 <= len(digits) <= 15
            else:
                ok = k == "email" or 16 <= len(digits) <= 19 and sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(digits[::-1])) % 10 == 0
            if ok:
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    fixed = ["a@b.c@d.e", "x@y..z", "@a.b", "..@a-.b-", "1.2.3.4.5.6.7.8", "256.1.1.1 001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1111 5", "+1 (22) 333-44.", "++12345678", "é日 a@b.co +33 1 22 33 44 55", "1" * 3000, "a" * 3000 + "@", "a.b@c.d.e@f.g"]
    for s in fixed + ["".join(rng.choice("a1@.+-%() 4é9") for _ in range(rng.randint(0, 60))) for _ in range(6000)]:
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(s)] == brute_spans(s), s


def test_revealing_terms(spark):
    filler = ["common words stand here", "other words of no meaning", "more of the same here"]
    rows = [(i, f"{filler[i % 3]} number{i} dr zanthor {filler[(i + 1) % 3]} zed{'abcdef'[i % 6]} mail z@corp.example please {filler[i % 3]}") for i in range(6)]
    rows += [(100 + i, f"{filler[i % 3]} clean text {i}") for i in range(60)] + [(200, "zanthor alone in a clean document"), (300, None), (301, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.personal_data(df, disclosure=0.6).collect()}
    text = dict(rows)
    for k, t in text.items():
        spans = [(s["kind"], s["start"], s["stop"]) for s in got[k]["spans"]]
        assert [s for s in spans if s[0] in pii.KINDS] == brute_spans(t or "")
        terms = {(t or "")[a:b] for kind, a, b in spans if kind not in pii.KINDS}
        assert terms <= {"mail", "please", "zanthor", "dr", "common", "other", "more"} and ("mail" in terms) == (k < 6)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df, disclosure=0.6).collect()}
    assert len(clean) == len(rows) and all(clean[k] == t for k, t in rows if k >= 6)
    assert all("z@corp" not in clean[k] and "<EMAIL>" in clean[k] for k in range(6))
    d = {r["doc_id"]: r for r in pii.digests(pii.personal_data(df)).collect()}
    assert d[0]["n_email"] == 1 and d[0]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(text[0])).encode()).hexdigest()
    assert d[300]["spans"] == "" and d[300]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.personal_data(df.limit(0)).count() == 0


def test_quality(spark):
    rng = random.Random(3)
    good, bad = [f"good{i}" for i in range(50)], [f"BAD{i}!!" for i in range(50)]
    rows = [(i, " ".join(rng.choice(good if i % 4 else bad) for _ in range(60))) for i in range(400)] + [(1000, None), (1001, ""), (None, "good1 good2"), (5, "good1 good1 good3")]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 200)] + [(3, None, 0), (None, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(k, t, "q") for k, t in rows], "doc_id long, text string, kept string")
    got = quality.resample(df, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] != 5:
            assert r["kept"] == (r["doc_id"] % 4 > 0)
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r["kept"] for r in got)
    half = quality.resample(df, labels, share=0.5).collect()
    top = sorted((r["gumbel_weight"] for r in half), reverse=True)[: round(len(rows) / 2)]
    assert all(r["kept"] == (r["gumbel_weight"] >= top[-1]) for r in half)
    assert quality.resample(df.limit(0), labels).count() == 0
    assert quality.resample(df, labels.limit(0)).count() == len(rows)


def test_gumbel_weights_draw_in_proportion(spark):
    """Without log weights, the top share is a uniform sample without replacement."""
    df = spark.range(20000).selectExpr("id as doc_id", "'' as text")
    ratio = np.zeros(quality.BUCKETS)
    w = np.array([r[0] for r in quality.weights(df, ratio, "doc_id", "text", 7).select("gumbel_weight").collect()])
    assert abs(w.mean() - 0.5772) < 0.05


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 16))
    x[100:140] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(4000, None), (4001, [0.0] * 16), (4002, [float("nan")] * 16), (4003, [1.0] * 3), (4004, [None] * 16), (4005, [float("inf")] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame([(k, v, 0) for k, v in rows], "vec_id long, embedding array<double>, rank int")
    got = defaultdict(list)
    for r in ann.nearest(df, "id % 50 = 0", block=700, queries=25).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    hit = 0
    for q in range(0, 3000, 50):
        s = unit @ unit[q]
        s[q] = -9
        want = np.lexsort((np.arange(3000), -np.round(s, 11)))[:5]
        assert len(got[q]) == 5 and q not in [v for v, _ in got[q]]
        assert [v for _, v in got[q]] == sorted((v for _, v in got[q]), reverse=True)
        hit += len(set(want) & {v for v, _ in got[q]})
        if q == 100:
            assert [v for v, _ in got[q]] == [7, 101, 102, 103, 104]
    assert hit / 300 >= 0.9 and set(got) == set(range(0, 3000, 50))
    assert ann.nearest(df.limit(0), "id % 50 = 0").count() == 0
    few = {r["vec_id"] for r in ann.nearest(df.filter("vec_id < 3"), "id % 50 = 0").collect()}
    assert few == {1, 2}


def test_chi_square():
    x = np.random.default_rng(0).chisquare(8, 200_000)
    for q in (0.1, 0.5, 0.95):
        assert float(ann.chi_square_cdf(np.quantile(x, q), 8)) == pytest.approx(q, abs=0.01)


def test_bpe(docs, empty):
    import tiktoken

    path = default_path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("t", pat_str=pattern(), mergeable_ranks=read_ranks(path), special_tokens={})
    c = bpe.codec(path)
    rng = random.Random(8)
    texts = [r[1] or "" for r in corpus()] + ["".join(rng.choice("abc  deth'sé ñ\n\t日本語 123.,! 🙂üß \x85\x1c") for _ in range(rng.randint(0, 80))) for _ in range(2000)]
    texts += ["".join(rng.choice("aehtins") for _ in range(400)) for _ in range(100)] + ["ab" * 50_000]
    for t in texts:
        ids = c.encode(t)
        assert ids == enc.encode_ordinary(t)
        assert c.decode(ids) == t.encode()
    want = Counter((r[0], len(enc.encode_ordinary(r[1] or "")), hashlib.sha256(",".join(map(str, enc.encode_ordinary(r[1] or ""))).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in corpus())
    assert Counter(map(tuple, bpe.round_trip_digests(docs).collect())) == want
    both = bpe.decode(bpe.encode(docs))
    assert Counter((r["doc_id"], bytes(r["bytes"])) for r in both.collect()) == Counter((r[0], (r[1] or "").encode()) for r in corpus())
    assert bpe.round_trip_digests(empty).count() == 0
