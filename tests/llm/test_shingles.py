"""Near copies of the pipeline's stage against brute force."""

import random
import re

import corpus_pipeline
from claimlens.llm import shingles

SCHEMA = "doc_id long, text string"


def sets(text, words=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {" ".join(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {" ".join(w)} if w else set()


def brute(rows, least=0.8):
    up, s = list(range(len(rows))), [sets(t) for _, t in rows]

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] == s[j] or len(s[i] & s[j]) >= least * len(s[i] | s[j]) > 0:
                up[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))]


def corpus():
    """Texts with copies from far below to well above the threshold, and chains of copies of copies."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for n in (30, 100, 250, 600):
        for _ in range(12):
            base = [rng.choice(words) for _ in range(n)]
            rows.append(base)
            for changes in (1, 2, n // 60, n // 45, n // 30, n // 15):
                w = list(base)
                for _ in range(changes):
                    w[rng.randrange(n)] = rng.choice(words)
                rows.append(w)
            rows.append(list(rows[-3]))
            rows[-1][n // 2] = "again"
    texts = [" ".join(w) for w in rows] + ["", None, " \n", "one", "ONE", "one two"]
    return list(enumerate(texts))


def test_stage_finds_every_pair_of_the_threshold(spark):
    rows = corpus()
    want = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["doc_id"]: r["root"] for r in shingles.near_duplicates(df).collect()}
    classes = lambda of: sorted(sorted(k for k in range(len(rows)) if of(k) == v) for v in {of(k) for k in range(len(rows))})
    assert classes(got.get) == classes(want.__getitem__)
    left = corpus_pipeline.near_duplicates(spark, df, None)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(set(want))


def test_one_changed_word_of_a_hundred_is_a_near_copy(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        w = [f"x{rng.randrange(5000)}" for _ in range(100)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:50] + ["changed"] + w[51:]))]
    left = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), None)
    assert sorted(r["doc_id"] for r in left.collect()) == list(range(0, 120, 2))


def test_points_apart_from_the_least_of_a_cell_are_compared(spark, monkeypatch):
    """With one cell for all, everything rests on the comparisons within it."""
    monkeypatch.setattr(shingles, "bands", lambda s: [7] if len(s) else [])
    monkeypatch.setattr(shingles, "points_of", local_points)
    rows = corpus()[:60]
    got = {r["doc_id"]: r["root"] for r in shingles.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows)
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(60) for j in range(i))


def local_points(docs, key, text, words):
    import xxhash

    from claimlens.llm.rows import text_key

    out = []
    for r in docs.withColumn("text_key", text_key(key, text)).collect():
        s = shingles.shingle_set((r[text] or "").encode(), words)
        out.append((r[key], r["text_key"], bytearray(xxhash.xxh128_digest(s.tobytes(), shingles.SEED)), len(s), shingles.bands(s)))
    return docs.sparkSession.createDataFrame(out, f"{key} long, text_key binary, point binary, size long, cells array<long>")


def test_null_and_shared_ids(spark):
    t = " ".join(f"a{i}" for i in range(60))
    rows = [(None, t), (None, t + " more"), (4, t + " end"), (5, "other text of a few words"), (5, "another text with some more words"), (None, "alone with no id at all")]
    left = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), None).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left) == sorted([(0, rows[5][1]), (4, rows[2][1]), (5, rows[3][1]), (5, rows[4][1])])
    assert corpus_pipeline.near_duplicates(spark, spark.createDataFrame([], SCHEMA), None).count() == 0


def test_close_fingerprints_link_by_anchors(spark, monkeypatch):
    """With no cells for any, the copies within 3 bits of one another are found by their fingerprints; the sets still decide."""
    from claimlens.llm.simhash import fingerprint

    monkeypatch.setattr(shingles, "bands", lambda s: [])
    monkeypatch.setattr(shingles, "points_of", local_points)
    rng, rows = random.Random(3), []
    for i in range(20):
        w = [f"y{rng.randrange(5000)}" for _ in range(600)]
        rows += [(3 * i, " ".join(w)), (3 * i + 1, " ".join(["begun", *w[1:]])), (3 * i + 2, " ".join([*w[:-1], "ended"]))]
    # one shingle decides both fingerprints, the sets share one of eleven
    rows += [(100, "a " * 100 + "b c d e f"), (101, "a " * 100 + "g h i j k")]
    fp = {k: fingerprint(t.encode(), 5) for k, t in rows}
    near = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3]
    assert fp[100] == fp[101] and len(near) > 30
    got = {r["doc_id"]: r["root"] for r in shingles.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[a] == got[b] for a, b in near if a < 100) and got[100] != got[101]


def test_copies_changed_apart_make_no_pairs(spark):
    """Copies of one text that share a rare change by chance, but differ in too many others, are not paired; every pair of the threshold is."""
    import zstandard

    rng, texts = random.Random(8), []
    base = [f"z{rng.randrange(5000)}" for _ in range(150)]
    for i in range(300):
        gone = set(rng.sample(range(150), 8 if i % 3 else 2))
        texts.append(" ".join(x for k, x in enumerate(base) if k not in gone))
    own = [shingles.shingle_set(t.encode(), 5) for t in texts]
    name = lambda i: bytearray(i.to_bytes(2, "big"))
    points = spark.createDataFrame([(name(i), len(s), name(i)) for i, s in enumerate(own)], "point binary, size long, root binary")
    bodies = spark.createDataFrame([(name(i), bytearray(zstandard.compress(t.encode()))) for i, t in enumerate(texts)], "point binary, body binary")
    got = {(int.from_bytes(r["a"], "big"), int.from_bytes(r["b"], "big")) for r in shingles.rare_pairs(points, bodies, 5, 0.8).collect()}
    want = {(a, b) for b in range(300) for a in range(b) if shingles.similarity(own[a], own[b]) >= 0.8}
    assert want and want <= got and len(got - want) < 300


def test_marks_differ_in_no_more_bits_than_sets():
    rng = random.Random(9)
    for n in (0, 1, 5, 100, 3000):
        a = shingles.shingle_set(" ".join(f"q{rng.randrange(9000)}" for _ in range(n)).encode(), 1)
        for cut in (0, n // 9, n // 2):
            b = a[cut:]
            bits = sum(((int(x) ^ int(y)) & (1 << 64) - 1).bit_count() for x, y in zip(shingles.mark(a), shingles.mark(b)))
            assert bits <= len(a) - len(b)
