"""run() as a whole against its stages done by brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import xxhash
from test_pii_terms_exact import brute_terms
from test_shingles import brute
from tokenizers import Tokenizer

import corpus_pipeline
from claimlens.llm import pii, quality
from claimlens.llm.packing import default_path

SCHEMA = "doc_id long, text string, root string, text_key int, kept string"


def corpus():
    """Good and bad texts, copies, near copies, people and texts without words."""
    rng = random.Random(11)
    good, bad = [f"plain{a}{b}" for a in "abcdefghij" for b in "klmnopqrstuvwxyz"], [f"SPAM{i}!!" for i in range(60)]
    draw = lambda: [rng.choice(good) for _ in range(rng.randint(60, 120))]
    rows = [(i, " ".join(draw())) for i in range(120)]
    rows += [(200 + i, " ".join(rng.choice(bad) for _ in range(80))) for i in range(40)]
    rows += [(300 + i, rows[i][1].upper() if i % 2 else rows[i][1]) for i in range(15)]
    for i in range(20, 45):
        w = rows[i][1].split()
        w[len(w) // 2] = "changed"
        rows.append((380 + i, " ".join(w)))
    for i in range(12):
        for j in range(3):
            w = draw()
            w[5:5] = [f"Zed{chr(97 + i)}", f"z{i}@mail.example"] if j else [f"Zed{chr(97 + i)}", "+33 1 22 33 44 55"]
            rows.append((500 + 3 * i + j, " ".join(w)))
    rows += [(None, " ".join(draw())), (700, None), (701, ""), (702, " \n"), rows[3], rows[50]]
    # a long text like labelled ones, and one of word pairs that no labelled text has
    rows += [(704, " ".join(rows[i][1] for i in range(60, 120, 2))), (703, " ".join(draw() * 40))]
    return rows


def drawn(rows, labels):
    """The rows that the quality stage draws: importance weights over whole texts, cut where the fewest labels are wrong."""
    features = quality.Features(quality.BUCKETS)
    found = [Counter(features(t or "").tolist()) for _, t in rows]
    label = {k: y for k, y, _ in labels if k is not None and y is not None}
    raw, target = Counter(), Counter()
    for (k, _), f in zip(rows, found):
        raw.update(f)
        if label.get(k) == 1:
            target.update(f)
    n_raw, n_target = raw.total() + quality.BUCKETS, target.total() + quality.BUCKETS
    w = [sum(n * (math.log((target[x] + 1) / n_target) - math.log((raw[x] + 1) / n_raw)) for x, n in f.items()) * min(1, 512 / max(f.total(), 1)) for f in found]
    least = {k: min(x for (j, _), x in zip(rows, w) if j == k) for k in label}
    s = sorted((x, label[k]) for k, x in least.items())
    wrong = [sum(y == 1 for _, y in s[:i]) + sum(y == 0 for _, y in s[i:]) for i in range(len(s) + 1)]
    i = wrong.index(min(wrong))
    cut = (s[i - 1][0] + s[i][0]) / 2
    noise = [-math.log(-math.log(((xxhash.xxh64_intdigest(str(k).encode(), 7) >> 11) + 0.5) / 2**53)) for k, _ in rows]
    perturbed = [x + g if f else -math.inf for x, g, f in zip(w, noise, found)]
    last = sorted(perturbed, reverse=True)[sum(x >= cut for x, f in zip(w, found) if f) - 1]
    return [r for r, x, f in zip(rows, perturbed, found) if f and x >= last]


def wanted(rows, labels):
    """The rows that packing gets."""
    rows = drawn(rows, labels)
    last = {}
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    order = lambda k: -1 if k is None else k
    for k, t in rows:
        if lower(t) not in last or order(k) > order(last[lower(t)][0]):
            last[lower(t)] = (k, t)
    rows = list(last.values())
    groups = defaultdict(list)
    for row, c in zip(rows, brute(rows)):
        groups[c].append(row)
    rows = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    out = []
    for (k, t), terms in zip(rows, brute_terms(rows)):
        spans = [(pii.KINDS[x], a, b) for x, a, b in pii.base_spans(t)] + terms
        clean, at = "", 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= at:
                clean += t[at:a] + ("" if kind == "removed_term" else pii.generalise(t[a:b]) if kind == "term" else f"<{kind.upper()}>")
            at = max(at, b)
        out.append((k, clean + t[at:]))
    return out


def written(spark, tmp_path, rows, labels):
    spark.createDataFrame([(k, t, "r", 1, "k") for k, t in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_run_equals_its_stages_by_brute_force(spark, tmp_path):
    rows = corpus()
    labels = [(k, int("SPAM" not in t), 0) for k, t in rows if k is not None and t and t.strip() and k % 2 == 0 and k < 700] + [(None, 1, 0), (1, None, 0)]
    pieces = corpus_pipeline.run(spark, written(spark, tmp_path, rows, labels)).collect()
    got, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"]
        got[p["doc_id"]].append((p["start"], ids))
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    tokenizer = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    want = wanted(rows, labels)
    # the long text unlike the labelled ones goes by its average pair of words (README, op8)
    assert {k for k, _ in drawn(rows, labels)} == {k for k, t in rows if t and t.strip() and "SPAM" not in t and k != 703}
    assert 130 < len(want) < 170 and any("<EMAIL>" in t for _, t in want) and any("<PHONE>" in t for _, t in want)
    ids = {k: sum((x for _, x in sorted(v)), []) for k, v in got.items()}
    assert ids == {k: tokenizer.encode(t, add_special_tokens=False).ids + [0] for k, t in want}
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert Counter(len(v) > 1 for v in got.values())[True] >= 1


def test_run_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, [], [])).count() == 0
