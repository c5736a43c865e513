"""A text is not rejected for its length."""

import random

from claimlens.llm import quality


def corpus():
    """Labelled plain and junk texts, and unlabelled plain ones with a third of words that no labelled text has, each short or very long."""
    rng = random.Random(5)
    plain, other, junk = ([f"{k}{i}" for i in range(n)] for k, n in (("plain", 40), ("other", 40), ("JUNK", 40)))
    say = lambda n, share: " ".join(rng.choice(other) if rng.random() < share else rng.choice(plain) for _ in range(n))
    rows = [(i, say(120, 0.0)) for i in range(150)] + [(200 + i, " ".join(rng.choice(junk) for _ in range(120))) for i in range(40)]
    # short texts, some of them labelled, and long ones of the same words, none labelled
    rows += [(300 + i, say(40, 0.33)) for i in range(60)] + [(400 + i, say(4000, 0.33)) for i in range(3)]
    labels = [(k, int("JUNK" not in t), 0) for k, t in rows if k < 400 and k % 3 == 0]
    return rows, labels


def test_long_texts_stay_with_their_short_kin(spark):
    rows, labels = corpus()
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r[0] for r in quality.keep_good(docs, known).select("doc_id").collect()}
    assert {400, 401, 402} <= kept and not kept & set(range(200, 240))
    short = [k for k, _ in rows if 300 <= k < 400]
    assert sum(k in kept for k in short) > 0.9 * len(short)
    # summed over all n-grams the same long texts would go
    assert not {400, 401, 402} & {r[0] for r in quality.keep_good(docs, known, length=10**9).select("doc_id").collect()}


def test_weight_is_the_sum_up_to_the_length_and_the_average_beyond(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c " * 900), (3, ""), (4, None)], "doc_id long, text string")
    ratio = quality.fit(docs, {1: 1}, "doc_id", "text", 64)
    features = quality.Features(64)
    got = {r["doc_id"]: (r["n_features"], r["log_weight"]) for r in quality.weights(docs, ratio, "doc_id", "text", 7).collect()}
    for k, t in ((1, "a b c"), (2, "a b c " * 900), (3, ""), (4, "")):
        x = features(t).astype(int)
        total = float(ratio[x].sum())
        assert got[k][0] == len(x) and abs(got[k][1] - (total if len(x) <= 512 else total / len(x) * 512)) < 1e-9
