"""Quotes in sources by automata and by word pairs, against plain ``in``."""

import random

import pytest

from claimlens.operators import joins, scan
from claimlens.operators.joins import containment, held_by
from claimlens.operators.scan import Beginnings

Q, S = "item_id long, domain string, flat string", "source_id string, domain string, flat string"


def tables(seed):
    rng = random.Random(seed)
    words = ["a", "ab", "ba", "abc", "é", "the", "taux", "9,1", "\U0001f600"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    sources = [(f"s{i:02}", rng.choice([None, "x", "y"]), rng.choice([None, ""]) if i < 4 else line(rng.randrange(60))) for i in range(60)]
    quotes = [(i, rng.choice([None, "x", "y"]), None if i == 7 else "" if i == 8 else line(rng.randrange(1, 7))) for i in range(60)]
    whole = next(t for _, _, t in sources if t and len(t) > 20)
    quotes += [(60, None, whole[3:18]), (61, "x", whole[3:18]), (62, None, whole), (63, "z", whole)]
    return quotes, sources


def by_hand(quotes, sources, narrow):
    return {(i, s) for i, d, q in quotes for s, sd, t in sources if q is not None and t is not None and q in t and (not narrow or d is None or d == sd)}


@pytest.mark.parametrize("letters,most", [(1 << 20, 8), (200, 100), (200, 0)])
def test_held_by(spark, monkeypatch, letters, most):
    monkeypatch.setattr(scan, "AUTOMATON", letters)
    monkeypatch.setattr(joins, "PASSES", most)
    quotes, sources = tables(most)
    q, s = spark.createDataFrame(quotes, Q), spark.createDataFrame(sources, S)
    for narrow in (True, False):
        got = held_by(q, s if narrow else s.drop("domain")).collect()
        assert len(got) == len(set(got))
        assert {tuple(r) for r in got} == by_hand(quotes, sources, narrow)


def test_extra_columns_and_empty_tables(spark):
    quotes, sources = tables(1)
    q, s = spark.createDataFrame(quotes, Q), spark.createDataFrame(sources, S)
    from pyspark.sql import functions as F

    extra = lambda df: df.withColumn("rep", F.lit(1)).withColumn("q_domain", F.lit("z")).withColumn("k", F.lit(2))
    assert {tuple(r) for r in held_by(extra(q), extra(s)).collect()} == by_hand(quotes, sources, True)
    assert held_by(q.limit(0), s).count() == 0 and held_by(q, s.limit(0)).count() == 0
    assert containment(q, s.limit(0)).filter("source_id is null").count() == len(quotes)


def test_beginnings_of_long_quotes(monkeypatch):
    monkeypatch.setattr(scan, "BEGINNING", 4)
    text = "abcabcabdabcx" * 3
    quotes = ["abc", "abca", "abcab", "abcabd", "abcx", "abcabcabe", "", text, text + "y", "abcabcabd"]
    assert Beginnings(quotes).found(text) == [i for i, q in enumerate(quotes) if q in text]
    assert Beginnings([]).found(text) == [] and Beginnings([""]).found("") == [0]


def test_a_long_text_of_many_hits():
    text = "ab " * 500_000
    assert Beginnings(["ab", "b a", "ba", "ab ab ab ab"]).found(text) == [0, 1, 3]
