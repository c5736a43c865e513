"""Transcript and report operators on literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from claimlens.functions import text as T
from claimlens.operators import reports as R
from claimlens.operators import transcripts as S


def fold(cues):
    """Each cue without what the text last emitted already said, by trying every length."""
    out = []
    for a, b, text in cues:
        w = text.split()
        if not w:
            continue
        if out:
            p = out[-1][2].split()
            k = max((k for k in range(min(len(p), len(w), 25) + 1) if [x.lower() for x in p[len(p) - k :]] == [x.lower() for x in w[:k]]), default=0)
            w = w[k:]
            if not w:
                out[-1] = (out[-1][0], b, out[-1][2])
                continue
        out.append((a, b, " ".join(w)))
    return out


def test_caption_fold(spark):
    rng = random.Random(3)
    files = {f: [(float(i), float(i + 1), " ".join(rng.choice(["on", "va", "Va", "tous", ""]) for _ in range(rng.randint(0, 5)))) for i in range(60)] for f in ("a", "b")}
    rows = [(f, i, *c) for f, cues in files.items() for i, c in enumerate(cues)]
    got = S.caption_fold(spark.createDataFrame(rows, "file string, seq int, start double, stop double, text string").repartition(3), "file").collect()
    for f, cues in files.items():
        assert sorted((r["start"], r["stop"], r["text"]) for r in got if r["file"] == f) == fold(cues)


def test_figures_with_scale(spark):
    text = "3 000 milliards et 600 millions, 12,5 % des 7 logements"
    got = spark.range(1).select(T.figures_with_scale(F.lit(text)).alias("x")).first()[0]
    assert [(r["figure"], r["scale"]) for r in got] == [("3000", "milliards"), ("600", "millions"), ("12.5", ""), ("7", "")]


def test_pair_classes(spark):
    a = spark.createDataFrame([(1, "3", "millions"), (2, "4", ""), (3, "5", "%"), (4, "6", "")], "id int, figure string, scale string")
    b = spark.createDataFrame([(11, "3", ""), (12, "4", "milliards"), (13, "5", "millions"), (15, "9", "")], "id int, figure string, scale string")
    pairs = spark.createDataFrame([(1, 11), (2, 12), (3, 13), (4, None), (None, 15)], "left_id int, right_id int")
    got = {(r["left_id"], r["right_id"]): r["class"] for r in R.pair_classes(pairs, a, b).collect()}
    assert got == {(1, 11): "agree", (2, 12): "agree", (3, 13): "disagree", (4, None): "left_alone", (None, 15): "right_alone"}


def test_confirmation(spark):
    rows = [(1, True, "A")] * 3 + [(2, True, "A"), (2, True, "B"), (2, False, "C")] + [(3, True, "A")] * 2 + [(3, False, "A")] + [(4, True, "A")] * 3 + [(4, True, None)] + [(5, False, "A")] * 4
    got = {r["k"]: r["confirmed"] for r in R.confirmation(spark.createDataFrame(rows, "k int, usable boolean, who string"), "k").collect()}
    assert got == {1: "A", 2: "plusieurs", 3: "", 4: "", 5: ""}


def test_surname_forms_and_references():
    assert T.surname_forms_of("Élodie Saint-Été") == ["saint-ete", "saint ete"] and T.surname_forms_of("Al Li", 4) == []
    schema = {"$defs": {"A": {"type": "object", "properties": {"b": {"$ref": "#/$defs/B"}}}, "B": {"enum": ["x"]}}, "items": [{"$ref": "#/$defs/A", "title": "t"}]}
    assert T.inline_refs(schema) == {"items": [{"type": "object", "properties": {"b": {"enum": ["x"]}}, "title": "t"}]}
    with pytest.raises(ValueError):
        T.inline_refs({"$defs": {"A": {"$ref": "#/$defs/A"}}, "x": {"$ref": "#/$defs/A"}})


def test_empty_tables(spark):
    e = spark.createDataFrame([], "conv_id int, seq int, start double, stop double, text string, speaker_id string, role string")
    assert S.caption_fold(e, "conv_id").count() == 0 and S.analysed(e).count() == 0 and S.time_slice(e, 0, 1).count() == 0
    w = spark.createDataFrame([(1, 1, 0.0, 2.0)], "conv_id int, k int, lo double, hi double")
    assert S.text_within(e, w, ["conv_id"], "k").collect()[0]["text"] == ""
