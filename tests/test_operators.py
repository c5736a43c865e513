"""Scalars, sources and the stream on the survey's literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from claimlens.functions import numbers as N
from claimlens.functions import text as T
from claimlens.functions.triggers import spans_of
from claimlens.operators import folds as FO
from claimlens.operators import joins as J
from claimlens.operators import windows as W
from claimlens.sources import readers, writers
from claimlens.streaming.ledger import ledger_stream


def read(s):
    return [(q["kind"], q["value"]) for q in N.read_quantities(s)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("3 460 milliards", [("magnitude", 3.46e12)]),
        ("3460 milliards", [("magnitude", 3.46e12)]),
        ("trois mille quatre cent soixante milliards", [("magnitude", 3.46e12)]),
        ("150 milliards.", [("magnitude", 1.5e11)]),
        ("en 2024, jusqu'a 2028.", [("year", 2024.0), ("year", 2028.0)]),
        ("une autre chose et deux", []),
        ("45,3 %", [("percent", 45.3)]),
        ("vingt pour cent", [("percent", 20.0)]),
        ("quatre-vingts pour cent", [("percent", 24.0)]),  # a known quirk
        ("4.8 %", [("percent", 48.0)]),  # a known quirk
        ("2025 600", [("magnitude", 2025600.0)]),  # a known quirk
        ("deux mille euros", []),  # a known quirk
        ("", []),
    ],
)
def test_quantities(text, want):
    assert read(text) == want


def test_triggers():
    t = spans_of("Depuis 2017, le chômage est au plus bas : 7,3 % et 3 460 milliards d'euros, grâce à nous.")
    assert [x["type"] for x in t] == ["date_or_period", "superlative", "percentage", "amount", "causality"]
    assert spans_of(None) == [] and [x["type"] for x in spans_of("hausse de 2,3 %.")] == ["percentage"]


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def test_text_scalars(spark):
    lit = F.lit
    assert one(spark, T.claim_key(lit("Le chômage: 2 710 400 personnes, à 7,3 %"))) == "chomage 2710400 personnes 7,3"
    assert one(spark, T.overlap_remainder(lit("on va tous"), lit("Va tous partir demain"))) == "partir demain"
    assert one(spark, T.sentences(lit("Un. Deux ! Étage… trois."))) == ["Un.", "Deux !", "Étage… trois."]
    assert one(spark, T.clock(lit(3725.4))) == "1:02:05" and one(spark, T.clock(lit(59))) == "0:59"
    assert one(spark, T.seconds_of(lit("01:02:03.500"))) == 3723.5
    assert one(spark, T.slug(lit(" Élodie d'Été "))) == "elodie-d-ete"
    assert one(spark, T.longest_repeat(lit("a b a b a b c"))) == 3
    assert one(spark, T.name_score(lit("bonjour madame dupond"), lit("Dupont"))) == "recoverable"
    assert one(spark, T.surname(lit("Jean de la Tour"))) == "de la Tour"
    assert one(spark, T.model_json(lit("x</think>```{\"a\":1}```"))) == '{"a":1}'
    assert one(spark, T.html_text(lit("<a & b>"))) == "&lt;a &amp; b&gt;"
    assert one(spark, T.flatten_quote(lit("2025 ......... 43,6 % du PIB"))) == "2025 43,6 % du pib"
    assert one(spark, T.checksum_matches(lit("x"), lit(""))) is None
    assert one(spark, N.to_float(lit("3 460,5"))) == 3460.5 and one(spark, N.to_float(lit("x"))) is None


@pytest.mark.parametrize("v, gap, unit, rank, want", [("false", 0.1, "points", 2, "exact"), ("exact", 1.7, "points", 1, "unverified"), ("approximate", 1.7, "points", 1, "approximate"), ("false", 10.0, "relative", 1, "false"), ("false", 10.0, "relative", 2, "approximate"), ("too_vague", 0.0, "points", 1, "too_vague"), ("exact", None, None, 1, "exact"), ("false", abs(4.8 - 5.1), "points", 1, "exact")])
def test_thresholds(spark, v, gap, unit, rank, want):
    c, _ = N.threshold_verdict(F.lit(v), F.lit(0.9), F.lit(gap).cast("double"), F.lit(unit).cast("string"), F.lit(rank))
    assert one(spark, c) == want


def test_containment(spark):
    q = spark.createDataFrame([(1, "b c d e"), (2, "zz"), (3, "c d"), (4, "a b c d e")], "item_id long, flat string")
    s = spark.createDataFrame([(10, "a b c d e f"), (11, "x b c d e"), (12, "zzz")], "source_id long, flat string")
    want = {(1, 10), (2, 12), (3, 10), (4, 10)}
    assert {tuple(r) for r in J.containment(q, s).collect()} == want
    assert {tuple(r) for r in J.containment(q.filter("item_id in (1, 4)"), s).collect()} == {(1, 10), (4, 10)}


def test_greedy_pairs(spark):
    a = spark.createDataFrame([("g", 1, 0.0), ("g", 2, 1.0), ("g", 3, 50.0)], "k string, id long, t double")
    b = spark.createDataFrame([("g", 7, 1.0), ("g", 8, 5.0), ("g", 9, 100.0)], "k string, id long, t double")
    assert {tuple(r) for r in J.greedy_nearest(a, b, "k").collect()} == {(1, 7), (2, 8), (3, None), (None, 9)}


def test_capped_blocks_and_spacing(spark):
    rows = spark.createDataFrame([("u", i, float(i * 10), float(i * 10 + 9)) for i in range(7)], "k string, seq long, a double, b double")
    assert [(r["start"], r["n"]) for r in FO.capped_blocks(rows, ["k"], "a", "b", "seq").orderBy("block").collect()] == [(0.0, 3), (30.0, 3), (60.0, 1)]
    times = spark.createDataFrame([("k", t) for t in (0.0, 10.0, 30.0, 59.0, 60.0)], "k string, t double")
    assert tuple(FO.spaced(times, ["k"], "t", 30.0).first()) == ("k", 3, 0.0)


def test_round_trips(spark, tmp_path):
    t = {"source": "s", "transcription": {"famille": "whisper"}, "blocs": [{"debut": 0, "fin": 2.5, "texte": "Un.", "locuteur": "A"}]}
    (tmp_path / "t.json").write_text(json.dumps(t))
    assert [(r["family"], r["seq"], r["stop"]) for r in readers.transcripts(spark, str(tmp_path / "t.json")).collect()] == [("whisper", 0, 2.5)]
    (tmp_path / "u.json").write_text(json.dumps({"blocs": t["blocs"]}))
    with pytest.raises(Exception, match="family"):
        readers.transcripts(spark, str(tmp_path / "u.json")).select("family").collect()
    (tmp_path / "a.vtt").write_text("WEBVTT\nKind: captions\n\n00:01.000 --> 00:02.500 align:start\n<c>Bon</c>jour  a\n\n01:00:00.000 --> 01:00:01.000\n\n")
    assert [(r["start"], r["stop"], r["text"]) for r in readers.subtitles(spark, str(tmp_path / "a.vtt")).collect()] == [(1.0, 2.5, "Bon jour a")]
    df = spark.createDataFrame([("1", "a", "b"), ("2", "c", ""), ("3", "d", None)], "statement_id string, text string, brief string")
    writers.batch_jsonl(df, str(tmp_path / "out"), {"format": "1"})
    assert {r["statement_id"] for r in readers.jsonl(spark, str(tmp_path / "out"), "statement_id string, text string").collect()} == {"1"}
    base = tmp_path / "base" / "jobs" / "sources"
    base.mkdir(parents=True)
    (base / "x.meta.yaml").write_text("rang: 2\n")
    (base / "x.txt").write_text("7,3 %")
    (base / "lost.meta.yaml").write_text("rang: 1\n")
    assert [tuple(r) for r in readers.primary_sources(spark, str(tmp_path / "base")).collect()] == [("jobs", "x", 2, "7,3 %")]


def test_ledger_stream_retracts(spark, tmp_path):
    schema = "claim_key string, statement_id string, seq long, verdict string, confidence double"
    rows = [("k", "s1", 1, "exact", 0.8), ("k", "s2", 2, "exact", 0.7), ("k", "s3", 3, "false", 0.9), ("m", "t1", 4, "exact", 0.5)]
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / "in" / str(i)))
    s = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = []
    q = ledger_stream(s).writeStream.outputMode("update").foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r[1]: (r[2], r[4]) for r in got}
    assert last == {"s1": ("unverified", "conflicted"), "s2": ("unverified", "conflicted"), "s3": ("unverified", "conflicted"), "t1": ("exact", "single")}


@pytest.mark.parametrize(("pad", "anchor"), [(0.0, 0.0), (3.0, 0.2), (20.0, 0.5)])
def test_corroborate_equals_brute_force(spark, pad, anchor):
    import random

    from claimlens.operators.joins import corroborate

    rng = random.Random(int(pad) + 1)
    words = ["dette", "emploi", "budget", "impot", "taux"]
    kinds, values = ["percentage", "magnitude"], [0.0, 0.5, -3.0, 2.7e6]
    req = [(k, rng.choice("AB"), s := float(rng.randrange(200)), s + rng.choice([0.0, 0.5, 4.0, 90.0]), [(rng.choice(kinds), rng.choice(values)) for _ in range(rng.randrange(3))], rng.sample(words, rng.randrange(5))) for k in range(60)]
    heard = [(f"w{(n := rng.randrange(3))}", n, "AAB"[n], float(rng.randrange(200)), rng.choice(kinds), rng.choice(values) * (1 + rng.choice([0, 1e-10, 1e-8])), rng.sample(words, 4), rng.randrange(4)) for _ in range(90)]

    def ratio(want, around, at):
        return 1.0 if len(want) < 3 else len(set(want) & set(around[max(0, at - 12) : at + 12])) / len(want)

    expected = {}
    for k, family, start, stop, figures, want in req:
        best = (2, 0, "no_quantity" if not figures else "absent", None)
        for w in range(3):
            near = [h for h in heard if h[1] == w and h[2] != family and start - pad <= h[3] <= stop + pad]
            if near:
                ok = all(any(h[4] == kind and abs(h[5] - v) <= 1e-9 * max(abs(v), 1) and ratio(want, h[6], h[7]) >= anchor for h in near) for kind, v in figures)
                status = "no_quantity" if not figures else "confirmed" if ok else "divergent"
                rank = {"confirmed": 0, "divergent": 1}.get(status, 2)
                if best[3] is None or (rank, w) < best[:2]:
                    best = (rank, w, status, f"w{w}")
        expected[k] = best[2:]
    r = spark.createDataFrame(req, "statement_id int, family string, start double, stop double, figures array<struct<kind:string,value:double>>, words array<string>")
    h = spark.createDataFrame(heard, "witness string, witness_seq int, w_family string, t double, kind string, value double, around array<string>, position int")
    assert {x["statement_id"]: (x["status"], x["witness"]) for x in corroborate(r, h, pad, anchor).collect()} == expected
    assert {s for s, _ in expected.values()} >= {"confirmed", "divergent", "no_quantity"}
