"""Attribution, citations, explained thresholds, findings and readers on literal and random cases."""

import json
import random

from claimlens.operators import guardrails as G
from claimlens.operators import reports as R
from claimlens.plans.citations import checked_citations
from claimlens.plans.speech import NO_TURN, UNKNOWN, attributed_blocks
from claimlens.sources import readers, writers

CAPTION = "conv string, seq int, l_start double, l_stop double, text string"
TURN = "conv string, turn_seq int, r_start double, r_stop double, accepted boolean, speaker string, role string, similarity double, reason string"


def blocks_by_hand(captions, turns):
    """Every caption against every turn, then joined one by one."""
    out = []
    for _, _, a, b, text in captions:
        best, most = None, 0.0
        for t in turns:
            share = max(0.0, min(b, t[3]) - max(a, t[2])) / max(b - a, 1e-6)
            if share > most:
                best, most = t, share
        best = best if most >= 0.5 else None
        text = text or ""
        if best is None or not best[4]:
            who, role, like, note = UNKNOWN, "", best[7] if best else 0.0, best[8] if best else NO_TURN
        else:
            who, role, like, note = best[5], best[6], best[7], ""
        if out and out[-1][2:4] == [who, role]:
            last = out[-1]
            last[1], last[4], last[5] = b, f"{last[4]} {text}".strip(), max(last[5], like)
        else:
            out.append([a, b, who, role, text.strip(), like, who != UNKNOWN and role == "candidate", note])
    return out


def test_attributed_blocks(spark):
    rng = random.Random(8)
    captions, turns = [], []
    for conv in ("a", "b", "c"):
        t = 0.0
        for i in range(60):
            length = rng.choice([0.0, 0.5, 1.0, 2.25])
            captions.append((conv, i, t, t + length, rng.choice(["oui", " non ", "", None, "peut-être "])))
            t += length + rng.choice([0.0, 0.25])
        at, i = 0.5, 0
        while at < t:
            length = rng.choice([1.0, 3.5, 6.25])
            turns.append((conv, i, at, at + length, rng.random() < 0.7, rng.choice("AB"), rng.choice(["candidate", "moderator"]), rng.randint(0, 8) / 8, rng.choice(["overlap", "disagreement"])))
            at, i = at + length + rng.choice([0.0, 0.5]), i + 1
    got = attributed_blocks(spark.createDataFrame(captions, CAPTION).repartition(3), spark.createDataFrame(turns, TURN).repartition(2), "conv").orderBy("conv", "block").collect()
    for conv in ("a", "b", "c"):
        mine = [[r["start"], r["stop"], r["speaker"], r["role"], r["text"], r["similarity"], r["analysed"], r["note"]] for r in got if r["conv"] == conv]
        assert mine == blocks_by_hand([c for c in captions if c[0] == conv], [t for t in turns if t[0] == conv])
    assert attributed_blocks(spark.createDataFrame([], CAPTION), spark.createDataFrame([], TURN), "conv").count() == 0


def test_checked_citations(spark):
    stored = [(1, "eco", "Le déficit  atteint 5,5 % du PIB.", "u1", "insee", 1, "2024"), (2, "eco", "Table ..... des matières du rapport", "u2", "cour", 2, "2023"), (3, "eco", None, "u3", "x", 3, None)]
    cited = [
        (10, 0, "eco", "LE DEFICIT atteint 5,5 %", None), (10, 1, "eco", "une phrase inventée de toutes pièces", "2020"), (10, 2, "eco", "table des matieres", "2019"),
        (11, 0, "eco", "5,5 %", None), (12, 0, "eco", None, None), (13, 0, "eco", "LE DEFICIT atteint 5,5 %", None),
    ]
    c = spark.createDataFrame(cited, "statement_id int, pos int, domain string, quote string, data_date string")
    s = spark.createDataFrame(stored, "source_id int, domain string, text string, url string, producer string, rank int, vintage string")
    got = {r["statement_id"]: ([(x["url"], x["domain"], x["rank"], x["data_date"]) for x in r["sources"]], r["rejected"]) for r in checked_citations(c, s).collect()}
    assert got == {10: ([("u1", "insee", 1, "2024"), ("u2", "cour", 2, "2019")], 1), 11: ([], 1), 12: ([], 1), 13: ([("u1", "insee", 1, "2024")], 0)}
    # the guard on quotes takes them as they are
    st = checked_citations(c, s).selectExpr("*", "'exact' verdict", "0.9D confidence")
    kept = {r["statement_id"]: (r["verdict"], r["confidence"], r["rank"]) for r in G.quotes_kept(st).collect()}
    assert kept == {10: ("exact", 0.9, 1), 11: ("unverified", 0.3, None), 12: ("unverified", 0.3, None), 13: ("exact", 0.9, 1)}


def test_explained_thresholds(spark):
    rows = [
        (1, "false", 0.01, "relative", ["approximate_magnitude"], "a"), (2, "exact", 0.4, "relative", None, None), (3, "exact", 9.5, "points", [], ""),
        (4, "unverified", 0.0, "points", ["x"], None), (5, "false", None, None, [], "b"), (6, "approximate", 0.4, "relative", [], None),
    ]
    df = spark.createDataFrame([(*r, 0.9, 1) for r in rows], "id int, verdict string, gap double, unit string, tags array<string>, note string, confidence double, rank int")
    got = {r["id"]: (r["verdict"], r["confidence"], r["tags"], r["note"]) for r in G.explained_thresholds(df).collect()}
    assert got == {
        1: ("exact", 0.9, ["approximate_magnitude"], "a"),
        2: ("unverified", 0.3, [], "(Withdrawn: called exact with a gap of 40%.)"),
        3: ("unverified", 0.3, [], "(Withdrawn: called exact with a gap of 9,50 points.) (Gap in points: 9,50 points.)"),
        4: ("unverified", 0.9, ["x"], ""),
        5: ("false", 0.9, [], "b"),
        6: ("approximate", 0.9, [], ""),
    }


def test_findings_and_review_queue(spark, tmp_path):
    rows = [("Élu D'Or!", 2, "k1", 5, "exact", 0.8, True), ("B", 1, "k1", 3, "false", 0.9, True), ("B", 3, "k2", 9, "exact", 0.5, True), ("Élu D'Or!", 4, "k3", 9, "exact", 0.8, True), ("B", 5, "k4", 1, "exact", 0.8, False)]
    df = spark.createDataFrame(rows, "speaker string, statement_id int, claim string, at int, verdict string, confidence double, ok boolean").selectExpr("*", "array(struct(ok as quote_verified)) sources", "false withdrawn")
    f = R.findings(df, "claim", "at")
    assert {(r["speaker"], r["slug"], r["claim"], r["statement_id"], r["verdict"], r["occurrences"]) for r in f.collect()} == {("B", "b", "k1", 1, "false", 2), ("Élu D'Or!", "élu-d-or", "k3", 4, "exact", 1)}
    writers.review_queue(f, str(tmp_path / "q"))
    assert {r["slug"] for r in spark.read.json(str(tmp_path / "q")).select("slug").collect()} == {"b", "élu-d-or"}


def test_verdicts_take_the_last_line(spark, tmp_path):
    line = lambda k, v: json.dumps({"statement_id": k, "v": v}) + "\n"
    (tmp_path / "a.jsonl").write_text('{"_meta": "x"}\n' + "".join(line("s", i) for i in range(3000)) + line("t", 1))
    (tmp_path / "b.jsonl").write_text(line("t", 7) + "\n" + line("t", 5))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        got = {r["statement_id"]: r["v"] for r in readers.verdicts(spark, str(tmp_path), "statement_id string, v int").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {"s": 2999, "t": 5}
    assert readers.jsonl(spark, str(tmp_path), "statement_id string, v int").count() == 3003


def test_prints_are_of_length_one(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"speaker_id": "a", "centroid": [3.0, 4.0]}, {"speaker_id": "z", "centroid": [0.0, 0.0]}]))
    got = {r["speaker_id"]: [round(x, 5) for x in r["centroid"]] for r in readers.voice_prints(spark, str(tmp_path / "p.json")).collect()}
    assert got == {"a": [0.6, 0.8], "z": [0.0, 0.0]}


def test_subtitles_to_segments(spark, tmp_path):
    (tmp_path / "x.vtt").write_text("WEBVTT\n\n00:00:01.000 --> 00:00:02.000\nbonjour <c>à</c> tous\n\n00:00:02.000 --> 00:00:03.500\nà tous et merci\n\n00:00:03.500 --> 00:00:04.000\net merci\n")
    got = [(r["start"], r["stop"], r["text"]) for r in readers.subtitle_segments(spark, str(tmp_path / "x.vtt")).orderBy("start").collect()]
    assert got == [(1.0, 2.0, "bonjour à tous"), (2.0, 4.0, "et merci")]
