"""Texts for judges, run counters gathered on the way, audit rows and the batch folder."""

import json
import random

from claimlens.operators import aggregates as A
from claimlens.plans import prompts as P
from claimlens.sources import readers, writers

SOURCE = "domain string, source_key string, producer string, rank int, measure string, vintage string, unit string, url string, text string"


def by_hand(keys, domain, known, budget):
    out = []
    for k in keys:
        s = known.get((domain, k))
        if s:
            producer, rank, measure, vintage, unit, url, text = s
            year = f"{vintage} {unit}" if unit else vintage
            out.append(f"--- PRIMARY SOURCE: {k} ---\nproducer : {producer} (rank {rank})\nmeasure  : {measure}\nvintage  : {year}\nurl      : {url}\n\n{(text or '')[: budget // max(len(keys), 1)]}\n")
    return "\n".join(out) or P.NO_SOURCE


def test_evidence(spark):
    rng = random.Random(3)
    known = {(d, k): ("INSEE", rng.randrange(1, 4), f"mesure {k}", "2021", rng.choice([None, "", "%"]), f"http://{k}", rng.choice([None, "", "é" * 5, "long texte " * 40])) for d in "ab" for k in "pqrs"}
    asked = {i: (rng.choice("abc"), [rng.choice("pqrsx") for _ in range(rng.randrange(1, 6))]) for i in range(60)}
    rows = [(i, n, d, k) for i, (d, keys) in asked.items() for n, k in enumerate(keys)] + [(99, 0, "a", None)]
    rng.shuffle(rows)
    r = spark.createDataFrame(rows, "statement_id int, pos int, domain string, source_key string")
    s = spark.createDataFrame([(*k, *v) for k, v in known.items()], SOURCE)
    got = {x["statement_id"]: (x["sources"], x["evidence"]) for x in P.evidence_texts(r, s, budget=300).collect()}
    want = {i: (sum((d, k) in known for k in keys), by_hand(keys, d, known, 300)) for i, (d, keys) in asked.items()} | {99: (0, P.NO_SOURCE)}
    assert got == want
    assert {x["evidence"] for x in P.evidence_texts(r, s.limit(0)).collect()} == {P.NO_SOURCE} and P.evidence_texts(r.limit(0), s).count() == 0


def test_orientations_and_traps(spark):
    d = spark.createDataFrame([("jobs", "Brief."), ("none", None)], "domain string, brief string")
    s = spark.createDataFrame([("jobs", "b", "rate", "INSEE", "2020"), ("jobs", "a", "count", "DARES", "2021"), ("gone", "c", "x", "y", "z")], "domain string, source_key string, measure string, producer string, vintage string")
    got = {r["domain"]: (r["line"], r["orientation"]) for r in P.orientations(d, s).collect()}
    head = "\n\nPrimary sources in this domain:\n"
    assert got == {"jobs": ("  - jobs (2 primary source(s))", f"Brief.{head}  - a -- count (DARES, 2021)\n  - b -- rate (INSEE, 2020)"), "none": ("  - none (0 primary source(s))", head)}
    t = spark.createDataFrame([(1, "unemployed", ["b", "a"], "two counts"), (2, "poor", ["x"], ""), (3, "none", [], None)], "k int, subject string, measures array<string>, note string")
    assert [r["text"] for r in P.trap_texts(t, "k").sort("k").collect()] == ["  unemployed:\n    - b\n    - a\n    -> two counts", "  poor:\n    - x", "  none:\n"]


RUN = "verdict string, triggers array<string>, sources array<struct<quote_verified:boolean>>, strong_verdict string"


def test_counters_on_the_way(spark, tmp_path):
    rows = [("false", ["number"], [(True,), (False,), (None,)], None), ("unverified", [], None, "false"), (None, None, [], None), ("out_of_scope", ["amount"], [(False,)], None)] * 25
    df = spark.createDataFrame(rows, RUN).repartition(7)
    seen, counters = A.observed_run(df)
    seen.write.parquet(str(tmp_path / "out"))
    want = dict(statements=100, verified=50, unverified=25, abstention=0.5, reds=25, triggered=50, unverified_quotes=75, escalated=25)
    assert counters.get == want == A.run_stats(df).first().asDict()
    assert A.run_stats(df.limit(0)).first().asDict() == dict.fromkeys(want, 0)
    assert "triggered" not in A.run_stats(df.select("verdict")).columns


def test_audit_rows(spark, tmp_path):
    rows = [("k", "s1", "exact", 0.12345), ("k", "s2", "false", 0.9), ("k", "s3", "unverified", None), ("alone", "s4", "exact", 1.0), (None, "s5", "exact", 1.0), (None, "s6", "exact", 1.0)]
    o = spark.createDataFrame(rows, "claim_key string, statement_id string, verdict string, confidence double")
    got = sorted(tuple(r) for r in A.audit_occurrences(o, "claim_key").collect())
    assert got == [("k", "conflicted", "s1", "exact", 0.123), ("k", "conflicted", "s2", "false", 0.9), ("k", "conflicted", "s3", "unverified", None)]
    writers.ledger_audit(o, "claim_key", str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 3


def test_status_counts(spark):
    df = spark.createDataFrame([("confirmed",)] * 3 + [("absent",)], "status string")
    assert sorted(tuple(r) for r in A.status_counts(df).collect()) == [("absent", 1, 0.25), ("confirmed", 3, 0.75)]


def test_batch_folder(spark, tmp_path):
    df = spark.createDataFrame([(str(i), f"é {i}", None if i % 5 == 0 else "" if i % 5 == 1 else "b") for i in range(100)], "statement_id string, text string, brief string").repartition(6)
    path = str(tmp_path / "out")
    for _ in range(2):
        writers.batch_jsonl(df, path, {"format": "1", "note": "é"})
    files = sorted(p.name for p in (tmp_path / "out").iterdir() if p.name[0] not in "._")
    assert files[0] == "header.jsonl" and len(files) > 2
    assert json.loads((tmp_path / "out" / "header.jsonl").read_text("utf-8")) == {"_meta": {"format": "1", "note": "é"}}
    assert {r["statement_id"] for r in readers.jsonl(spark, path, "statement_id string, text string").collect()} == {str(i) for i in range(100) if i % 5 > 1}
