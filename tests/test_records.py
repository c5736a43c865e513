"""Manifests, kept tables, small sinks, provenance and audit lines on literal cases."""

import json
import random

import pytest
import yaml
from pyspark.sql import functions as F

from claimlens.operators import joins as J
from claimlens.operators import reports as R
from claimlens.sources import manifests as M
from claimlens.sources import writers as W


def put(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder / name)


def test_ranks(spark, tmp_path):
    path = put(tmp_path, "r.yaml", "rang1: {domaines: [b.fr, a.fr]}\nrang2: {domaines: [a.fr, c.fr]}\nrang3: {domaines: [z.fr]}\nrang_parole: {domaines: [p.fr]}\n")
    r = M.rank_corpus(spark, path)
    assert {tuple(x) for x in r.select("rank", "domain").collect()} == {(1, "b.fr"), (1, "a.fr"), (2, "a.fr"), (2, "c.fr"), (3, "z.fr"), (None, "p.fr")}
    assert [x[0] for x in M.fact_check_domains(r).collect()] == ["a.fr", "b.fr", "c.fr"]
    assert M.rank_corpus(spark, put(tmp_path, "e.yaml", "")).count() == 0


def test_glossary(spark, tmp_path):
    doc = {"termes": {"dette": {"libelle": "Dette", "mesures": [{"cle": "m1", "definition": " d \n"}, {"cle": "m2"}]}, "vide": {}}}
    g = M.glossary(spark, put(tmp_path, "g.yaml", yaml.safe_dump(doc)))
    assert sorted((r["term"], r["label"], r["measure"], r["definition"]) for r in g.collect() if r["measure"]) == [("dette", "Dette", "m1", "d"), ("dette", "Dette", "m2", None)]
    assert [(r["label"], r["measure"]) for r in g.filter("term = 'vide'").collect()] == [("vide", None)]
    forms = spark.createDataFrame([("dette", "endettement"), ("dette", "dettes")], "term string, form string")
    assert {tuple(r) for r in M.trigger_forms(g, forms).collect()} == {("dette", "endettement"), ("dette", "dettes"), ("vide", "vide")}


def test_panel(spark, tmp_path):
    path = put(tmp_path, "p.yaml", "analyse_debut_s: 286\nintervenants:\n- {id: a, nom: Ann, role: candidate, analyse: true}\n- {id: b, nom: Bob, role: moderator}\n")
    people, start = M.panel(spark, path)
    assert start == 286 and people.count() == 2 and [r[0] for r in M.analysed_speakers(people).collect()] == ["Ann"]
    people, start = M.panel(spark, str(tmp_path / "none.yaml"))
    assert start == 0 and people.count() == 0


def test_gold_set(spark, tmp_path):
    path = put(tmp_path, "g.yaml", "items:\n- {id: 1, verdict: exact, extra: 3}\n- {id: 2}\n")
    assert [tuple(r) for r in M.gold_set(spark, path, "id int, verdict string").orderBy("id").collect()] == [(1, "exact"), (2, None)]


def test_dossier_leads(spark, tmp_path):
    claim = lambda t, n: {"enonce_type": t, "n": n}
    put(tmp_path, "ann.yaml", yaml.safe_dump({"erreurs_recurrentes": [claim("Le chômage.", 1)], "chiffres_recurrents": [claim("le  chomage", 2), claim("Autre", 3), claim("", 4)]}))
    put(tmp_path, "bad.yaml", "a: [")
    put(tmp_path, "empty.yaml", "")
    got = {(r["slug"], r["kind"], json.loads(r["entry"])["n"]) for r in M.dossier_leads(spark, str(tmp_path)).collect()}
    assert got == {("ann", "recurring_error", 1), ("ann", "recurring_figure", 3)}


@pytest.mark.parametrize("wrapped", [False, True])
def test_listening_state(spark, tmp_path, wrapped):
    state = {"3:0": {"segments": [{"a": 0, "b": 2.5, "who": "x"}]}, "3:1": {"inutilisable": "bruit"}, "4:0": {}}
    path = put(tmp_path, "s.json", json.dumps({"etat": state, "misAJour": "today"} if wrapped else state))
    got = {(r["cluster"], r["clip"]): (r["unusable"], r["segments"] and r["segments"][0]["who"]) for r in M.listening_state(spark, path).collect()}
    assert got == {(3, 0): (None, "x"), (3, 1): ("bruit", None), (4, 0): (None, None)}


def test_kept_is_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    path = str(tmp_path / "kept")
    assert M.kept(spark, path, make).count() == 3 and M.kept(spark, path, make).count() == 3 and len(made) == 1


def test_confirmation_file_is_replaced(spark, tmp_path):
    path = tmp_path / "c.yaml"
    for n in (1, 2):
        rows = spark.createDataFrame([(n, "Élise", ["a"])], "grappe int, nom_suggere string, ecouter array<string>")
        W.confirmation_yaml(rows, str(path), "# by hand\n")
        assert path.read_text("utf-8").startswith("# by hand\n") and yaml.safe_load(path.read_text("utf-8")) == {"grappes": [{"grappe": n, "nom_suggere": "Élise", "ecouter": ["a"]}]}
    assert [p.name for p in tmp_path.iterdir() if p.suffix == ".yaml"] == ["c.yaml"]
    W.report_json(spark.range(2), str(tmp_path / "report"))
    assert len(list((tmp_path / "report").glob("*.json"))) == 1


def test_provenance(spark):
    s = spark.createDataFrame([(1, "a", "il y a trois millions de gens ici"), (2, "b", "il y a trois millions de gens")], "source_id int, domain string, flat string")
    b = spark.createDataFrame([(9, "a", "une note de synthese bien longue")], "source_id int, domain string, flat string")
    q = [(1, None, "trois millions de gens"), (2, "b", "trois millions de gens"), (3, "gone", "trois millions de gens"), (4, "a", "note de synthese bien"), (5, "b", "note de synthese bien"), (6, None, "gens"), (7, None, "millionsdegens"), (8, None, "synthese bien longue")]
    got = {r["item_id"]: (r["found"], r["source_id"], r["reason"]) for r in J.provenance(spark.createDataFrame(q, "item_id int, domain string, flat string"), s, b).collect()}
    yes = lambda i: (True, i, "primary source")
    no = lambda why: (False, None, why)
    assert got == {1: yes(1), 2: yes(2), 3: yes(1), 4: no("brief only"), 5: no("not found"), 6: no("too short"), 7: no("not found"), 8: no("brief only")}


def test_held_by_against_brute_force(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["la", "le", "pa", "pale", "lala"]) for _ in range(n))
    sources, quotes = [(i, text(rng.randint(0, 60))) for i in range(80)], [(i, text(rng.randint(1, 6))) for i in range(60)]
    quotes += [(100 + i, t[3:21]) for i, t in sources if len(t) > 30]
    got = J.held_by(spark.createDataFrame(quotes, "item_id int, flat string"), spark.createDataFrame(sources, "source_id int, flat string")).collect()
    assert sorted(map(tuple, got)) == sorted((q, s) for q, f in quotes for s, t in sources if f in t)


@pytest.mark.parametrize("letters", [0, 1 << 20])
def test_keyword_terms(spark, monkeypatch, letters):
    monkeypatch.setattr(J, "GLOSSARY", letters)
    rows = [(1, "la dette, l'endettement"), (2, "sans"), (3, None), (4, "les dettes publiques"), (5, "d"), (6, "")]
    forms = spark.createDataFrame([("debt", "dette"), ("public", "dettes publiques"), ("a", "d")], "term string, form string")
    got = {tuple(r) for r in J.keyword_terms(spark.createDataFrame(rows, "k int, flat string"), forms, "k", "flat").collect()}
    assert got == {(1, "debt"), (1, "a"), (4, "debt"), (4, "public"), (4, "a"), (5, "a")}
    assert J.keyword_terms(spark.createDataFrame(rows, "k int, flat string"), forms.limit(0), "k", "flat").count() == 0


def test_lines(spark):
    none = F.array().cast("array<string>")
    line = R.routing_line(F.array(F.lit("a"), F.lit("b")), none, none, F.lit(True))
    note = R.corroboration_note(F.lit("divergent"), F.lit("w"), F.array(F.lit("3")), none, F.array(*map(F.lit, "1234")))
    assert tuple(spark.range(1).select(line, note).first()) == ("terms=[a, b] domains=- sources=- TRAP", "transcriptions differ: 3 here, 1, 2, 3 in w")
    u = spark.createDataFrame([("https://youtu.be/abcdefghijk?t=3",), ("https://x.org/watch",), (None,)], "u string")
    assert [r[0] for r in u.select(M.video_id(F.col("u"))).collect()] == ["abcdefghijk", None, None]
