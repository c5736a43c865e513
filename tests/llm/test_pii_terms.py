"""Terms that disclose rare entities."""

from claimlens.llm import pii


def documents(rows):
    clean = [(1000 + i, f"plain words about matter{i % 7} and nothing else in this text") for i in range(2000)]
    return rows + clean


def told(spark, rows):
    got = pii.personal_data(spark.createDataFrame(documents(rows), "doc_id long, text string")).collect()
    assert len(got) == len(documents(rows))
    assert all(not r["spans"] for r in got if r["doc_id"] >= 1000)
    text = dict(rows)
    return {r["doc_id"]: {text[r["doc_id"]][s["start"] : s["stop"]] for s in r["spans"] if s["kind"] not in pii.KINDS} for r in got if r["doc_id"] < 1000}


def test_terms_beside_an_entity_seen_once_or_twice(spark):
    rows = [(1, "plain words zanthor once@corp.example about nothing"), (2, "text about quibble twice@corp.example and words"), (3, "words of quibble twice@corp.example in this text")]
    got = told(spark, rows)
    assert "zanthor" in got[1] and "quibble" in got[2] and "quibble" in got[3]
    assert not {"words", "about", "text", "plain"} & (got[1] | got[2] | got[3])


def test_terms_far_from_the_entity_and_with_digits(spark):
    far = "about words in plain text and nothing else " * 40
    rows = [(1, f"Zanthor account K77x4 {far} zanthor {far} mail far@corp.example"), (2, f"of matter1 {far} Li {far} 10.20.30.40 ünïque_9 ends"), (3, "Li in this text without more")]
    got = told(spark, rows)
    assert {"Zanthor", "zanthor", "K77x4"} <= got[1] and {"ünïque", "9"} <= got[2] and not got[3]
    assert not {"words", "about", "text", "plain", "matter1"} & (got[1] | got[2])
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(documents(rows), "doc_id long, text string")).collect()}
    assert "anthor" not in clean[1] and "K77x4" not in clean[1] and "<EMAIL>" in clean[1] and "about words in plain text" in clean[1]
    assert clean[3] == rows[2][1]


def test_terms_outside_spans():
    text = "ab12 c@d.ef é9 x"
    assert list(pii.outside(text, [(5, 11)])) == [("ab12", 0, 4), ("é9", 12, 14), ("x", 15, 16)]
    assert list(pii.outside(text, [(6, 7), (0, 2)])) == [("c", 5, 6), ("d", 7, 8), ("ef", 9, 11), ("é9", 12, 14), ("x", 15, 16)]
