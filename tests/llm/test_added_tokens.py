"""Texts that hold the vocabulary's added tokens get the library's ids at default flags."""

import json
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from claimlens.llm import packing, token_counts
from claimlens.llm.tokenise import default_path, json_vocabulary_encoder

PATH = default_path("byte_bpe_50k.json")


def texts(tokens):
    rng = random.Random(9)
    parts = [*tokens, *"ab C'séñ 日🙂\n\t12.! ", " x ", "  ", "<|", "|>"]
    return ["x <|endoftext|> y", "<|endoftext|>", "<|endoftext|><|endoftext|>", "", "plain"] + ["".join(rng.choice(parts) for _ in range(30)) for _ in range(500)]


def test_default_flags():
    whole, enc = Tokenizer.from_file(PATH), json_vocabulary_encoder(PATH)
    for t in texts(["<|endoftext|>"] * 3):
        assert enc(t) == whole.encode(t, add_special_tokens=False).ids
    assert enc("x <|endoftext|> y") == [87, 220, 50256, 331]


@pytest.mark.parametrize("flags", [{"lstrip": True}, {"single_word": True}, {"rstrip": True, "special": False}])
def test_tokens_with_flags(tmp_path, flags):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"][0] |= flags
    spec["added_tokens"].append(spec["added_tokens"][0] | {"id": 50257, "content": "<|end"})
    path = tmp_path / "v.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    whole, enc = Tokenizer.from_file(str(path)), json_vocabulary_encoder(str(path))
    for t in texts(["<|endoftext|>", "<|end"]):
        assert enc(t) == whole.encode(t, add_special_tokens=False).ids


def test_operators_use_them(spark):
    df = spark.createDataFrame([(1, "x <|endoftext|> y"), (2, None)], "doc_id long, text string")
    assert {r["n_tokens"]: r["n_docs"] for r in token_counts.length_histogram(df).collect()} == {4: 1, 0: 1}
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.pack(df).collect()}
    assert got == {1: [87, 220, 50256, 331, 0], 2: [0]}
