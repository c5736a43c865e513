"""Cached access to the public tokenizer vocabularies (a path parameter, never a copy)."""

from __future__ import annotations

import base64
from functools import lru_cache


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def json_vocabulary_encoder(path: str):
    """Encoder of a byte-level BPE .json vocabulary, as ``text -> list of ids``.

    The ids are those of the ``tokenizers`` library with add_special_tokens=False: the vocabulary's added tokens
    standing in a text get their own ids. They are computed with the rank-merging
    library, which is eight times faster on one core here and
    gives the same ids (tests hold one against the other): the ranks are the
    vocabulary's ids, the split is its pre-tokenizer's.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    extra = spec.get("added_tokens", [])
    special = {t["content"]: t["id"] for t in extra}
    char_to_byte = _byte_alphabet()
    ranks = {bytes(char_to_byte[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in special}
    encoding = tiktoken.Encoding("json_vocabulary", pat_str=pattern(), mergeable_ranks=ranks, special_tokens=special)
    plain = encoding.encode_ordinary
    if not special:
        return plain
    names = list(special)
    if any(t[k] for t in extra for k in ("single_word", "lstrip", "rstrip")) or any(a != b and a in b for a in names for b in names):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)  # tokens that take in their surroundings, or hold one another, are left to the library
        marked = lambda t: whole.encode(t, add_special_tokens=False).ids
    else:
        marked = lambda t: encoding.encode(t, allowed_special="all")
    return lambda t: marked(t) if any(n in t for n in names) else plain(t)


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use: visible Latin-1 stays, the rest moves above 255."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in visible}
    out |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(visible))}
    return out
