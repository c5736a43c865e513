"""Byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1 characters so that one Aho-Corasick automaton
reports every vocabulary token in a piece of text. Encoding takes the longest
token at each place and backtracks when a token cannot stand after its left
neighbour. Two tokens are compatible if merging their bytes by rank would leave the
boundary between them standing; that answer depends on the pair alone, so it is
memoised. A piece visits each position at most once per token of its chain, so the time is
linear in the piece and the ids are exactly those of rank-ordered merging.

Cases: null text counts as empty and gives no ids; one piece may be as long as
the text; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.tokenise import default_path, pattern, read_ranks

#: Words remembered by a worker; the memory is emptied when full, so only speed depends on it.
MEMORY = 700_000
#: A space with white space on both sides: only there can a match of the pattern reach over a space's left edge.
_RUN = re.compile(r"\s \s").search


class Codec:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        self.automaton = ahocorasick.Automaton()
        for t, r in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t), r))
        self.automaton.make_automaton()
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.halves, self.joined = self._merges()
        self.sizes = [len(t) for t in self.tokens]
        self.shorter = [next((ranks[t[:i]] for i in range(len(t) - 1, 0, -1) if t[:i] in ranks), -1) for t in self.tokens]
        self.good: dict[tuple[int, int], bool] = {}
        self.memory: dict[str, list[int]] = {}
        self.split = regex.compile(pattern()).findall

    def _merges(self) -> tuple[list[tuple[int, int]], dict[tuple[int, int], int]]:
        """For each token the pair its last merge joined; single bytes and unreachable tokens are their own halves."""
        ranks, halves, joined = self.ranks, [(i, i) for i in range(len(self.tokens))], {}
        for t, r in sorted(ranks.items(), key=lambda x: x[1]):
            if len(t) < 2:
                continue
            cuts = [(a, b) for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and a < r and (b := ranks.get(t[i:])) is not None and b < r]
            if len(cuts) > 1:
                left = self._merge(t, r)
                cuts = [tuple(left)] if len(left) == 2 else []
            if cuts:
                halves[r] = joined_by = cuts[0]
                joined[joined_by] = r
        return halves, joined

    def _merge(self, t: bytes, below: int) -> list[int]:
        """Rank-ordered merging with the ranks under a limit; only for the short tokens themselves."""
        parts = [t[i : i + 1] for i in range(len(t))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Whether b can follow a. Undoes merges from the later rank down; a merge across the boundary that would
        have come before the ones undone so far rules the pair out."""
        known = self.good.get((a, b))
        if known is not None:
            return known
        x, y, limit, halves, joined = a, b, len(self.tokens), self.halves, self.joined
        while True:
            across = joined.get((x, y))
            if across is not None and across < limit:
                out = False
                break
            take_left = x > y
            for _ in range(2):
                if take_left:
                    limit = x
                    x = halves[x][1]
                    if x != limit:
                        break
                else:
                    limit = y + 1
                    y = halves[y][0]
                    if y + 1 != limit:
                        break
                take_left = not take_left
            else:
                out = True
                break
        if len(self.good) > 4_000_000:
            self.good.clear()
        self.good[a, b] = out
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        chars, good, compatible = piece.decode("latin-1"), self.good, self.compatible
        greedy = [r for _, (_, r) in self.automaton.iter_long(chars)]
        last = -1
        for token in greedy:  # longest matches that all suit their neighbours are the answer
            if last >= 0:
                ok = good.get((last, token))
                if not (ok if ok is not None else compatible(last, token)):
                    break
            last = token
        else:
            return greedy
        n, sizes, shorter = len(piece), self.sizes, self.shorter
        longest = [-1] * n
        best = [0] * n
        for end, (size, token) in self.automaton.iter(chars):
            start = end + 1 - size
            if size > best[start]:
                best[start] = size
                longest[start] = token
        dead = bytearray(n + 1)  # positions from which no valid chain reaches the end
        out: list[int] = []
        pos, token, last = 0, longest[0], -1
        while pos < n:
            while token >= 0:
                if not dead[pos + sizes[token]]:
                    if last < 0:
                        break
                    ok = good.get((last, token))
                    if ok if ok is not None else compatible(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                last = token
                pos += sizes[token]
                token = longest[pos] if pos < n else -1
            else:  # nothing fits here: the token before must be shorter
                dead[pos] = 1
                if not out:
                    raise ValueError("the vocabulary lacks single bytes")
                last = out.pop()
                pos -= sizes[last]
                token = shorter[last]
                last = out[-1] if out else -1
        return out

    def _pieces(self, text: str) -> list[int]:
        out: list[int] = []
        for p in self.split(text):
            out += self.encode_piece(p.encode())
        return out

    def encode(self, text: str) -> list[int]:
        if _RUN(text):
            return self._pieces(text)
        memory = self.memory
        first, *words = text.split(" ")
        out = self._pieces(first)
        for w in words:
            ids = memory.get(w)
            if ids is None:
                ids = self._pieces(" " + w)
                if len(memory) >= MEMORY:
                    memory.clear()
                if len(w) <= 64:
                    memory[w] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decimals(self, ids: list[int]) -> str:
        return ",".join(map(self.decimal.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(read_ranks(path))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids array<int>) of every whole text."""
    path = vocabulary or default_path("byte_bpe_multi_50k.tiktoken")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            ids = [c.encode(t.as_py() or "") for t in b.column(1)]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [key, "ids"])

    return docs.select(F.col(key), F.col(text).cast("string").alias("__cl_text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(key, bytes binary) of every list of ids; null ids give empty bytes."""
    path = vocabulary or default_path("byte_bpe_multi_50k.tiktoken")
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x.as_py() or []) for x in b.column(1)], pa.binary())], [key, "bytes"])

    return encoded.select(F.col(key), F.col(ids).alias("__cl_ids")).mapInArrow(run, f"`{key}` {kind}, bytes binary")


def round_trip_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, so ids never leave the worker."""
    path = vocabulary or default_path("byte_bpe_multi_50k.tiktoken")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            n, a, d = [], [], []
            for t in b.column(1):
                ids = c.encode(t.as_py() or "")
                n.append(len(ids))
                a.append(hashlib.sha256(c.decimals(ids).encode()).hexdigest())
                d.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(key), F.col(text).cast("string").alias("__cl_text")).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
