"""URL filter over a sorted digest array.

A rule is a host and a path prefix, stored as their concatenation. The rules'
64-bit xxhash keys are sorted into one file, shipped to the executors
and memory-mapped there; a batch of urls is probed by vectorised binary search and
every hit is confirmed against the stored full string, so colliding digests
never decide.

A url's candidate keys are its host suffixes at dots, joined with the path
prefixes of the lengths that occur among the rules. The longest confirmed rule
wins; without one the verdict is the filter's default.

Cases: null urls and urls without ``://`` have empty host and path and get
the default; keys of any type pass unchanged, null ones too; a repeated url is judged each time; of rules given twice with both
verdicts blocking wins; of a very long host only suffixes up to the longest rule's length are probed, so a url costs its own length and a bounded number of probes; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import string
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rules of the contract: verdict, host, path prefix.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
_HEADER = np.dtype([("keys", "<u8"), ("lengths", "<u8"), ("blob", "<u8")])


def host_of(url: Column) -> Column:
    """After the first ``://`` up to / ? # or the end, A-Z lower-cased; else empty."""
    h = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(h, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def write_digest_array(rules: Iterable[tuple[str, str, str]], path: str) -> None:
    """Header, sorted u64 keys, u64 string ends, u8 verdicts, path lengths, then the strings."""
    rows = sorted({(xxhash.xxh64_intdigest((h.lower() + p).encode()), (h.lower() + p).encode(), v == "block", len(p)) for v, h, p in rules})
    keys = np.array([r[0] for r in rows], "<u8")
    ends = np.cumsum([0, *(len(r[1]) for r in rows)]).astype("<u8")
    lengths = np.array(sorted({r[3] for r in rows}), "<u8")
    blob = b"".join(r[1] for r in rows)
    with open(path, "wb") as f:
        f.write(np.array([(len(keys), len(lengths), len(blob))], _HEADER).tobytes())
        for a in (keys, ends, lengths):
            f.write(a.tobytes())
        f.write(np.array([r[2] for r in rows], "u1").tobytes())
        f.write(blob)


class DigestArray:
    """Read side: everything stays in the mapped file."""

    def __init__(self, path: str):
        raw = np.memmap(path, dtype="u1", mode="r")
        head = raw[: _HEADER.itemsize].view(_HEADER)[0]
        n, m = int(head["keys"]), int(head["lengths"])
        at = _HEADER.itemsize
        self.keys = raw[at : at + 8 * n].view("<u8")
        self.ends = raw[at + 8 * n : at + 16 * n + 8].view("<u8")
        self.path_lengths = raw[at + 16 * n + 8 : at + 16 * n + 8 + 8 * m].view("<u8").tolist()
        at += 16 * n + 8 + 8 * m
        self.block = raw[at : at + n]
        self.blob = raw[at + n :]
        self.longest = int(np.diff(self.ends.astype(np.int64)).max(initial=0))

    def string(self, i: int) -> bytes:
        return self.blob[int(self.ends[i]) : int(self.ends[i + 1])].tobytes()

    def probe(self, candidates: list[bytes]) -> np.ndarray:
        """Index of each candidate's own entry, or -1."""
        if not candidates or not len(self.keys):
            return np.full(len(candidates), -1)
        k = np.fromiter(map(xxhash.xxh64_intdigest, candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.keys, k)
        found = np.full(len(candidates), -1)
        hits = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == k)
        for j in hits:
            i = int(at[j])
            while i < len(self.keys) and self.keys[i] == k[j]:  # equal digests stand together
                if self.string(i) == candidates[j]:
                    found[j] = i
                    break
                i += 1
        return found


def candidates_of(host: str, path: str, lengths: list[int], longest: int) -> list[bytes]:
    """Longest first, so that the first confirmed one wins. Suffixes longer than any rule are not made."""
    out, at = set(), len(host)
    while at > 0:
        at = host.rfind(".", 0, at)
        if len(host) - at - 1 > longest:
            break
        if h := host[at + 1 :]:
            out.update((h + path[:n]).encode() for n in lengths if n <= len(path))
    return sorted(out, key=lambda c: (-len(c), c))


def filter_urls(urls: DataFrame, rules: Iterable[tuple[str, str, str]], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) for every row."""
    spark = urls.sparkSession
    rules = list(rules)
    name = "urls-" + hashlib.sha256(repr(sorted(rules)).encode()).hexdigest()[:16] + ".digests"
    _ship(spark, rules, name)
    parts = urls.select(F.col(key).alias(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.get(name))
        for b in batches:
            lists = [candidates_of(h, p, array.path_lengths, array.longest) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            flat = [c for cs in lists for c in cs]
            found = array.probe(flat)
            rule, verdict, at = [], [], 0
            for cs in lists:
                hit = next((int(i) for i in found[at : at + len(cs)] if i >= 0), None)
                at += len(cs)
                rule.append(None if hit is None else array.string(hit).decode())
                verdict.append(default if hit is None else "block" if array.block[hit] else "allow")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [key, "host", "path", "rule", "verdict"])

    kind = parts.schema[key].dataType.simpleString()
    return parts.mapInArrow(judge, f"`{key}` {kind}, host string, path string, rule string, verdict string")


def _ship(spark: SparkSession, rules: list, name: str) -> None:
    """The driver serves the file; each executor fetches its own copy, again after a loss."""
    if any(str(f).endswith("/" + name) for f in spark.sparkContext.listFiles):
        return
    path = os.path.join(tempfile.mkdtemp(), name)
    write_digest_array(rules, path)
    spark.sparkContext.addFile(path)
