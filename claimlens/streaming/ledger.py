"""Streams: the claim ledger with retractions, and windowed counts with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

REVISIONS = "claim_key string, statement_id string, verdict string, confidence double, status string"
_SETTLED = ("exact", "approximate", "false")


class Ledger(StatefulProcessor):
    """Per claim: counters, and its occurrences until they conflict. A conflict revises every earlier occurrence, once; then they are forgotten.

    The state of a claim that never conflicts grows with its occurrences, as a later conflict must revise them all; ``ttl_ms`` bounds it.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = {"ttlDurationMs": self.ttl_ms} if self.ttl_ms else {}
        self.seen = handle.getListState("seen", "statement_id string, verdict string, confidence double", **ttl)
        self.sums = handle.getValueState("sums", "settled long, verdict string, best double, conflicted boolean", **ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        settled, known, best, conflicted = self.sums.get() if self.sums.exists() else (0, None, 0.0, False)
        out, fresh = [], []
        for f in rows:
            for s, v, c in f.sort_values("seq")[["statement_id", "verdict", "confidence"]].itertuples(index=False):
                c = float(c)
                best = max(best, c)
                opens = v in _SETTLED and known is not None and v != known and not conflicted
                if v in _SETTLED:
                    settled, known = settled + 1, known or v
                if opens:
                    conflicted = True
                    out += [(key[0], a, "unverified", min(b, 0.3), "conflicted") for a, k, b in [*map(tuple, self.seen.get()), *fresh, (s, v, c)] if k != "unverified"]
                    self.seen.clear()
                    fresh = []
                elif conflicted:
                    out.append((key[0], s, "unverified", min(c, 0.3), "conflicted"))
                else:
                    fresh.append((s, v, c))
                    status = "single" if settled < 2 else "corroborated"
                    out.append((key[0], s, v, min(best + min(0.05 * max(settled - 1, 0), 0.10), 0.98) if status == "corroborated" else c, status))
        if fresh:
            self.seen.appendList(fresh)
        self.sums.update((settled, known, best, conflicted))
        yield pd.DataFrame(out, columns=["claim_key", "statement_id", "verdict", "confidence", "status"])

    def close(self) -> None:
        pass


def ledger_stream(occurrences: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """occurrences: claim_key, statement_id, seq, verdict, confidence. Update mode; needs the RocksDB state store. ttl_ms: how long a claim is remembered."""
    return occurrences.groupBy("claim_key").transformWithStateInPandas(Ledger(ttl_ms), REVISIONS, "Update", "ProcessingTime" if ttl_ms else "None")


class TimedLedger(StatefulProcessor):
    """The ledger with event time: a claim not met again within ``keep_ms`` of its last occurrence is forgotten, and one met later is a new claim.

    Which occurrences belong together follows from their times alone, not from when a batch ran; timers of the watermark only free the state.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "statement_id string, verdict string, confidence double")
        self.sums = handle.getValueState("sums", "settled long, verdict string, best double, conflicted boolean, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.sums.get() if self.sums.exists() else (0, None, 0.0, False, None)
        settled, known, best, conflicted, last = state
        was, out, fresh = last, [], []
        for f in rows:
            for at, s, v, c in f.sort_values(["ms", "seq"])[["ms", "statement_id", "verdict", "confidence"]].itertuples(index=False):
                if last is not None and at - last > self.keep_ms:
                    settled, known, best, conflicted, fresh = 0, None, 0.0, False, []
                    self.seen.clear()
                last, c = max(at, last or at), float(c)
                best = max(best, c)
                settles = v in _SETTLED
                opens = settles and known is not None and v != known and not conflicted
                settled, known = settled + settles, known or (v if settles else None)
                if opens:
                    conflicted = True
                    earlier = [*map(tuple, self.seen.get()), *fresh, (s, v, c)]
                    out += [(key[0], a, "unverified", min(b, 0.3), "conflicted") for a, k, b in earlier if k != "unverified"]
                    self.seen.clear()
                    fresh = []
                elif conflicted:
                    out.append((key[0], s, "unverified", min(c, 0.3), "conflicted"))
                else:
                    fresh.append((s, v, c))
                    status = "single" if settled < 2 else "corroborated"
                    out.append((key[0], s, v, min(best + min(0.05 * max(settled - 1, 0), 0.10), 0.98) if status == "corroborated" else c, status))
        if fresh:
            self.seen.appendList(fresh)
        if last != was:
            if was is not None:
                self.handle.deleteTimer(was + self.keep_ms)
            self.handle.registerTimer(int(last) + self.keep_ms)
        self.sums.update((int(settled), known, best, conflicted, int(last)))
        yield pd.DataFrame(out, columns=["claim_key", "statement_id", "verdict", "confidence", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        self.sums.clear()
        yield pd.DataFrame({c: pd.Series([], dtype="float64" if c == "confidence" else "object") for c in ("claim_key", "statement_id", "verdict", "confidence", "status")})

    def close(self) -> None:
        pass


def timed_ledger(occurrences: DataFrame, keep_ms: int, late: str = "1 hour") -> DataFrame:
    """Revisions in update mode. occurrences: claim_key, statement_id, seq, at (timestamp), verdict, confidence; late: how much later than others a row may come."""
    timed = occurrences.withColumn("ms", F.unix_millis("at")).withWatermark("at", late)
    return timed.groupBy("claim_key").transformWithStateInPandas(TimedLedger(keep_ms), REVISIONS, "Update", "EventTime")


def latest(revisions: DataFrame) -> DataFrame:
    """What stands after all batches: of a statement's revisions a conflict stays, else the one of the last batch."""
    sticky = F.struct((F.col("status") == "conflicted").alias("c"), "batch")
    return revisions.groupBy("claim_key", "statement_id").agg(F.max_by(F.struct("verdict", "confidence", "status"), sticky).alias("r")).select("claim_key", "statement_id", "r.verdict", F.round("r.confidence", 6).alias("confidence"), "r.status")


def windowed_counts(events: DataFrame, every: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Extension: counts by window and type with a watermark. events: ts timestamp, event_type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")
