"""Keyed state in event time: client trust and action cool-down over rows that arrive in any order.

A key's rows wait in list state until the watermark has passed them; then they are taken in the order of their event time
and folded into the key's state. An event-time timer at the earliest waiting row sees to it for keys that get no new rows.
So the order of arrival does not matter as long as no row is later than the delay, and a key waits with the rows of one delay
at most. Rows behind the watermark are left out by Spark: that is the rule for late rows.

The state store must hold list state (RocksDB); ``driven`` sets it for the query that it starts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tabguard.operators import trust
from tabguard.sources.tables import scratch

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Gives a key's rows to ``fold`` in event-time order, once the watermark has passed them.

    A subclass names the columns that wait (the first is the event time in milliseconds, null marks a row that only moves
    the watermark), the columns of its state, and folds a batch of rows.
    """

    waiting_schema: str
    state_schema: str
    columns: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)
        self.state = handle.getValueState("state", self.state_schema)

    def rows_of(self, pdf: pd.DataFrame) -> list[tuple]:
        raise NotImplementedError

    def fold(self, key: tuple, state: tuple | None, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def _released(self, key: tuple, watermark: int) -> Iterator[pd.DataFrame]:
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted(r for r in rows if r[0] <= watermark)
        later = [r for r in rows if r[0] > watermark]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if later:
            self.handle.registerTimer(min(r[0] for r in later))
        if ready:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
            state, out = self.fold(key, self.state.get() if self.state.exists() else None, ready)
            self.state.update(state)
            yield pd.DataFrame(out, columns=self.columns)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            new = [r for r in self.rows_of(pdf) if r[0] is not None]
            if new:
                self.waiting.appendList(new)
        yield from self._released(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._released(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def _milliseconds(at: pd.Series) -> list[int]:
    return [int(t.value // 1_000_000) for t in pd.to_datetime(at)]


# ---- client trust (S1, with G2-G4) --------------------------------------------------------------------------------------


class Trust(InOrder):
    """Moving trust with hysteresis, and the distance from the client's own mean gradient so far."""

    waiting_schema = "at long, round long, sim double, gradient array<double>"
    state_schema = "n int, trust double, quarantined boolean, total array<double>"
    columns = ["client_id", "round", "trust", "quarantined", "divergence", "fingerprint_alarm"]

    def rows_of(self, pdf: pd.DataFrame) -> list[tuple]:
        return [(t, None if r is None or r != r else int(r), float(s), [] if g is None else [float(x) for x in g]) if r is not None and r == r else (None,) for t, r, s, g in zip(_milliseconds(pdf["at"]), pdf["round"], pdf["sim"], pdf["gradient"], strict=True)]

    def fold(self, key: tuple, state: tuple | None, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        n, t, q, total = state or (0, trust.START, False, [])
        total, out = list(total), []
        for _, r, sim, gradient in rows:
            far = 0.0
            if n >= trust.WARM_ROUNDS and total:
                mean = [x / n for x in total]
                size = math.sqrt(sum(x * x for x in gradient)), math.sqrt(sum(x * x for x in mean))
                far = (1 - (0.0 if min(size) < 1e-9 else sum(a * b for a, b in zip(gradient, mean)) / (size[0] * size[1]))) / 2
            total = [a + b for a, b in zip(total, gradient)] if total else list(gradient)
            n += 1
            a = trust.WARM if n <= trust.WARM_ROUNDS else trust.ACTIVE
            t = a * sim + (1 - a) * t
            q = bool((q and t < trust.RELEASE) or (t < trust.QUARANTINE and n >= trust.WARM_ROUNDS))
            out.append((key[0], r, float(t), q, float(far), far > trust.DIVERGENCE))
        return (n, float(t), q, total), out


def trust_states(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """client_id, round, trust, quarantined, divergence, fingerprint_alarm of a stream of client_id, round, sim, gradient, at.

    ``at`` is the event time of a round. A client's state is its trust and the sum of its gradients, whatever its past.
    """
    given = rows.select("client_id", "round", "sim", "gradient", "at").withWatermark("at", delay).groupBy("client_id")
    return given.transformWithStateInPandas(Trust(), "client_id long, round long, trust double, quarantined boolean, divergence double, fingerprint_alarm boolean", "Append", "EventTime")


# ---- action cool-down (S5) -----------------------------------------------------------------------------------------------


class Cooldown(InOrder):
    """One timestamp a segment: that of its last action. Rows of one time and segment wait as one number."""

    waiting_schema = "at long, seconds double, n long"
    state_schema = "last double"
    columns = ["segment", "at", "action", "n"]

    def __init__(self, seconds: float):
        self.seconds = seconds

    def rows_of(self, pdf: pd.DataFrame) -> list[tuple]:
        real = pdf[pdf["seconds"].notna()]
        counts = real.groupby("seconds", sort=False)["n"].sum()
        return [(int(s * 1000), float(s), int(n)) for s, n in counts.items()]

    def fold(self, key: tuple, state: tuple | None, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        last, out = state[0] if state else None, []
        for _, at, n in rows:
            act = last is None or at - last >= self.seconds
            if act:
                last = at
                out.append((key[0], at, "quarantine", 1))
            if n > act:
                out.append((key[0], at, "cooldown", n - act))
        return (last,), out


def cooldown_states(decisions: DataFrame, seconds: float = 30.0, delay: str = "1 hour") -> DataFrame:
    """segment, at, action, n for a stream of segment, seconds (since 1970), n (decisions at that time) and at (the same as a timestamp).

    The first decision of a segment acts, and so does the next one that is ``seconds`` later than the last action; the
    others are cooled down. Decisions of one segment and time are added up before they are sent.
    """
    given = decisions.select("segment", "seconds", "n", "at").withWatermark("at", delay).groupBy("segment")
    return given.transformWithStateInPandas(Cooldown(seconds), "segment string, at double, action string, n long", "Append", "EventTime")


# ---- driving -------------------------------------------------------------------------------------------------------------


def driven(parts: list[DataFrame], form: Callable[[DataFrame], DataFrame], closing: DataFrame, name: str) -> DataFrame:
    """What ``form`` gives for a stream that brings ``parts`` one after the other, a micro-batch each, and ``closing`` at the end.

    ``closing`` has rows that only move the watermark, so that all that waits comes out.
    """
    spark: SparkSession = closing.sparkSession
    source, to, state = (scratch(spark, f"{name}-{x}") for x in ("source", "out", "state"))
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        out = None
        for part in [*parts, closing]:
            part.write.mode("append").parquet(source)
            out = form(spark.readStream.schema(closing.schema).parquet(source))
            out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(to).awaitTermination()
    finally:
        spark.conf.set(_STORE, before) if before is not None else spark.conf.unset(_STORE)
    return spark.read.schema(out.schema).parquet(to)


def dealt(rows: DataFrame, parts: int, *keys: str) -> list[DataFrame]:
    """``rows`` dealt to parts by hash: an arrival in no order of time."""
    at = F.pmod(F.xxhash64(*keys, F.lit(11)), F.lit(parts))
    return [rows.where(at == k) for k in range(parts)]
