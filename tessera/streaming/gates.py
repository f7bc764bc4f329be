"""Failure gates: calls of a service that fails are refused for a while, in a stream or over a table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

THRESHOLD, RESET_SECONDS = 5, 60.0
OUTPUT = "service string, call_id long, at double, admitted boolean, state string"


@dataclass
class Gate:
    """One service's gate. ``call`` takes the calls in order of time; times are seconds."""

    failures: int = 0
    last: float = float("-inf")
    state: str = "closed"

    def call(self, at: float, failed: bool, threshold: int = THRESHOLD, reset: float = RESET_SECONDS) -> bool:
        """Whether a call is let through; what became of it then moves the gate.

        A gate opens at the threshold's failure, each at most ``reset`` after the one before, and refuses calls until
        ``reset`` after the last failure; then one call tries: it closes the gate or opens it again.
        """
        quiet = at - self.last >= reset
        if self.state == "open":
            if not quiet:
                return False
            self.state = "half-open"
        if not failed:
            self.failures, self.state = 0, "closed"
            return True
        self.failures = threshold if self.state == "half-open" else 1 if quiet else self.failures + 1
        self.last = at
        if self.failures >= threshold:
            self.state = "open"
        return True


def gate_table(calls: DataFrame, threshold: int = THRESHOLD, reset: float = RESET_SECONDS) -> DataFrame:
    """calls(service, call_id, at, failed), at in seconds -> ``(service, call_id, at, admitted, state)``, state being that after the call.

    Calls of a service are taken by time, ties by id, in one pass over sorted rows, so that no service is held in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        service, gate = None, Gate()
        for b in batches:
            out = []
            for s, at, failed in zip(b["service"].to_pylist(), b["at"].to_pylist(), b["failed"].to_pylist(), strict=True):
                if s != service:
                    service, gate = s, Gate()
                out.append((gate.call(at, failed, threshold, reset), gate.state))
            yield pa.RecordBatch.from_arrays([b["service"], b["call_id"], b["at"], pa.array([x[0] for x in out], pa.bool_()), pa.array([x[1] for x in out], pa.string())], ["service", "call_id", "at", "admitted", "state"])

    rows = calls.where(F.col("service").isNotNull() & F.col("at").isNotNull()).select("service", "call_id", "at", F.coalesce("failed", F.lit(False)).alias("failed"))
    return rows.repartition("service").sortWithinPartitions("service", "at", "call_id").mapInArrow(run, OUTPUT)


class GateProcessor(StatefulProcessor):
    """The gate as state of a stream: state goes ``idle`` seconds after a service's last call, by a timer of event time."""

    def __init__(self, threshold: int, reset: float, idle: float):
        self.threshold, self.reset, self.idle = threshold, reset, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.gate = handle.getValueState("gate", "failures int, last double, state string")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  (Spark's names)
        found = self.gate.get() if self.gate.exists() else None
        gate = Gate(*found) if found else Gate()
        calls = pd.concat(list(rows)).sort_values(["at", "call_id"])
        out = [(gate.call(at, bool(failed), self.threshold, self.reset), gate.state) for at, failed in zip(calls["at"], calls["failed"], strict=True)]
        self.gate.update((gate.failures, gate.last, gate.state))
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        due = int((float(calls["at"].iloc[-1]) + self.idle) * 1000)
        self.handle.registerTimer(due)
        self.timer.update((due,))
        yield pd.DataFrame({"service": key[0], "call_id": calls["call_id"].to_numpy(), "at": calls["at"].to_numpy(), "admitted": [x[0] for x in out], "state": [x[1] for x in out]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self.gate.clear()
        self.timer.clear()
        yield pd.DataFrame({"service": [key[0]], "call_id": [None], "at": [expiredTimerInfo.getExpiryTimeInMs() / 1000], "admitted": [None], "state": ["forgotten"]})

    def close(self) -> None:
        pass


def gate_stream(calls: DataFrame, ts: str, threshold: int = THRESHOLD, reset: float = RESET_SECONDS, idle: float = 30 * 86400.0, late: str = "1 hour") -> DataFrame:
    """``gate_table`` over a stream of calls(service, call_id, ``ts``, failed), with a row ``forgotten`` where idle state goes.

    Calls are taken in order inside a micro-batch; one that comes in a later batch than its time is taken when it comes.
    Needs the RocksDB state store.
    """
    rows = calls.withWatermark(ts, late).select("service", "call_id", F.col(ts), F.col(ts).cast("double").alias("at"), F.coalesce("failed", F.lit(False)).alias("failed"))
    return rows.groupBy("service").transformWithStateInPandas(GateProcessor(threshold, reset, idle), OUTPUT, "Append", "EventTime")
