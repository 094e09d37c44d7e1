"""The stream twin of operators.reservations: the same decisions over state that outlives batches and restarts.

Commands are decided as they arrive; within a batch in the order of (at, seq). For a stream that brings each sale's
commands in that order the verdicts are those of the batch form, however it is split. Commands later than the
watermark's delay get no verdict. Keys that can't be named any more are dropped from state by event-time timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.reservations import VERDICTS, Sale, prepared, well_formed
from ..sources.workers import reachable

#: (name, key, value) of the state variables, in the order that Sale takes them.
STATE = (
    ("stock", "section string", "extra long, held long, sold long"),
    ("taken", "user string, key string", "section string, qty long, deadline double, forget double, status string"),
    ("holding", "user string", "key string"),
    ("owned", "user string", "qty long"),
    ("queue", "place long", "user string, key string, deadline double, forget double"),
    ("clock", "one int", "now double, first long, old long, end long"),
)


class Kept:
    """A map in the state store; what one batch has read or written is at hand until the batch is over."""

    def __init__(self, state):
        self.state, self.seen = state, {}

    def get(self, key: tuple) -> tuple | None:
        if key not in self.seen:
            self.seen[key] = tuple(self.state.getValue(key)) if self.state.containsKey(key) else None
        return self.seen[key]

    def put(self, key: tuple, value: tuple) -> None:
        self.seen[key] = value
        self.state.updateValue(key, value)

    def drop(self, key: tuple) -> None:
        self.seen[key] = None
        if self.state.containsKey(key):
            self.state.removeKey(key)


class Replay(StatefulProcessor):
    def __init__(self, ttl: float):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = [handle.getMapState(*s) for s in STATE]

    def _sale(self) -> Sale:
        return Sale(*(Kept(s) for s in self.states))

    def _next(self, due: float | None) -> None:
        """One timer for each sale: when its oldest key can be dropped."""
        if due is not None and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(int(due * 1000) + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows).sort_values(["at", "seq"], kind="stable")
        batch = batch.astype(object).where(batch.notna(), None)
        sale, said, left = self._sale(), [], []
        for r in batch[["at", "kind", "user", "section", "qty", "key", "total", "opens", "hold_seconds", "most"]].itertuples(index=False):
            whole = [int(x) if i in (4, 6, 9) and x is not None else x for i, x in enumerate(r)]
            verdict, available = sale.verdict(tuple(whole), self.ttl)
            said.append(verdict)
            left.append(available)
        self._next(sale.forget(timerValues.getCurrentWatermarkInMs() / 1000))
        yield self._frame(key[0], batch["seq"].astype("int64").tolist(), said, left)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = self._sale().forget(timerValues.getCurrentWatermarkInMs() / 1000)
        if due is not None:
            self.handle.registerTimer(int(due * 1000) + 1)
        yield self._frame(key[0], [], [], [])

    @staticmethod
    def _frame(sale: str, seq: list, said: list, left: list) -> pd.DataFrame:
        kinds = {"sale": ([sale] * len(seq), object), "seq": (seq, "int64"), "verdict": (said, object), "available": (left, "Int64")}
        return pd.DataFrame({n: pd.Series(v, dtype=t) for n, (v, t) in kinds.items()})

    def close(self) -> None:
        pass


def replay(commands: DataFrame, sections: DataFrame, sales: DataFrame, ttl: float, delay: str) -> DataFrame:
    """(sale, seq, verdict, available) of a stream of commands; sections and sales are tables."""
    reachable(commands.sparkSession)
    commands.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = prepared(commands, sections, sales)
    good = rows.filter(well_formed()).withColumn("ts", F.timestamp_micros((F.col("at") * 1e6).cast("long"))).withWatermark("ts", delay)
    bad = rows.filter(~F.coalesce(well_formed(), F.lit(False))).select("sale", "seq", F.lit("malformed").alias("verdict"), F.lit(None).cast("long").alias("available"))
    decided = good.groupBy("sale").transformWithStateInPandas(statefulProcessor=Replay(ttl), outputStructType=VERDICTS, outputMode="Append", timeMode="EventTime")
    return decided.unionByName(bad)
