"""The stream twin of operators.fragments: parts wait in state; an event-time timer ends a message whose rest never comes.

For a stream that brings each key's parts in the order of (ts, tie) the rows are those of the batch form with `until` at
the last watermark, however it is split. Parts later than the watermark's delay are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.fragments import OUT, in_range, named, refused
from ..sources.workers import reachable


class Joiner(StatefulProcessor):
    """State of one (key, total): when its message began, and its parts so far."""

    def __init__(self, timeout: float, names: list[str]):
        self.timeout, self.names = timeout, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.began = handle.getValueState("began", "at double, first_tie long")
        self.parts = handle.getListState("parts", "payload string")

    def _drop(self) -> None:
        if self.began.exists():
            self.handle.deleteTimer(self._due(self.began.get()[0]))
        self.began.clear()
        self.parts.clear()

    def _due(self, at: float) -> int:
        return int((at + self.timeout) * 1000) + 1

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        columns = {n: [v] * len(rows) for n, v in zip(self.names, key)} | {n: [r[k] for r in rows] for k, n in enumerate(OUT)}
        return pd.DataFrame({n: pd.Series(v, dtype="int64" if n in ("first_tie", "n_parts") else object) for n, v in columns.items()})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, out = key[-1], []
        batch = pd.concat(rows).sort_values(["at", "tie"], kind="stable")
        at, tie, held = None, None, []
        if self.began.exists():
            (at, tie), held = self.began.get(), [p[0] for p in self.parts.get()]

        def end(outcome: str, *more: str) -> None:
            nonlocal at, tie, held
            out.append((tie, outcome, len(held) + len(more), "".join([*held, *more])))
            at, tie, held = None, None, []

        for r in batch.itertuples(index=False):
            if at is not None and (r.num == 1 or r.at - at > self.timeout):
                end("incomplete")
            if r.num == 1:
                at, tie, held = r.at, r.tie, [r.payload]
            elif at is None:
                out.append((r.tie, "orphan_fragment", 1, r.payload))
                continue
            elif r.num != len(held) + 1:
                end("fragment_out_of_order", r.payload)
                continue
            else:
                held.append(r.payload)
            if len(held) == total:
                end("complete")
        self._drop()
        if at is not None:
            self.began.update((float(at), int(tie)))
            self.parts.put([(p,) for p in held])
            self.handle.registerTimer(self._due(at))
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.began.exists():
            held = [p[0] for p in self.parts.get()]
            out.append((self.began.get()[1], "incomplete", len(held), "".join(held)))
            self.began.clear()
            self.parts.clear()
        yield self._frame(key, out)

    def close(self) -> None:
        pass


def join_fragments(parts: DataFrame, keys: Sequence[str], total: str, num: str, ts: str, tie: str, payload: str, timeout: float, delay: str) -> DataFrame:
    """(keys, first_tie, outcome, n_parts, payload) of a stream of parts."""
    reachable(parts.sparkSession)
    parts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = named(parts, keys, total, num, ts, tie, payload)
    good = rows.filter(in_range(keys)).withColumn("ts", F.timestamp_micros((F.col("at") * 1e6).cast("long"))).withWatermark("ts", delay)
    flat = good.select(*(F.col("key").getField(k).alias(f"key_{i}") for i, k in enumerate(keys)), "total", "num", "at", "tie", "payload", "ts")
    names = [f"key_{i}" for i in range(len(keys))]
    kinds = {f.name: f.dataType.simpleString() for f in flat.schema}
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", first_tie long, outcome string, n_parts long, payload string"
    joined = flat.groupBy(*names, "total").transformWithStateInPandas(statefulProcessor=Joiner(timeout, names), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    joined = joined.select(*(F.col(n).alias(k) for n, k in zip(names, keys)), *OUT)
    return joined.unionByName(refused(rows, keys).select("key.*", *OUT))
