"""Streaming twins of the usage windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provalake.operators.quota import usage


def with_event_time(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Zone-aware event time (the session zone must be UTC) with a watermark; later rows are dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def tumbling_usage(events: DataFrame, every: str = "1 minute", watermark: str = "10 minutes") -> DataFrame:
    return usage(with_event_time(events, watermark), every)


#: Windows handed on at once.
BATCH = 10_000

#: The state store that anchored windows need, and the setting that names it.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _windows(current: tuple | None, us: np.ndarray, requests: np.ndarray, tokens: np.ndarray, span: int) -> tuple[tuple, np.ndarray]:
    """The window left open after more sorted times with their sums, and (anchor, requests, tokens) of those that closed."""
    if current is not None:  # the open window is one more time, before all others
        us, requests, tokens = (np.concatenate([[x], v]) for x, v in zip(current, (us, requests, tokens)))
    nxt, starts, at = np.searchsorted(us, us + span, side="right").tolist(), [], 0
    while at < len(us):
        starts.append(at)
        at = nxt[at]
    done = np.column_stack([us[starts], np.add.reduceat(requests, starts), np.add.reduceat(tokens, starts)])
    return tuple(int(x) for x in done[-1]), done[:-1]


def anchored_usage(events: DataFrame, watermark: str = "10 minutes", seconds: int = 60) -> DataFrame:
    """Anchored windows per provider as a stateful stream.

    Rows wait, added up by provider and time, in an aggregate whose state lies on all tasks; it gives out a time once the watermark has
    passed it, so times are handled in order and a late row still finds its window. Each provider then keeps its one open window. A
    provider's task gets three numbers for each different time that has come due since the last micro-batch, never the rows or the history.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Anchored(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.open = handle.getValueState("open", "anchor long, requests long, tokens long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            parts = [[pdf[c].to_numpy("int64") for c in ("us", "requests", "tokens")] for pdf in rows]
            us, requests, tokens = (np.concatenate(c) for c in zip(*parts))
            del parts
            order = np.argsort(us)
            current, done = _windows(self.open.get() if self.open.exists() else None, us[order], requests[order], tokens[order], seconds * 1_000_000)
            self.open.update(current)
            for at in range(0, len(done), BATCH):
                out = pd.DataFrame(done[at:at + BATCH], columns=["anchor", "requests", "tokens"])
                out.insert(0, "provider", pd.Series([key[0]] * len(out), dtype=object))
                yield out

        def close(self) -> None:
            pass

    e = with_event_time(events, watermark).groupBy("provider", "ts").agg(
        F.count("*").alias("requests"), F.coalesce(F.sum("tokens_used"), F.lit(0)).cast("long").alias("tokens"))
    return e.select("provider", "ts", F.unix_micros("ts").alias("us"), "requests", "tokens").groupBy("provider").transformWithStateInPandas(
        statefulProcessor=Anchored(), outputStructType="provider string, anchor long, requests long, tokens long",
        outputMode="Append", timeMode="EventTime")
