"""The state machine of a run as a stream: what changes, and runs that hang."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def transition_stream(log: DataFrame, key: str, late: str = "1 minute", stuck_ms: int | None = None, running: str = "running") -> DataFrame:
    """``key``, seq, before, status for each row of a stream (key, seq, at, status) whose status differs from the key's last.

    A key's state is its last status; rows of a micro-batch are taken in the order of (at, seq), and
    batches as they come.  With ``stuck_ms``, a key that has been running so long by the watermark, without a row since, goes to "error"
    with a null seq.
    """
    kind = log.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("seq", T.LongType()), T.StructField("before", T.StringType()), T.StructField("status", T.StringType())])

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at = state.get if state.exists else (None, 0)
        rows: list[tuple] = []
        if state.hasTimedOut:
            rows.append((keys[0], None, last, "error"))
            last = "error"
        for part in [pd.concat([p for p in parts])] if not state.hasTimedOut else []:
            part = part.sort_values(["at", "seq"], kind="stable")
            for seq, when, status in zip(part["seq"].tolist(), part["at"].tolist(), part["status"].tolist(), strict=True):
                if last is not None and status != last:
                    rows.append((keys[0], seq, last, status))
                last, at = status, int(when.value // 1_000_000)
        state.update((last, at))
        if stuck_ms is not None and last == running:
            state.setTimeoutTimestamp(max(at + stuck_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype=object) for k, c in enumerate(out.names)})

    timeout = GroupStateTimeout.NoTimeout if stuck_ms is None else GroupStateTimeout.EventTimeTimeout
    rows = log.select(key, "seq", "at", "status")
    rows = rows if stuck_ms is None else rows.withWatermark("at", late)
    return rows.groupBy(key).applyInPandasWithState(step, out, "status string, at long", "append", timeout)
