"""Rate limiter with keyed state, for streams that arrive in order.

Each key keeps the times of its last attempts: those of the trailing window, and
never more than one above the cap, since more cannot change a decision. The
state of a key is dropped once the watermark has passed its window. Attempts
that come later than the watermark are not seen by a stateful operator; where
those must count, ``streaming.alerts.rate_limit_query`` decides again.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

MICROS = 1_000_000
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def decide(times: np.ndarray, state: list[int], cap: int, window: int) -> tuple[np.ndarray, list[int]]:
    """(attempts in the window that ends with each attempt, at most cap + 1; the
    times to remember). Attempts at the same instant count together."""
    known = np.sort(np.concatenate((np.array(state, dtype=np.int64), times)))
    count = np.searchsorted(known, times, side="right") - np.searchsorted(known, times - window, side="right")
    kept = known[known > known[-1] - window][-(cap + 1):]
    return np.minimum(count, cap + 1), kept.tolist()


def limit_by_key(alerts: DataFrame, key_cols: list[str], ts_col: str = "timestamp", seq_col: str = "flow_seq",
                 cap: int = 100, window_seconds: int = 60, watermark: str = "10 minutes") -> DataFrame:
    """Streaming: key columns, seq, ``window_count`` (attempts of the key in the
    trailing window, itself and same-instant attempts included, at most cap + 1)
    and ``passed``, a row per attempt, as soon as it arrives. Null keys are a key
    of their own."""
    window = window_seconds * MICROS
    staged = (alerts.withColumn("_event", F.col(ts_col).cast("timestamp")).withWatermark("_event", watermark)
              .select(*key_cols, seq_col, "_event", F.unix_micros("_event").alias("_t")))
    types = dict(staged.dtypes)

    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        batch = pd.concat(list(frames), ignore_index=True)
        count, kept = decide(batch["_t"].to_numpy(dtype=np.int64), list(state.get[0]) if state.exists else [], cap, window)
        state.update((kept,))
        state.setTimeoutTimestamp(max((kept[-1] + window) // 1000, state.getCurrentWatermarkMs() + 1))
        out = {c: pd.Series([key[i]] * len(batch), dtype=object) for i, c in enumerate(key_cols)}
        yield pd.DataFrame(out | {seq_col: batch[seq_col], "window_count": count, "passed": count <= cap})

    keys = ", ".join(f"`{c}` {types[c]}" for c in key_cols)
    return staged.groupBy(*key_cols).applyInPandasWithState(
        run, f"{keys}, `{seq_col}` {types[seq_col]}, window_count long, passed boolean", "times array<long>", "append",
        GroupStateTimeout.EventTimeTimeout)
