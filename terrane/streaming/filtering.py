"""The forward filter over a stream: one state vector a unit, in order of time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "unit long, t long, prob array<double>"
STATE = "t long, a array<double>"


def stream_filter(rows: DataFrame, n: int, initial: list[float]) -> DataFrame:
    """(unit, t, prob) from a stream of (unit, t, m), m the flat to-by-from transition array.

    A gap in time starts anew; rows not later than the unit's last one are late and dropped."""
    start = np.array(initial, float)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, a = (state.get[0], np.array(state.get[1])) if state.exists else (None, start)
        out = []
        for r in pd.concat(list(frames)).sort_values("t").itertuples():
            if last is not None and r.t <= last:
                continue
            a = np.array(r.m).reshape(n, n) @ (start if last is None or r.t != last + 1 else a)
            a, last = a / a.sum(), int(r.t)
            out.append((int(key[0]), last, a.tolist()))
        if last is not None:
            state.update((last, a.tolist()))
        yield pd.DataFrame(out, columns=["unit", "t", "prob"])

    return rows.groupBy("unit").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
