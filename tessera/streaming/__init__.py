"""Stateful scoring: keyed state for streams and ordered updates for tables.

A stateful step is written once, as an update of a state record by the function library. On tables it runs per key in
order inside Catalyst; on streams the same step runs with the state kept by Spark, a key a state.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Updates of plain values, for streams: (state, value, parameters) -> state. States start from the first value.


def ewma(state: tuple, x: float, alpha: float) -> tuple:
    return (x,) if state is None else (alpha * x + (1 - alpha) * state[0],)


def holt_winters(state: tuple, x: float, alpha: float, beta: float) -> tuple:
    if state is None:
        return x, 0.0
    level = alpha * x + (1 - alpha) * (state[0] + state[1])
    return level, beta * (level - state[0]) + (1 - beta) * state[1]


def cusum(state: tuple, x: float, reset: float = 0.0) -> tuple:
    return (max(reset, (state[0] if state else reset) + x),)


def moments(state: tuple, x: float) -> tuple:
    n, mean, var = state or (0.0, 0.0, 0.0)
    delta = x - mean
    mean += delta / (n + 1)
    return n + 1, mean, (var * n + delta * (x - mean)) / (n + 1)


def trigger(state: tuple, x: float, threshold: float) -> tuple:
    events, runs, current, longest = state or (0.0, 0.0, 0.0, 0.0)
    hit = x > threshold
    runs += hit and current == 0
    current = current + 1 if hit else 0.0
    return events + hit, runs, current, max(longest, current)


STEPS: dict[str, tuple[Callable, list[str]]] = {
    "ewma": (ewma, ["mean"]),
    "holt_winters": (holt_winters, ["level", "trend"]),
    "cusum": (cusum, ["last"]),
    "moments": (moments, ["count", "mean", "variance"]),
    "trigger": (trigger, ["num_events", "num_runs", "current_run", "longest_run"]),
}


def keyed_state(df: DataFrame, key: str, order: list[str], value: str, step: str, **parameters: float) -> DataFrame:
    """Each row with the state after it: a stream keeps the state by key, a table is walked per key in order."""
    update, fields = STEPS[step]
    kept = list(dict.fromkeys([key, *order, value]))
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + [f"{f} double" for f in fields])
    states = ", ".join(f"{f} double" for f in fields)

    def walk(pdf: pd.DataFrame, state: tuple | None):
        pdf = pdf[kept].sort_values(order, kind="stable")
        out = []
        for x in pdf[value].to_numpy(float):
            if x == x:
                state = update(state, float(x), **parameters)
            out.append(state or (None,) * len(fields))
        return pdf.assign(**{f: [s[k] for s in out] for k, f in enumerate(fields)}), state

    def stream(_: tuple, batches, state: GroupState):
        now = tuple(state.get) if state.exists else None
        for pdf in batches:
            out, now = walk(pdf, now)
            yield out
        if now is not None:
            state.update(tuple(map(float, now)))

    if df.isStreaming:
        return df.groupBy(key).applyInPandasWithState(stream, schema, states, "append", GroupStateTimeout.NoTimeout)

    def batches(parts):
        """Rows come sorted by key and order, so one state at a time is enough, however large a key is."""
        last, now = None, None
        for pdf in parts:
            done = []
            for k, rows in pdf.groupby(key, sort=False, dropna=False):
                if k != last:
                    last, now = k, None
                out, now = walk(rows, now)
                done.append(out)
            if done:
                yield pd.concat(done)

    return df.select(*kept).repartition(key).sortWithinPartitions(key, *order).mapInPandas(batches, schema)


def windowed(df: DataFrame, ts: str, late: str, size: str, keys: list[str], *aggregates: Column, slide: str | None = None) -> DataFrame:
    """Event-time windows with a watermark for late rows."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, size, slide), *keys).agg(*aggregates)


def last_n(keys: list[str], order: list[str], n: int):
    """The count-based window of the last n rows of a key."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)
