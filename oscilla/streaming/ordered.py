"""Streams in order of event time, whatever the order in which rows arrive: rows wait until the watermark has passed them.

A step function then takes a key's rows in order, with one small state a key; Spark calls and stores many keys at a time. What a step has told never changes, late rows
within the watermark are in their place, and rows that come later than it are dropped, by Spark itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "60 seconds"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: step(rows in order, state or None) -> rows out, state
Step = Callable[[pd.DataFrame, tuple | None], tuple[pd.DataFrame, tuple]]
#: tick(state, watermark in microseconds) -> rows out, state, when to be called again if nothing comes (or None)
Tick = Callable[[tuple, int], tuple[pd.DataFrame, tuple, int | None]]


#: Keys are dealt to so many groups at most; a group is one call and one state.
GROUPS = 1024


def _ordered(rows: dict, order: list[str]) -> pd.DataFrame:
    """The rows in order. Where the first column decides, as most times do, the others are not looked at."""
    first = rows[order[0]]
    if first.dtype.kind not in "iu":
        return pd.DataFrame(rows).sort_values(order, kind="stable")
    at = np.argsort(first, kind="stable")
    if len(order) > 1 and not (np.diff(first[at]) > 0).all():
        return pd.DataFrame(rows).sort_values(order, kind="stable")
    return pd.DataFrame({c: v[at] for c, v in rows.items()})


class Grouped:
    """The call for a group of keys: a call and a state for each key cost Spark and Python some ten times what a step does."""

    def __init__(self, keys: T.StructType, columns: list[str], order: list[str], step: Step, waits: T.StructType | None = None, tick: Tick | None = None, told: int = 10_000):
        self.names, self.whole = keys.names, [isinstance(f.dataType, T.IntegralType) for f in keys]
        self.own, self.order, self.step, self.tick, self.rows = [c for c in columns if c not in keys.names], order, step, tick, told
        self.arrow = to_arrow_schema(waits) if waits else None

    def _packed(self, rows: dict) -> bytes:
        """The rows of a group that wait, as one value."""
        arrays = [pa.array(rows[f.name], f.type, from_pandas=True) for f in self.arrow]
        return pa.RecordBatch.from_arrays(arrays, schema=self.arrow).serialize().to_pybytes()

    def _unpacked(self, held: bytes) -> dict:
        batch = pa.ipc.read_record_batch(pa.py_buffer(held), self.arrow)
        return {n: c.to_numpy(zero_copy_only=False) for n, c in zip(self.arrow.names, batch.columns, strict=True)}

    def _keys(self, rows: dict) -> Iterator[tuple[tuple, dict]]:
        """Each key with its own rows, as they came."""
        code = np.zeros(len(rows[self.names[0]]), np.int64)
        for k in self.names:
            own, values = pd.factorize(rows[k])
            code = code * (len(values) + 1) + own + 1
        at = np.argsort(code, kind="stable")
        for own in np.split(at, np.flatnonzero(np.diff(code[at])) + 1):
            key = (rows[k][own[0]] for k in self.names)
            yield tuple(None if pd.isna(k) else int(k) if whole else k for k, whole in zip(key, self.whole, strict=True)), {c: rows[c][own] for c in self.own}

    def _frames(self, told: Iterator[tuple[tuple, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        """What has been told behind its keys, some keys at a time."""
        held, n = [], 0
        for key, rows in told:
            if len(rows):
                held.append((key, rows))
                n += len(rows)
            if n >= self.rows:
                yield self._frame(held)
                held, n = [], 0
        if held:
            yield self._frame(held)

    def _frame(self, held: list[tuple[tuple, pd.DataFrame]]) -> pd.DataFrame:
        out = pd.concat([rows for _, rows in held], ignore_index=True)
        for i, name in enumerate(self.names):
            out.insert(i, name, [k for key, rows in held for k in [key[i]] * len(rows)])
        return out

    def _steps(self, rows: dict, states: dict) -> Iterator[tuple[tuple, pd.DataFrame]]:
        for key, own in self._keys(rows):
            told, states[key] = self.step(_ordered(own, self.order), states.get(key))
            yield key, told

    def _ticks(self, states: dict, mark: int, calls: list[int]) -> Iterator[tuple[tuple, pd.DataFrame]]:
        for key, state in states.items():
            told, states[key], again = self.tick(state, mark)
            calls += [again] if again is not None else []
            yield key, told

    def __call__(self, group, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        waiting, kept = held.get if held.exists else (None, None)
        width, calls = len(self.names), []
        states = {tuple(x[:width]): tuple(x[width:]) for x in kept or ()}
        # a group whose time has come is called without rows
        columns = [*self.names, *self.own]
        parts = [{c: b[c].to_numpy() for c in columns} for b in batches if len(b)]
        parts = [self._unpacked(waiting), *parts] if waiting else parts
        rows = {c: np.concatenate([p[c] for p in parts]) for c in columns} if parts else None
        waiting = None
        if rows and self.arrow:
            passed = rows["at_us"] <= held.getCurrentWatermarkMs() * 1000
            left = {c: v[~passed] for c, v in rows.items()}
            if len(left["at_us"]):
                waiting = self._packed(left)
                calls.append(int(left["at_us"].min()))
            rows = {c: v[passed] for c, v in rows.items()} if passed.any() else None
        if rows:
            yield from self._frames(self._steps(rows, states))
        if self.tick:
            yield from self._frames(self._ticks(states, held.getCurrentWatermarkMs() * 1000, calls))
        held.update((waiting, [(*key, *(x.item() if isinstance(x, np.generic) else x for x in state)) for key, state in states.items()]))
        if calls:
            # a group is called once the watermark is beyond this millisecond
            held.setTimeoutTimestamp(max(-(-min(calls) // 1000) - 1, 1))


def by_group(df: DataFrame, keys: list[str], call: Grouped, out: str, state: str, timeout: str, groups: int = GROUPS) -> DataFrame:
    """call over the groups of df's keys. The state of a group has the rows that wait and, in ``kept``, the keys with what their steps keep."""
    own = T.StructType([df.schema[k] for k in keys])
    told = T.StructType([*own.fields, *T.StructType.fromDDL(out).fields])
    kept = T.ArrayType(T.StructType([*own.fields, *T.StructType.fromDDL(state).fields]))
    states = T.StructType([T.StructField("waiting", T.BinaryType()), T.StructField("kept", kept)])
    return df.withColumn("__group", F.pmod(F.xxhash64(*keys), F.lit(groups))).groupBy("__group").applyInPandasWithState(call, told, states, "append", timeout)


def in_order(df: DataFrame, keys: list[str], time: str, order: list[str], step: Step, out: str, state: str, late: str = LATE, tick: Tick | None = None) -> DataFrame:
    """The rows that step tells (keys, out) for each key's rows of df in order of ``time`` (microseconds, at_us to the step), then ``order``.

    Rows wait for those that are up to ``late`` behind the newest row of all; rows without a time are dropped. All columns of df are
    kept while rows wait, so only those that step reads should be there. ``tick`` tells what follows from time going on.
    """
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    own = [c for c in df.columns if c not in keys and c != time]
    timed = df.where(F.col(time).isNotNull()).select(*keys, F.col(time).alias("at_us"), *own, F.timestamp_micros(time).alias("ts")).withWatermark("ts", late)
    held = T.StructType([f for f in timed.schema.fields if f.name != "ts"])
    call = Grouped(T.StructType([held[k] for k in keys]), held.names, ["at_us", *order], step, held, tick)
    return by_group(timed, keys, call, out, state, GroupStateTimeout.EventTimeTimeout)
