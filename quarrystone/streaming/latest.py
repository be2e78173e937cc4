"""Latest-wins and conflict state of a ledger as a stream: a value for each key, kept by Spark's state store.

A batch touches the state of its own keys alone, so its cost does not grow with history.  What comes out is a log of
changes in append mode, which a file sink takes; the last change of a key is its state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that processors of keyed values need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
POLICIES = ("last", "first", "error")
#: Names of the order and the time beside the payload p0, p1, ...: only those of Python's own kind reach a processor.
ORDER, TIME = "ledger_order", "ledger_time"


class Keeper(StatefulProcessor):
    """Holds order, payload and number of changes of a key.

    policy 'last': an event with a greater order replaces the value; 'first': the value stays; 'error': an event
    with another payload stops the stream, wherever it stands.  Repeats of the same payload change nothing.  With idle (milliseconds of event time), a key that
    has had no event for so long is closed: a last row says so, and its state goes.
    """

    def __init__(self, payload: T.StructType, columns: list[str], policy: str, idle: int | None):
        self.columns, self.policy, self.idle = columns, policy, idle
        self.payload = [T.StructField(f"p{i}", f.dataType) for i, f in enumerate(payload.fields)]
        self.names = [f.name for f in self.payload]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", T.StructType([T.StructField("o", T.LongType()), T.StructField("n", T.LongType()), *self.payload]))
        self.due = handle.getValueState("due", T.StructType([T.StructField("at", T.LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.held.get()  # null if there is none: one call, not two
        order, n, value = (state[0], state[1], tuple(state[2:])) if state else (None, 0, None)
        made, latest = [], None
        for pdf in rows:
            if self.idle is not None:
                top = int(pd.to_datetime(pdf[TIME]).max().timestamp() * 1000)
                latest = top if latest is None else max(latest, top)
            # most keys have a few rows, for which sorting a frame costs more than the rows
            orders = pdf[ORDER].tolist()
            columns = [[None if x is pd.NaT or (not isinstance(x, (list, dict)) and pd.isna(x)) else x for x in pdf[c].tolist()] for c in self.names]
            for i in sorted(range(len(orders)), key=lambda i: (orders[i] != orders[i], orders[i])):
                o, new = orders[i], [c[i] for c in columns]
                got = tuple(new)
                if value is None or (self.policy == "last" and o > order and got != value):
                    order, n, value = o, n + 1, got
                    made.append((*key, n, o, True, *got))
                elif self.policy == "error" and got != value:
                    raise ValueError(f"conflicting events for {key}")
                elif self.policy == "last" and o > order:
                    order = o
        self.held.update((order, n, *value))
        if latest is not None:
            self._rearm(latest + self.idle)
        yield self._frame(made)

    def _rearm(self, at: int) -> None:
        before = self.due.get()[0] if self.due.exists() else None
        if before is None or at > before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.held.get() if self.held.exists() else None
        made = [(*key, state[1] + 1, state[0], False, *state[2:])] if state else []
        self.held.clear()
        self.due.clear()
        yield self._frame(made)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.columns, dtype=object)

    def close(self) -> None:
        pass


def changes(events: DataFrame, keys: list[str], order: str, payload: list[str], policy: str = "last", time: str | None = None, idle: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """keys, change (1, 2, ... for each key), order, kept (false if the key is closed) and payload: a row for each change of a key's value.

    events is a stream; order is a long column that grows along the ledger.  The session's state store has to be PROVIDER.
    """
    if policy not in POLICIES:
        raise ValueError(policy)
    idle_ms = None
    rows = events
    if idle is not None:
        rows = rows.withWatermark(time, delay)
        idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    kept = rows.select(*keys, F.col(order).cast("long").alias(ORDER), *([F.col(time).alias(TIME)] if idle is not None else []), *[F.col(c).alias(f"p{i}") for i, c in enumerate(payload)])
    schema = events.select(*payload).schema
    out = T.StructType([*events.select(*keys).schema.fields, T.StructField("change", T.LongType()), T.StructField(order, T.LongType()), T.StructField("kept", T.BooleanType()), *schema.fields])
    if len(set(out.names)) < len(out.names):
        raise ValueError(f"columns clash: {out.names}")
    keeper = Keeper(schema, out.names, policy, idle_ms)
    return kept.groupBy(*keys).transformWithStateInPandas(statefulProcessor=keeper, outputStructType=out, outputMode="Append", timeMode="EventTime" if idle is not None else "None")


def run_changes(changed: DataFrame, path: str, checkpoint: str) -> None:
    """Writes all changes that the stream has now to a folder; a later call with the same checkpoint goes on from there."""
    spark = changed.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)
    try:
        changed.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
    finally:
        spark.conf.set(key, before)


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last change of each key of a folder of changes; closed keys are left out."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), "change").alias("r"))
    return newest.select(*keys, "r.*").where("kept")
