"""Intervals of a stream whose rows come late and mixed: state keyed by units' hash, rows held until the watermark has passed them.

A row waits in its bucket's list until no earlier row can come any more; a timer at the earliest waiting row wakes the bucket then.
The state of a bucket is the rows of the last `delay`, in packed chunks, and each of its units' time before them, so that what a
batch asks of the state store grows with the buckets and not with units or rows. Rows later than `delay` are dropped by the watermark.
"""

from __future__ import annotations

import itertools
import pickle
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..storage import shared_folder

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
START, END_OF_TIME = -5.0e10, 1.0e11  # seconds; watermarks begin at the epoch, so times are told from START


#: Rows packed into one value of the state.
CHUNK = 1 << 14


class _Waiting(StatefulProcessor):
    """Waiting rows are chunks of (microseconds, t, unit, order) with the earliest's microseconds; `due` is the time of the one timer that a bucket has."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "us long, rows binary")
        self.last = handle.getValueState("last", "times binary")
        self.due = handle.getValueState("due", "ms long")

    def _wake_at(self, us: int) -> None:
        ms = -(-us // 1000)
        if self.due.exists():
            if (before := self.due.get()[0]) <= ms:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        chunks = []
        while some := [(r["us"], r["t"], r["unit"], r["place"]) for r in itertools.islice(rows, CHUNK)]:
            chunks.append(_chunk(some))
        if chunks:
            self.rows.appendList(chunks)
            self._wake_at(min(c[0] for c in chunks))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.due.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready, some, wait = [], [], []
        for us, packed in self.rows.get():
            if us > passed:
                wait.append((us, packed))
                continue
            for row in pickle.loads(packed):
                (ready if row[0] <= passed else some).append(row)
        wait += [_chunk(some[lo : lo + CHUNK]) for lo in range(0, len(some), CHUNK)]
        self.rows.clear()
        if wait:
            self.rows.appendList(wait)
            self._wake_at(min(c[0] for c in wait))
        ready.sort(key=lambda r: (r[1], True) if r[3] is None else (r[1], False, r[3]))
        last = pickle.loads(self.last.get()[0]) if self.last.exists() else {}
        for _, t, unit, place in ready:
            at = "nan" if unit != unit else unit
            if at in last:
                yield Row(unit=unit, place=place, t=t, isi=t - last[at])
            last[at] = t
        if ready:
            self.last.update((pickle.dumps(last),))

    def close(self) -> None:
        pass


def _chunk(rows: list[tuple]) -> tuple[int, bytes]:
    return min(r[0] for r in rows), pickle.dumps(rows)


def intervals_in_order(points: DataFrame, unit: str, order: str, delay: str, buckets: int = 256) -> DataFrame:
    """(unit, order, t, isi): the time since the unit's point before, whatever the order in which the rows come.

    `points` is a stream with `t` in seconds. Rows that come at most `delay` behind the latest one are all used, ties go by `order`
    (nulls last), and the rows are those of one run over the whole table in order; later ones are dropped. A null unit is a unit;
    rows without a time between START and END_OF_TIME have no
    place and are left out, NaN too. Other columns are not read. Needs the RocksDB state store
    (`rocks_state`). Units are of a plain type, not arrays; those of one of `buckets` share a state, which a task holds when it wakes. A row is given once the watermark has passed it: an input that ends is closed by `run_closed`.
    """
    unit_kind, place_kind = (points.schema[c].dataType.simpleString() for c in (unit, order))
    us = F.floor((F.col("t") - START) * 1e6).cast("long")
    timed = points.where((F.col("t") > START) & (F.col("t") <= END_OF_TIME)).select(F.col(unit).alias("unit"), F.col(order).alias("place"), F.col("t").cast("double").alias("t"), us.alias("us"), F.timestamp_micros(us).alias("time"))
    timed = timed.withColumn("bucket", F.pmod(F.xxhash64("unit"), F.lit(buckets)))
    found = timed.withWatermark("time", delay).groupBy("bucket").transformWithState(_Waiting(), f"unit {unit_kind}, place {place_kind}, t double, isi double", "append", "eventTime")
    return found.select(F.col("unit").alias(unit), F.col("place").alias(order), "t", "isi")


@contextmanager
def rocks_state(spark: SparkSession):
    """Streams started within keep their state in RocksDB; the session's setting is put back behind."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


def run_closed(points: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of `build(points)` over what is there now, the input then being closed so that nothing waits any more.

    The stream runs to its end, and goes on from its checkpoint with one more row, of the end of time, that a second source has by then:
    its watermark releases all state. The row has nulls but for `t`, and never comes out itself. All is kept in the shared folder.
    """
    spark = points.sparkSession
    where = f"{shared_folder(spark)}/closed-{uuid.uuid4()}"
    spark.createDataFrame([], points.schema).write.parquet(f"{where}/closing")
    closing = spark.readStream.schema(points.schema).parquet(f"{where}/closing")
    out = build(points.unionByName(closing))
    with rocks_state(spark):
        for last in (False, True):
            if last:
                row = [F.lit(END_OF_TIME if f.name == "t" else None).cast(f.dataType).alias(f.name) for f in points.schema]
                spark.range(1).select(*row).write.mode("append").parquet(f"{where}/closing")
            out.writeStream.format("parquet").option("path", f"{where}/rows").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{where}/rows")
