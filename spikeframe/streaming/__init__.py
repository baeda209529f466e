"""Structured Streaming forms of the incremental analyses."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..storage import shared_folder


def running_intervals(points: DataFrame, unit: str, order: str = "event_id") -> DataFrame:
    """(unit, order, t, isi): the time since the unit's last point; the state is that point's time.

    Points of a unit are taken in the order of time within a batch; batches are taken as they come.
    """
    kind = points.schema[unit].dataType.simpleString()
    order_kind = points.schema[order].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["t", order])
        last = state.get[0] if state.exists else None
        before = rows["t"].shift(1)
        if last is not None:
            before.iloc[0] = last
        state.update((float(rows["t"].iloc[-1]),))
        out = rows.assign(isi=rows["t"] - before)
        yield out[out["isi"].notna()][[unit, order, "t", "isi"]]

    return points.groupBy(unit).applyInPandasWithState(step, f"{unit} {kind}, {order} {order_kind}, t double, isi double", "last double", "append", GroupStateTimeout.NoTimeout)


def binned_rate(points: DataFrame, time: str, width: str, delay: str, by: list[str]) -> DataFrame:
    """(by, window, count) of tumbling windows; windows close `delay` behind the latest time seen."""
    return points.withWatermark(time, delay).groupBy(*by, F.window(time, width)).agg(F.count("*").alias("count"))


def peri_event_pairs(spikes: DataFrame, events: DataFrame, before_seconds: float, after_seconds: float, delay: str, by: list[str]) -> DataFrame:
    """(by, spike_time, event_time): a stream-stream join within the window; both sides forget what can't match any more."""
    s = spikes.withWatermark("spike_time", delay)
    e = events.select(*(F.col(c).alias(f"_{c}") for c in by), "event_time").withWatermark("event_time", delay)
    same = [F.col(c) == F.col(f"_{c}") for c in by]
    low, high = (F.expr(f"event_time {sign} INTERVAL {abs(x)} SECONDS") for sign, x in (("-", before_seconds), ("+", after_seconds)))
    on = (F.col("spike_time") >= low) & (F.col("spike_time") <= high)
    for c in same:
        on = on & c
    return s.join(e, on).select(*by, "spike_time", "event_time")


def for_each_chunk(stream: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str):
    """Hands every micro-batch to `callback`; ends with the input."""
    query = stream.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_to_end(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """The rows of a stream over what is there now, through files in the session's checkpoint folder."""
    where = f"{shared_folder(spark)}/stream-{uuid.uuid4()}"
    query = stream.writeStream.format("parquet").option("path", f"{where}/rows").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/rows")
