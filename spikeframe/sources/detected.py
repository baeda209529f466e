"""Spikes that a multi-electrode recorder has already detected: (channel, time_ms) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def channel_neurons(detected: DataFrame, session_id: str = "detected") -> DataFrame:
    """(session_id, var_name, kind, idx, t): one neuron for each channel, times in seconds."""
    train = Window.partitionBy("channel").orderBy("time_ms")
    return detected.select(
        F.lit(session_id).alias("session_id"), F.concat(F.lit("ch_"), F.col("channel").cast("string")).alias("var_name"), F.lit("neuron").alias("kind"),
        (F.row_number().over(train) - 1).cast("long").alias("idx"), (F.col("time_ms") / 1000.0).alias("t"))
