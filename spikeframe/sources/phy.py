"""Spike-sorting folders: spike_times.npy and spike_clusters.npy."""

from __future__ import annotations

import io
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidValues


def load_npy(raw: bytes, kinds: tuple[str, ...]) -> np.ndarray:
    """A one-dimensional little-endian array of one of the given types."""
    a = np.load(io.BytesIO(raw), allow_pickle=False)
    if a.dtype.str not in kinds:
        raise InvalidValues(f"type {a.dtype.str} is none of {', '.join(kinds)}")
    return a.reshape(-1)


def read_phy(spark: SparkSession, folder: str, rate: float = 30_000.0, prefix: str = "unit_", skip_noise: bool = True) -> DataFrame:
    """(session_id, var_name, idx, t) of a folder, or of all that a glob finds; each folder is one session."""

    def rows(name: str, value: str, kinds: tuple[str, ...], cast) -> DataFrame:
        files = spark.read.format("binaryFile").load(f"{folder}/{name}.npy").select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("session_id"), "content")

        def decode(batches):
            for pdf in batches:
                for sid, raw in zip(pdf["session_id"], pdf["content"]):
                    a = load_npy(raw, kinds)
                    for lo in range(0, max(len(a), 1), 100_000):
                        part = a[lo : lo + 100_000]
                        yield pd.DataFrame({"session_id": sid, "row": np.arange(lo, lo + len(part)), "n": len(a), value: part.astype(cast)})

        return files.mapInPandas(decode, f"session_id string, row long, n long, {value} {'double' if cast is np.float64 else 'int'}")

    times = rows("spike_times", "sample", ("<f8", "<f4", "<i8", "<i4"), np.float64)
    clusters = rows("spike_clusters", "cluster", ("<i4",), np.int32).withColumnRenamed("n", "m")
    both = times.join(clusters, ["session_id", "row"], "full_outer")
    if both.where("n IS NULL OR m IS NULL OR n <> m").limit(1).count():
        raise InvalidValues("spike times and clusters differ in number")
    return cluster_points(both.select("session_id", "sample", "cluster"), rate, prefix, skip_noise)


def cluster_points(spikes: DataFrame, rate: float, prefix: str = "unit_", skip_noise: bool = True, session_id: str | None = None) -> DataFrame:
    """Spikes (sample, cluster) as neurons: one train for each cluster, cluster 0 left out as noise."""
    if session_id is not None:
        spikes = spikes.withColumn("session_id", F.lit(session_id))
    if skip_noise:
        spikes = spikes.where("cluster <> 0")
    train = Window.partitionBy("session_id", "cluster").orderBy("sample")
    return spikes.select("session_id", F.concat(F.lit(prefix), F.col("cluster").cast("string")).alias("var_name"), (F.row_number().over(train) - 1).cast("long").alias("idx"), (F.col("sample") / F.lit(rate)).alias("t"))


def write_phy(spikes: DataFrame, folder: str, sample: str = "sample", unit: str = "unit") -> None:
    """One session's spikes in the order of their samples; the folder's two files are written by one task's worth of rows."""
    rows = spikes.select(F.col(sample).cast("double").alias("s"), F.col(unit).cast("int").alias("u")).orderBy("s")
    table = rows.toArrow()
    Path(folder).mkdir(parents=True, exist_ok=True)
    np.save(Path(folder) / "spike_times.npy", table.column("s").to_numpy().astype("<f8"))
    np.save(Path(folder) / "spike_clusters.npy", table.column("u").to_numpy().astype("<i4"))
