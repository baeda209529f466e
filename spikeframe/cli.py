"""Command line: info, export-spikes, to-nwb, from-nwb, psth, sort, import-phy."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import EPSILON
from .operators.analysis import analyse
from .operators.sorting import SortOptions, sort_channels, units
from .session import Session, SessionBuilder
from .sources.datasource import read_session
from .sources.nwb import read_nwb, write_nwb
from .sources.phy import read_phy, write_phy
from .sources.writers import export_spikes, export_spikes_to_file, write_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spikeframe", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        return c

    command("info", "file")
    command("export-spikes", "file", "variable").add_argument("--output")
    command("to-nwb", "file", "output")
    command("from-nwb", "file", "output")
    c = command("psth", "file", "neuron", "event")
    for name, default in (("--start", -0.5), ("--end", 1.0), ("--bin-width", 0.01)):
        c.add_argument(name, type=float, default=default)
    c = command("sort", "file", "continuous", "output")
    c.add_argument("--phy")
    c.add_argument("--threshold", type=float, default=4.0)
    c = command("import-phy", "folder", "output")
    c.add_argument("--rate", type=float, default=30_000.0)
    c.add_argument("--keep-noise", action="store_true")
    return p


def session_of(spark: SparkSession, trains, frequency: float, comment: str) -> Session:
    """Trains (var_name, t) as a session of neurons; for writing a file, which takes them through the driver anyway."""
    b = SessionBuilder(spark, frequency, comment)
    found = trains.groupBy("var_name").agg(F.sort_array(F.collect_list("t")).alias("t")).orderBy("var_name")
    for row in found.toLocalIterator():
        b.neuron(row["var_name"], row["t"])
    return b.build()


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("spikeframe").getOrCreate()
    if a.command == "info":
        row = read_session(spark, a.file).info().first()
        print(f"comment: {row['comment']}\nfrequency: {row['timestamp_frequency_hz']}\nbegin: {row['beg_seconds']}\nend: {row['end_seconds']}")
        print(f"neurons: {row['n_neuron']}\nevents: {row['n_event']}\ncontinuous: {row['n_continuous']}\nintervals: {row['n_interval']}")
    elif a.command == "export-spikes":
        s = read_session(spark, a.file, names=[a.variable])
        if a.output:
            export_spikes_to_file(s, a.variable, a.output)
        else:
            for row in export_spikes(s, a.variable).toLocalIterator():
                print(row["value"])
    elif a.command == "to-nwb":
        write_nwb(read_session(spark, a.file), a.output)
    elif a.command == "from-nwb":
        write_session(read_nwb(spark, a.file), a.output)
    elif a.command == "psth":
        found = analyse(read_session(spark, a.file, names=[a.neuron, a.event]), a.neuron, a.event, a.start, a.end, a.bin_width).psth
        rows = found.orderBy("bin").collect()
        print(f"events: {rows[0]['n_events'] if rows else 0}\nbins: {len(rows)}\ntotal: {sum(r['count'] for r in rows)}")
    elif a.command == "sort":
        s = read_session(spark, a.file, names=[a.continuous])
        signal = s.payload(a.continuous, "continuous")
        rate = signal.select("sampling_rate").first()[0]
        samples = signal.select("session_id", F.lit(0).alias("channel"), "first_sample", F.posexplode("values").alias("p", "value")).select("session_id", "channel", (F.col("first_sample") + F.col("p")).alias("pos"), "value")
        spikes = sort_channels(samples, SortOptions(sampling_rate=rate, threshold=a.threshold))
        if a.phy:
            write_phy(spikes, a.phy)
        write_session(session_of(spark, units(spikes, by=["session_id"]), max(rate, EPSILON), "sorted"), a.output)
        print(f"spikes: {spikes.count()}")
    else:
        trains = read_phy(spark, a.folder, a.rate, skip_noise=not a.keep_noise)
        write_session(session_of(spark, trains, a.rate, "imported"), a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
