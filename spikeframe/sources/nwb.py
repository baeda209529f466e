"""Neurodata Without Borders files, where h5py is installed."""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

from ..errors import SessionError
from ..session import Session, SessionBuilder

# Fixed: how parts of variables are named in a file's acquisition group.
START, END, TIMES, FIELD, SAMPLES = "__start", "__end", "__ts", "__field__", "__samples"


def _h5py():
    try:
        import h5py
    except ImportError as e:
        raise SessionError("NWB files need h5py, which is not installed") from e
    return h5py


def sanitize(name: str) -> str:
    return name.strip().replace("/", "_") or "unnamed"


def looks_like_event(values: np.ndarray) -> bool:
    return bool(np.all(np.abs(np.asarray(values, np.float64) - 1.0) < 1e-9))


def estimate_rate(times: np.ndarray) -> float:
    return 1.0 / float(times[1] - times[0]) if len(times) > 1 and times[1] > times[0] else 1.0


def write_nwb(s: Session, path: str, identifier: str = "session") -> None:
    """One session; population vectors, and all but the first start of a fragmented signal, have no place in the file."""
    h5py = _h5py()
    with h5py.File(path, "w") as f:
        head = s.sessions.first()
        f.attrs["nwb_version"] = "2.7.0"
        f["identifier"], f["session_description"] = identifier, head["comment"] or ""
        f.attrs["timestamp_frequency_hz"] = head["timestamp_frequency_hz"]
        acquisition, index, times, names = f.create_group("acquisition"), [], [], []
        for name in s.names("neuron"):
            t = [r["t"] for r in s.payload(name, "neuron").orderBy("idx").collect()]
            times += t
            index.append(len(times))
            names.append(name)
        if names:
            u = f.create_group("units")
            u["spike_times"], u["spike_times_index"], u["id"] = np.array(times), np.array(index), np.arange(len(names))
            u["unit_name"] = np.array(names, dtype=h5py.string_dtype())

        def series(name: str, t, data) -> None:
            g = acquisition.create_group(sanitize(name))
            g.attrs["name"] = name
            g["timestamps"], g["data"] = np.asarray(t), np.asarray(data)

        for name in s.names("event"):
            t = [r["t"] for r in s.payload(name, "event").orderBy("idx").collect()]
            if t:
                series(name, t, np.ones(len(t)))
        for name in s.names("interval"):
            rows = s.payload(name, "interval").orderBy("idx").collect()
            series(name + START, [r["t_start"] for r in rows], np.ones(len(rows)))
            series(name + END, [r["t_end"] for r in rows], np.ones(len(rows)))
        for name in s.names("marker"):
            rows = s.payload(name, "marker").orderBy("field_index", "idx").collect()
            fields: dict[tuple[int, str], list] = {}
            for r in rows:
                fields.setdefault((r["field_index"], r["field_name"]), []).append(r)
            first = next(iter(fields.values()), [])
            series(name + TIMES, [r["t"] for r in first], np.ones(len(first)))
            for (i, label), cells in fields.items():
                text = cells[0]["str"] is not None
                data = np.array([r["str"] if text else r["num"] for r in cells], dtype=h5py.string_dtype() if text else np.int64)
                g = acquisition.create_group(sanitize(f"{name}{FIELD}{i}"))
                g.attrs["name"], g.attrs["field"] = f"{name}{FIELD}{i}", label
                g["data"] = data
        rates = {r["var_name"]: r["sampling_rate"] for r in s.variables.where("kind = 'waveform'").collect()}
        for name in s.names("waveform"):
            rows = s.payload(name, "waveform").orderBy("idx").collect()
            series(name + TIMES, [r["t"] for r in rows], np.ones(len(rows)))
            g = acquisition.create_group(sanitize(name + SAMPLES))
            g.attrs["name"], g.attrs["rate"] = name + SAMPLES, rates[name]
            g["data"] = np.array([r["samples"] for r in rows], np.float32)
        for name in s.names("continuous"):
            rows = s.payload(name, "continuous").orderBy("first_sample").collect()
            if rows:
                g = acquisition.create_group(sanitize(name))
                g.attrs["name"], g.attrs["rate"], g.attrs["starting_time"] = name, rows[0]["sampling_rate"], rows[0]["t0"]
                g["data"] = np.array([x for r in rows for x in r["values"]])


def read_nwb(spark: SparkSession, path: str, frequency: float = 100_000.0) -> Session:
    """Units as neurons; series of ones as events, start and end pairs as intervals, others as continuous signals."""
    h5py = _h5py()
    with h5py.File(path, "r") as f:
        b = SessionBuilder(spark, float(f.attrs.get("timestamp_frequency_hz", frequency)), f["session_description"][()].decode() if "session_description" in f else "", session_id=Path(path).stem)
        if "units" in f:
            u = f["units"]
            cuts = [0, *np.asarray(u["spike_times_index"]).tolist()]
            names = [n.decode() for n in u["unit_name"]] if "unit_name" in u else [f"unit_{i}" for i in range(len(cuts) - 1)]
            for n, lo, hi in zip(names, cuts, cuts[1:]):
                b.neuron(n, np.asarray(u["spike_times"][lo:hi]).tolist())
        ends, times, fields, waves = {}, {}, {}, {}
        for key, g in f.get("acquisition", {}).items():
            name = g.attrs.get("name", key)
            if name.endswith(TIMES):
                times[name.removesuffix(TIMES)] = np.asarray(g["timestamps"]).tolist()
            elif FIELD in name:
                base, i = name.rsplit(FIELD, 1)
                data = [x.decode() if isinstance(x, bytes) else int(x) for x in g["data"][()]]
                fields.setdefault(base, {})[int(i)] = (g.attrs["field"], data)
            elif name.endswith(SAMPLES):
                waves[name.removesuffix(SAMPLES)] = (float(g.attrs["rate"]), np.asarray(g["data"]).tolist())
            elif name.endswith(START) or name.endswith(END):
                base = name.removesuffix(START).removesuffix(END)
                ends.setdefault(base, {})[name[len(base) :]] = np.asarray(g["timestamps"]).tolist()
            elif "timestamps" in g and looks_like_event(g["data"]):
                b.event(name, np.asarray(g["timestamps"]).tolist())
            else:
                rate = float(g.attrs.get("rate", 0)) or estimate_rate(np.asarray(g["timestamps"]))
                start = float(g.attrs.get("starting_time", g["timestamps"][0] if "timestamps" in g else 0.0))
                b.continuous(name, rate, start, np.asarray(g["data"]).tolist())
        for base, x in ends.items():
            if START in x and END in x:
                b.interval(base, list(zip(x[START], x[END])))
        for base, t in times.items():
            if base in waves:
                b.waveform(base, waves[base][0], t, waves[base][1])
            else:
                b.marker(base, t, {label: cells for _, (label, cells) in sorted(fields.get(base, {}).items())})
        return b.build()
