"""Sinks: session files, text exports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import IncompleteRead, InvalidFrequency
from ..session import Session, all_timestamps, maximum_timestamps
from .codec import TABLE_OF, WriteOptions, assemble, encode_variable, tick_type_of

PAYLOAD_COLUMNS = {
    "points": ("idx", "t"), "intervals": ("idx", "t_start", "t_end"), "markers": ("idx", "t", "field_index", "field_name", "num", "str"),
    "waveforms": ("idx", "t", "samples"), "continuous": ("fragment", "t0", "first_sample", "values"), "population": ("idx", "weight"),
}


def encode_files(s: Session, options: WriteOptions | None = None) -> DataFrame:
    """(session_id, content): the bytes of each session's file.

    Every variable is encoded by a task of its own from Arrow columns; a file is put together by one task, as it is one value.
    """
    o, key = options or WriteOptions(), ["session_id", "var_name"]
    ends = maximum_timestamps(s).groupBy("session_id").agg(F.max("max_t").alias("last"))
    head = F.to_json(F.struct("comment", "timestamp_frequency_hz", "beg_seconds"))
    sessions = s.sessions.join(ends, "session_id", "left").select("session_id", head.alias("head"), F.coalesce("last", F.lit(0.0)).alias("last"))
    fields = F.to_json(F.struct(*[c for c in s.variables.columns if c != "session_id"]))
    variables = s.variables.join(sessions, "session_id").select(*key, "kind", fields.alias("variable"), "head", "last")

    def encode(rows: pa.Table, about: pa.Table) -> pa.Table:
        found = about.to_pylist()
        if not found:
            return pa.table({"session_id": pa.array([], pa.string()), "var_index": pa.array([], pa.int32()), "variable": pa.array([], pa.string()), "body": pa.array([], pa.binary())})
        v, f = json.loads(found[0]["variable"]), float(json.loads(found[0]["head"])["timestamp_frequency_hz"])
        if not f > 0:
            raise InvalidFrequency(str(f))
        done, body = encode_variable(v, _arrays(v, rows), f, tick_type_of(found[0]["last"], f, o.layout), o.layout)
        return pa.table({"session_id": [found[0]["session_id"]], "var_index": pa.array([v["var_index"]], pa.int32()), "variable": [json.dumps(done)], "body": pa.array([body], pa.binary())})

    bodies = None
    for table, columns in PAYLOAD_COLUMNS.items():
        rows = getattr(s, table).select(*key, *columns).groupBy(*key)
        mine = variables.where(F.col("kind").isin([k for k, t in TABLE_OF.items() if t == table])).groupBy(*key)
        made = rows.cogroup(mine).applyInArrow(encode, "session_id string, var_index int, variable string, body binary")
        bodies = made if bodies is None else bodies.unionByName(made)

    def put_together(encoded: pa.Table, about: pa.Table) -> pa.Table:
        if not about.num_rows:
            return pa.table({"session_id": pa.array([], pa.string()), "content": pa.array([], pa.binary())})
        top, rows = about.to_pylist()[0], encoded.sort_by("var_index").to_pylist()
        content = assemble(json.loads(top["head"]), top["last"], [(json.loads(r["variable"]), r["body"]) for r in rows], o)
        return pa.table({"session_id": [top["session_id"]], "content": pa.array([content], pa.binary())})

    return bodies.groupBy("session_id").cogroup(sessions.groupBy("session_id")).applyInArrow(put_together, "session_id string, content binary")


def _complete(v: dict, found: int, said: int | None) -> None:
    """A header without a number says nothing."""
    if said and found != said:
        raise IncompleteRead(f"{v['var_name']}: {found} of {said} rows; load the whole variable before writing")


def _arrays(v: dict, rows: pa.Table) -> dict:
    kind = v["kind"]
    column = lambda name: rows.column(name).to_numpy().astype(np.float64)
    if kind == "continuous":
        rows = rows.sort_by("first_sample")
        fragment = rows.column("fragment").to_numpy()
        new = np.flatnonzero(np.concatenate([np.ones(min(len(fragment), 1), bool), fragment[1:] != fragment[:-1]]))
        values = rows.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64) if len(fragment) else np.zeros(0)
        _complete(v, len(new), v.get("count"))
        _complete(v, len(values), v.get("n_points_wave"))
        return {"t": column("t0")[new], "first": rows.column("first_sample").to_numpy()[new].astype(np.int64), "values": values}
    if kind == "marker":
        rows = rows.sort_by([("field_index", "ascending"), ("idx", "ascending")])
        field, names = rows.column("field_index").to_numpy(), rows.column("field_name")
        cells = [a if a is not None else b for a, b in zip(rows.column("num").to_pylist(), rows.column("str").to_pylist())]
        cuts = [*np.flatnonzero(np.concatenate([np.ones(min(len(field), 1), bool), field[1:] != field[:-1]])).tolist(), len(field)]
        for a, b in zip(cuts, cuts[1:]):
            _complete(v, b - a, v.get("count"))
        t = column("t")[: cuts[1]] if len(cuts) > 1 else np.zeros(0)
        return {"t": t, "fields": [(names[a].as_py(), cells[a:b]) for a, b in zip(cuts, cuts[1:])]}
    rows = rows.sort_by("idx")
    _complete(v, rows.num_rows, v.get("count"))
    if kind == "interval":
        return {"t_start": column("t_start"), "t_end": column("t_end")}
    if kind == "population":
        return {"weight": column("weight")}
    if kind == "waveform":
        samples = rows.column("samples").combine_chunks().flatten().to_numpy(zero_copy_only=False) if rows.num_rows else np.zeros(0)
        return {"t": column("t"), "samples": samples.astype(np.float32).reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((0, 0), np.float32)}
    return {"t": column("t")}


def write_session(s: Session, path: str, options: WriteOptions | None = None) -> None:
    """One session to one file."""
    rows = encode_files(s, options).collect()
    if len(rows) != 1:
        raise ValueError(f"{len(rows)} sessions for one file")
    Path(path).write_bytes(bytes(rows[0]["content"]))


def write_sessions(s: Session, folder: str, suffix: str, options: WriteOptions | None = None) -> DataFrame:
    """(session_id, path, bytes): each session to a file of its own in a folder that all executors share.

    A file has the last part of the session's id as its name, with a digest of the id where several share that.
    """

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            paths = [str(Path(folder) / (Path(sid).stem + ("" if alone else "-" + hashlib.md5(sid.encode()).hexdigest()[:12]) + suffix)) for sid, alone in zip(pdf["session_id"], pdf["alone"])]
            for p, raw in zip(paths, pdf["content"]):
                Path(p).parent.mkdir(parents=True, exist_ok=True)
                Path(p).write_bytes(bytes(raw))
            yield pd.DataFrame({"session_id": pdf["session_id"], "path": paths, "bytes": [len(x) for x in pdf["content"]]})

    stem = F.regexp_replace(F.regexp_extract("session_id", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    names = s.sessions.select("session_id", stem.alias("stem"))
    alone = names.groupBy("stem").agg(F.count("*").alias("n"))
    files = encode_files(s, options).join(names.join(alone, "stem").select("session_id", (F.col("n") == 1).alias("alone")), "session_id")
    return files.mapInPandas(put, "session_id string, path string, bytes long")


def format_seconds(t: float) -> str:
    """Shortest digits that give the number back, without exponent; whole numbers without a point."""
    text = np.format_float_positional(t, unique=True, trim="-")
    return text if np.isfinite(t) else str(t)


def export_spikes(s: Session, name: str, header: bool = True, comment: bool = False) -> DataFrame:
    """(value): the lines of a text file of one variable's times, in order."""
    rows = s.timestamps(name)
    as_text = F.udf(format_seconds, "string", useArrow=True)
    lines = rows.select("idx", as_text("t").alias("value"))
    if header:
        top = rows.sparkSession.range(1).select(F.lit(-1).cast("long").alias("idx"), F.lit("# timestamp_sec" if comment else "timestamp_sec").alias("value"))
        lines = top.unionByName(lines)
    return lines.orderBy("idx").select("value")


def export_spikes_to_file(s: Session, name: str, path: str, **options) -> None:
    with open(path, "w", encoding="utf-8") as f:
        for row in export_spikes(s, name, **options).toLocalIterator():
            f.write(row["value"] + "\n")


def all_spikes(s: Session) -> DataFrame:
    return all_timestamps(s).where(F.col("kind").isin("neuron", "event"))
