"""Session files written by many tasks: counts first give every row its place, then each task writes its own byte ranges.

1. `measured`: what a header needs of each variable (rows, samples, cell sizes, range of values), by partial aggregation.
2. `laid_out`: headers, places and metadata, one small group a session; payloads do not pass through it.
3. `byte_ranges`: rows dealt by (session, variable, number of rows) into parts; a part becomes the bytes at its place.
4. `RangeWriter`: tasks write the ranges into a file beside the last one; it takes the name when all its bytes are there.

A range has the same bytes and place whoever writes it, so a task that runs twice does no harm. Needs a folder that all executors share.
"""

from __future__ import annotations

import glob
import json
import os
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..errors import IncompleteRead, InvalidFrequency, InvalidValues
from ..schema import KINDS
from ..session import Session, maximum_timestamps
from ..storage import checkpointed
from .codec import DEFAULTS, FIELD_NAME_BYTES, LEAST_CELL, TABLE_OF, VARIABLE_VERSION, WriteOptions, cell_text, frame, padded, payload_size, raw_samples, scaling_of, tick_type_of, to_ticks

KEY = ["session_id", "var_name"]
#: Rows of one variable in a part; of samples, values.
ROWS, SAMPLES = 1 << 16, 1 << 16
#: Variables, or sessions, whose layout or name is told to all tasks; of more, rows are shuffled to them.
MOST_TOLD = 1 << 16
RANGES = "session_id string, at long, raw binary"
_LAYOUT = RANGES + ", var_name string, kind string, count long, tick_bytes int, frequency double, cont_data_type int, scale double, shift double, n_points_wave long, marker_length int, as_number boolean"
_MEASURES = {"rows": "long", "samples": "long", "least": "long", "top": "double", "fits": "boolean", "fields": "array<struct<field_index:int,n:long,name:string,least:long,most:long,length:int,numbers:long>>"}


def _steps(values: Column) -> Column:
    """Whether all values stand on the variable's own 16-bit steps."""
    def one(x: Column) -> Column:
        x = x.cast("double")
        y = (x - F.col("mv_offset")) / F.col("ad_to_mv")
        step = F.when(y >= 0, F.floor(y + 0.5)).otherwise(F.ceil(y - 0.5)).cast("double")
        return (F.abs(y) < 32767.5) & (F.abs(step * F.col("ad_to_mv") + F.col("mv_offset") - x) <= F.abs("ad_to_mv") * 1e-3 + F.abs(x) * 1e-6)

    return F.when((F.col("cont_data_type") == 0) & (F.col("ad_to_mv") != 0), F.forall(values, one)).otherwise(False)


def measured(s: Session) -> DataFrame:
    """(session_id, var_name, rows, samples, least, top, fits, fields) of each variable that has rows."""
    count, largest = F.count("*").alias("rows"), lambda c: F.max(F.array_max(F.transform(c, lambda x: F.abs(x.cast("double"))))).alias("top")
    scales = s.variables.select(*KEY, "cont_data_type", "ad_to_mv", "mv_offset")
    plain = [t.groupBy(*KEY).agg(count, F.min("idx").alias("least"), F.max("idx").alias("most")) for t in (s.points, s.intervals, s.population)]
    waves = s.waveforms.join(scales, KEY).groupBy(*KEY).agg(
        count, F.min("idx").alias("least"), F.max("idx").alias("most"), F.max(F.size("samples")).cast("long").alias("samples"), F.min(F.size("samples")).alias("shortest"), largest("samples"), F.bool_and(_steps(F.col("samples"))).alias("fits"))
    waves = waves.withColumn("samples", F.when(F.col("shortest") == F.col("samples"), F.col("samples")).otherwise(F.raise_error(F.lit("waveforms of one variable differ in length")).cast("long")))
    pieces = s.continuous.join(scales, KEY).groupBy(*KEY, "fragment").agg(F.sum(F.size("values")).alias("samples"), largest("values"), F.bool_and(_steps(F.col("values"))).alias("fits"))
    signals = pieces.groupBy(*KEY).agg(count, F.min("fragment").cast("long").alias("least"), F.max("fragment").cast("long").alias("most"), F.sum("samples").alias("samples"), F.max("top").alias("top"), F.bool_and("fits").alias("fits"))
    length = F.when(F.col("num").isNotNull(), F.greatest(F.lit(5), F.length(F.col("num").cast("string")))).otherwise(F.octet_length(F.coalesce("str", F.lit(""))))
    field = s.markers.groupBy(*KEY, "field_index").agg(count, F.min("field_name").alias("name"), F.min("idx").alias("least"), F.max("idx").alias("most"), F.max(length).cast("int").alias("length"), F.count("num").alias("numbers"))
    as_field = F.struct("field_index", F.col("rows").alias("n"), "name", "least", "most", "length", "numbers")
    markers = field.groupBy(*KEY).agg(F.max("rows").alias("rows"), F.min("least").alias("least"), F.max("most").alias("most"), F.sort_array(F.collect_list(as_field)).alias("fields"))  # one row a field
    parts = []
    for df in (*plain, waves, signals, markers):
        # numbers of rows must be those from 0 on, as they are places in the file
        dense = F.when((F.col("least") == 0) & (F.col("most") == F.col("rows") - 1), 0).otherwise(1).cast("long").alias("least")
        parts.append(df.select(*KEY, *(dense if c == "least" else (F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in _MEASURES.items())))
    every = parts[0]
    for df in parts[1:]:
        every = every.unionByName(df)
    return every


def laid_out(s: Session, o: WriteOptions) -> DataFrame:
    """A session's headers, field names and metadata as ranges, and for each variable a row without bytes: its place and how its rows are written.

    A range without bytes and without a variable stands at the end of the file.
    """
    ends = maximum_timestamps(s).groupBy("session_id").agg(F.max("max_t").alias("last"))
    head = F.to_json(F.struct("comment", "timestamp_frequency_hz", "beg_seconds")).alias("head")
    sessions = s.sessions.join(ends, "session_id", "left").select("session_id", head, F.coalesce("last", F.lit(0.0)).alias("last"))
    fields = F.to_json(F.struct(*[c for c in s.variables.columns if c != "session_id"])).alias("variable")
    facts = measured(s).select(*KEY, F.to_json(F.struct(*_MEASURES)).alias("facts"))
    variables = s.variables.select(*KEY, fields).join(facts, KEY, "left").select("session_id", "variable", "facts")
    schema = pa.schema([("session_id", pa.string()), ("at", pa.int64()), ("raw", pa.binary()), ("var_name", pa.string()), ("kind", pa.string()), ("count", pa.int64()), ("tick_bytes", pa.int32()), ("frequency", pa.float64()), ("cont_data_type", pa.int32()),
                        ("scale", pa.float64()), ("shift", pa.float64()), ("n_points_wave", pa.int64()), ("marker_length", pa.int32()), ("as_number", pa.bool_())])

    def lay(about: pa.Table, rows: pa.Table) -> pa.Table:
        if not about.num_rows:
            return schema.empty_table()
        top, out, done = about.to_pylist()[0], [], []
        session, sid = json.loads(top["head"]), top["session_id"]
        f = float(session["timestamp_frequency_hz"])
        if not f > 0:
            raise InvalidFrequency(str(f))
        tick_type = tick_type_of(top["last"], f, o.layout)
        found = [(json.loads(r["variable"]), json.loads(r["facts"] or "{}")) for r in rows.to_pylist()]
        for v, m in sorted(found, key=lambda x: x[0]["var_index"]):
            done.append(_header(v, m, tick_type, o.layout))
        head, places, meta, end = frame(session, top["last"], [(v, payload_size(v)) for v in done], o)
        for v, at in zip(done, places):
            out.append({"at": at, "var_name": v["var_name"], "kind": v["kind"], "count": v["count"], "tick_bytes": np.dtype(tick_type).itemsize, "frequency": f, "cont_data_type": v["cont_data_type"], "scale": v["ad_to_mv"], "shift": v["mv_offset"],
                        "n_points_wave": v["n_points_wave"], "marker_length": v["marker_length"], "as_number": bool(v["marker_data_type"])})
            if v["kind"] == "marker" and v["count"]:
                at += v["count"] * np.dtype(tick_type).itemsize
                for name in v["fields"]:
                    out.append({"at": at, "raw": padded(name, FIELD_NAME_BYTES)})
                    at += FIELD_NAME_BYTES + v["count"] * (4 if v["marker_data_type"] else v["marker_length"])
        out += [{"at": 0, "raw": head}, {"at": end + len(meta), "raw": b""}, *([{"at": end, "raw": meta}] if meta else [])]
        return pa.Table.from_pylist([{"session_id": sid} | r for r in out], schema)

    return sessions.groupBy("session_id").cogroup(variables.groupBy("session_id")).applyInArrow(lay, _LAYOUT)


def _header(v: dict, m: dict, tick_type: str, layout: str) -> dict:
    """A variable's header fields by its row and its measures."""
    said, kind, name = v.get("count"), v["kind"], v["var_name"]
    v = DEFAULTS | {k: x for k, x in v.items() if x is not None}
    if not name:
        raise InvalidValues("a variable needs a name")
    rows, fields = m.get("rows") or 0, m.get("fields") or []
    n_samples = m.get("samples") or 0
    short = said and rows != said or kind == "continuous" and v["n_points_wave"] and n_samples != v["n_points_wave"] or any(x["n"] != rows for x in fields)
    if short or m.get("least") or [x["field_index"] for x in fields] != list(range(len(fields))):
        raise IncompleteRead(f"{name}: {rows} of {said} rows; rows are numbered from 0 and all there before writing")
    v |= {"count": rows, "var_type": KINDS[kind], "version": VARIABLE_VERSION[layout], "ts_data_type": int(tick_type == "<i8"), "cont_frag_index_type": 0}
    if kind in ("waveform", "continuous"):
        kept, scale, shift = scaling_of(v, n_samples, bool(m.get("fits")), m.get("top") if m.get("top") is not None else 0.0, layout)
        v |= {"cont_data_type": kept, "ad_to_mv": scale, "mv_offset": shift, "n_points_wave": n_samples if rows or kind == "continuous" else v["n_points_wave"]}
    if kind == "marker":
        numbers, cells = sum(x["numbers"] for x in fields), rows * len(fields)
        if 0 < numbers < cells:
            raise InvalidValues(f"{name}: numbers and texts together")
        as_number = numbers == cells and layout == "wide"
        length = LEAST_CELL if as_number else max([LEAST_CELL, *(x["length"] + 1 for x in fields)])
        v |= {"n_markers": len(fields), "marker_length": length, "marker_data_type": int(as_number), "fields": [x["name"] or "" for x in fields]}
    return v


def _ranges_of(encode: Callable[[pa.Table, dict], list[tuple[int, bytes]]], order: str) -> Callable[[pa.Table], pa.Table]:
    def part(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(order)
        v = {c: rows.column(c)[0].as_py() for c in ("session_id", "at", "count", "tick_bytes", "frequency", "cont_data_type", "scale", "shift", "n_points_wave", "marker_length", "as_number")}
        found = encode(rows, v)
        return pa.table({"session_id": pa.array([v["session_id"]] * len(found), pa.string()), "at": pa.array([a for a, _ in found], pa.int64()), "raw": pa.array([b for _, b in found], pa.binary())})

    return part


def _column(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy().astype(np.float64)


def _ticks(rows: pa.Table, name: str, v: dict) -> bytes:
    return to_ticks(_column(rows, name), v["frequency"], f"<i{v['tick_bytes']}").tobytes()


def _flat(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def _first(rows: pa.Table, name: str = "idx") -> int:
    """The number of a part's first row; the part holds all rows from it on."""
    at = rows.column(name).to_numpy()
    if (np.diff(at) != 1).any():
        raise IncompleteRead(f"rows {int(at[0])} to {int(at[-1])} are not all there, or stand twice")
    return int(at[0])


def _points(rows: pa.Table, v: dict) -> list[tuple[int, bytes]]:
    return [(v["at"] + _first(rows) * v["tick_bytes"], _ticks(rows, "t", v))]


def _intervals(rows: pa.Table, v: dict) -> list[tuple[int, bytes]]:
    at, tick = v["at"] + _first(rows) * v["tick_bytes"], v["tick_bytes"]
    return [(at, _ticks(rows, "t_start", v)), (at + v["count"] * tick, _ticks(rows, "t_end", v))]


def _weights(rows: pa.Table, v: dict) -> list[tuple[int, bytes]]:
    return [(v["at"] + 8 * _first(rows), _column(rows, "weight").astype("<f8").tobytes())]


def _sample_bytes(v: dict) -> int:
    return 4 if v["cont_data_type"] else 2


def _waves(rows: pa.Table, v: dict) -> list[tuple[int, bytes]]:
    lo, tick = _first(rows), v["tick_bytes"]
    raw = raw_samples(_flat(rows, "samples"), v["cont_data_type"], v["scale"], v["shift"])
    return [(v["at"] + lo * tick, _ticks(rows, "t", v)), (v["at"] + v["count"] * tick + lo * v["n_points_wave"] * _sample_bytes(v), raw.tobytes())]


def _fragments(rows: pa.Table, v: dict) -> list[tuple[int, bytes]]:
    lo, tick = _first(rows, "fragment"), v["tick_bytes"]
    return [(v["at"] + lo * tick, _ticks(rows, "t0", v)), (v["at"] + v["count"] * tick + 4 * lo, rows.column("first_sample").to_numpy().astype("<u4").tobytes())]


def _samples(rows: pa.Table, v: dict) -> list[tuple[int, bytes]]:
    raw = raw_samples(_flat(rows, "values"), v["cont_data_type"], v["scale"], v["shift"]).tobytes()
    first, size = rows.column("first_sample").to_numpy(), _sample_bytes(v)
    if (np.diff(first) != rows.column("n").to_numpy()[:-1]).any():
        raise IncompleteRead(f"samples from {int(first[0])} on are not all there, or stand twice")
    return [(v["at"] + v["count"] * (v["tick_bytes"] + 4) + int(first[0]) * size, raw)]


def _cells(rows: pa.Table, v: dict) -> list[tuple[int, bytes]]:
    lo, n, tick = _first(rows), v["count"], v["tick_bytes"]
    field, size = rows.column("field_index")[0].as_py(), 4 if v["as_number"] else v["marker_length"]
    numbers, texts = rows.column("num").to_pylist(), rows.column("str").to_pylist()
    raw = np.array(numbers, "<u4").tobytes() if v["as_number"] else b"".join(padded(cell_text(a) if a is not None else b or "", size) for a, b in zip(numbers, texts))
    ticks = [(v["at"] + lo * tick, _ticks(rows, "t", v))] if field == 0 else []
    return [*ticks, (v["at"] + n * tick + field * (FIELD_NAME_BYTES + n * size) + FIELD_NAME_BYTES + lo * size, raw)]


def _told(rows: DataFrame) -> DataFrame:
    """A written table of a row a variable or session, for a join: one session's rows must not all go to one task for it."""
    return rows if rows.count() > MOST_TOLD else F.broadcast(rows)


def byte_ranges(s: Session, options: WriteOptions | None = None, rows: int = ROWS, samples: int = SAMPLES) -> DataFrame:
    """(session_id, at, raw): all bytes of each session's file as ranges that neither overlap nor leave gaps; one empty range at its end.

    Rows are numbered from 0 within their variable (fragments and marker fields too), else an IncompleteRead is raised; an empty
    variable has a header only, a session without variables a header only. Of a part, `rows` rows are in memory (waveforms: as many
    as make `samples` values, signals: `samples` values and one row more).
    """
    o = options or WriteOptions()
    plan = checkpointed(laid_out(s, o))  # one row a variable, asked for by each table
    how = _told(plan.where("var_name IS NOT NULL").drop("raw", "kind"))
    present = {TABLE_OF[r["kind"]] for r in plan.where("kind IS NOT NULL").select("kind").distinct().collect()}  # kinds, seven at most
    wave_rows = F.greatest(F.lit(1), F.floor(samples / F.greatest(F.col("n_points_wave"), F.lit(1))))
    fragments = s.continuous.groupBy(*KEY, "fragment").agg(F.min_by("t0", "first_sample").alias("t0"), F.min("first_sample").alias("first_sample"))
    made = [plan.where("var_name IS NULL").select("session_id", "at", "raw")]
    for name, table, columns, part, order, encode in (
        ("points", s.points, ["idx", "t"], F.floor(F.col("idx") / rows), "idx", _points),
        ("intervals", s.intervals, ["idx", "t_start", "t_end"], F.floor(F.col("idx") / rows), "idx", _intervals),
        ("population", s.population, ["idx", "weight"], F.floor(F.col("idx") / rows), "idx", _weights),
        ("waveforms", s.waveforms, ["idx", "t", "samples"], F.floor(F.col("idx") / wave_rows), "idx", _waves),
        ("continuous", fragments, ["fragment", "t0", "first_sample"], F.floor(F.col("fragment") / rows), "fragment", _fragments),
        ("continuous", s.continuous, ["first_sample", "values", F.size("values").alias("n")], F.floor(F.col("first_sample") / samples), "first_sample", _samples),
        ("markers", s.markers, ["idx", "t", "field_index", "num", "str"], F.struct("field_index", F.floor(F.col("idx") / rows)), "idx", _cells),
    ):
        if name not in present:
            continue
        mine = table.select(*KEY, *columns).join(how, KEY).groupBy(*KEY, part.alias("part"))
        made.append(mine.applyInArrow(_ranges_of(encode, order), RANGES))
    every = made[0]
    for df in made[1:]:
        every = every.unionByName(df)
    return every


@dataclass
class Written(WriterCommitMessage):
    """Of each file: bytes written by a task, and its end where the task had it."""

    bytes: dict[str, int]
    ends: dict[str, int]


class RangeWriter(DataSourceArrowWriter):
    """Rows (path, at, raw) into files; a file takes its name when all its bytes are there, all files together at the end of the job."""

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.token = folder, overwrite, uuid.uuid4().hex

    def _beside(self, path: str) -> str:
        return f"{path}.{self.token}.part"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done, ends = Counter(), {}
        for batch in iterator:
            by_path: dict[str, list[int]] = {}
            for i, path in enumerate(batch.column("path").to_pylist()):
                by_path.setdefault(path, []).append(i)
            for path, mine in by_path.items():
                os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
                fd = os.open(self._beside(path), os.O_WRONLY | os.O_CREAT, 0o644)
                try:
                    for i in mine:
                        at, raw = batch.column("at")[i].as_py(), memoryview(batch.column("raw")[i].as_buffer())
                        if not len(raw):
                            ends[path] = at
                        done[path] += len(raw)
                        while len(raw):
                            n = os.pwrite(fd, raw, at)
                            raw, at = raw[n:], at + n
                    os.fsync(fd)
                finally:
                    os.close(fd)
        return Written(dict(done), ends)

    def commit(self, messages: list[Written | None]) -> None:
        done, ends = Counter(), {}
        for m in messages:
            if m is not None:
                done.update(m.bytes)
                ends |= m.ends
        for path, n in done.items():
            if ends.get(path) != n or os.path.getsize(self._beside(path)) != n:
                self._clear()
                raise IncompleteRead(f"{path}: {n} of {ends.get(path)} bytes")
            if not self.overwrite and os.path.exists(path):
                self._clear()
                raise FileExistsError(path)
        for path in done:
            os.replace(self._beside(path), path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        for name in glob.glob(f"{glob.escape(self.folder)}/*.{self.token}.part"):
            os.remove(name)


class RangeSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "spikeranges"

    def writer(self, schema, overwrite: bool) -> RangeWriter:
        return RangeWriter(self.options["folder"], overwrite)


def file_names(s: Session, folder: str, suffix: str) -> DataFrame:
    """(session_id, path): the last part of the session's id in `folder`, with a digest of the id where several share that."""
    stem = F.regexp_replace(F.regexp_extract("session_id", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    names = s.sessions.select("session_id", stem.alias("stem"))
    shared = names.groupBy("stem").agg((F.count("*") > 1).alias("shared"))
    digest = F.when(F.col("shared"), F.concat(F.lit("-"), F.substring(F.md5("session_id"), 1, 12))).otherwise("")
    return names.join(shared, "stem").select("session_id", F.concat(F.lit(folder.rstrip("/") + "/"), "stem", digest, F.lit(suffix)).alias("path"))


def write_files(s: Session, folder: str, suffix: str, options: WriteOptions | None = None, overwrite: bool = True, **parts: int) -> None:
    """Each session to a file of its own, by all tasks at once; the names are those of `write_sessions`.

    The driver gets, from each task, a number for each file that the task wrote into.
    """
    spark = s.sessions.sparkSession
    spark.dataSource.register(RangeSink)
    rows = byte_ranges(s, options, **parts).join(_told(checkpointed(file_names(s, folder, suffix))), "session_id").select("path", "at", "raw")
    rows.write.format("spikeranges").option("folder", folder.rstrip("/")).mode("overwrite" if overwrite else "append").save()
