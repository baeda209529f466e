"""Binary session files: bytes to tables and back.

Two layouts exist: "narrow" (32-bit ticks, 16-bit samples, text markers, no metadata) and "wide" (ticks of 32 or 64 bits,
16-bit or float samples, numeric markers, JSON metadata behind the data). A reader tells them apart by their first number.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from ..errors import IncompleteRead, InvalidFrequency, InvalidHeader, InvalidMetadata, InvalidValues, PayloadTooLarge, TickOverflow
from ..schema import KIND_NAMES, KINDS

# Fixed values of the file formats -------------------------------------------------------------------------------------
MAGIC = {"narrow": 827868494, "wide": 894977358}
FILE_VERSION = {"narrow": 106, "wide": 501, "wide64": 502}
VARIABLE_VERSION = {"narrow": 102, "wide": 500}
FILE_HEADER = {
    "narrow": np.dtype([("magic", "<i4"), ("version", "<i4"), ("comment", "S256"), ("frequency", "<f8"), ("beg", "<i4"), ("end", "<i4"), ("n_vars", "<i4"), ("pad", "S260")]),
    "wide": np.dtype([("magic", "<i4"), ("version", "<i4"), ("comment", "S256"), ("frequency", "<f8"), ("beg", "<i8"), ("n_vars", "<i4"), ("meta_offset", "<u8"), ("end", "<i8"), ("pad", "S56")]),
}
VARIABLE_HEADER = {
    "narrow": np.dtype([
        ("var_type", "<i4"), ("version", "<i4"), ("name", "S64"), ("data_offset", "<i4"), ("count", "<i4"), ("wire", "<i4"), ("unit", "<i4"), ("gain", "<i4"), ("filter", "<i4"),
        ("x_pos", "<f8"), ("y_pos", "<f8"), ("sampling_rate", "<f8"), ("ad_to_mv", "<f8"), ("n_points_wave", "<i4"), ("n_markers", "<i4"), ("marker_length", "<i4"), ("mv_offset", "<f8"), ("pre_thr_time", "<f8"), ("pad", "S52")]),
    "wide": np.dtype([
        ("var_type", "<i4"), ("version", "<i4"), ("name", "S64"), ("data_offset", "<i8"), ("count", "<i8"), ("ts_data_type", "<i4"), ("cont_data_type", "<i4"), ("sampling_rate", "<f8"), ("units", "S32"),
        ("ad_to_mv", "<f8"), ("mv_offset", "<f8"), ("n_points_wave", "<i8"), ("pre_thr_time", "<f8"), ("marker_data_type", "<i4"), ("n_markers", "<i4"), ("marker_length", "<i4"), ("cont_frag_index_type", "<i4"), ("pad", "S60")]),
}
FIELD_NAME_BYTES, LEAST_CELL = 64, 6
# ------------------------------------------------------------------------------------------------------------------------

DEFAULTS = {"ts_data_type": 0, "cont_data_type": 0, "sampling_rate": 0.0, "units": "", "ad_to_mv": 1.0, "mv_offset": 0.0, "n_points_wave": 0, "pre_thr_time": 0.0, "marker_data_type": 0, "n_markers": 0, "marker_length": 0, "gain": 0, "filter": 0, "wire": 0, "unit": 0, "x_pos": 0.0, "y_pos": 0.0}


@dataclass(frozen=True)
class ReadOptions:
    """names: variables whose payload is read (None: all, empty: none); unknown names are passed over."""

    names: frozenset[str] | None = None
    ignore_metadata_errors: bool = False
    max_payload_bytes: int = 512 << 20
    validate_layout: bool = True
    compact_timestamps: bool = False
    numeric_strings: bool = True


@dataclass(frozen=True)
class WriteOptions:
    layout: str = "wide"
    writer_name: str = "spikeframe"
    writer_version: str = "1"
    embed_metadata: bool = True


@dataclass
class Header:
    layout: str
    version: int
    comment: str
    frequency: float
    beg_seconds: float
    end_seconds: float
    meta_offset: int
    variables: list[dict] = field(default_factory=list)


def round_half_away(x: np.ndarray) -> np.ndarray:
    return np.trunc(x + np.copysign(0.5, x))


def to_ticks(seconds, frequency: float, kind: str) -> np.ndarray:
    """Whole ticks, held within the type; NaN becomes 0."""
    info = np.iinfo(kind)
    x = np.nan_to_num(round_half_away(np.asarray(seconds, np.float64) * frequency), nan=0.0, posinf=np.inf, neginf=-np.inf)
    out = np.zeros(len(x), np.int64)
    inside = (x > info.min) & (x < float(info.max))
    out[inside] = x[inside].astype(np.int64)
    out[x >= float(info.max)], out[x <= info.min] = info.max, info.min
    return out.astype(kind)


def clean(raw: bytes, strip: bool = True) -> str:
    """Text up to trailing NULs; bytes that are no UTF-8 are replaced."""
    text = raw.rstrip(b"\0").decode("utf-8", "replace")
    return text.strip() if strip else text


def padded(text: str, size: int) -> bytes:
    return text.encode()[:size].ljust(size, b"\0")


def marker_value(cell: int | str) -> int | str:
    """A text cell that is an unsigned 32-bit number as that number; any other as it is."""
    if isinstance(cell, str) and (digits := cell.removeprefix("+")).isascii() and digits.isdigit() and len(digits) < 19 and int(digits) < 2**32:
        return int(digits)
    return cell


def payload_size(v: dict) -> int:
    """The bytes that a variable's payload takes, by its header fields."""
    n, tick, cell = v["count"], 8 if v["ts_data_type"] else 4, 4 if v["cont_data_type"] else 2
    return {
        "neuron": n * tick, "event": n * tick, "interval": 2 * n * tick, "population": 8 * n,
        "waveform": n * (tick + v["n_points_wave"] * cell), "continuous": n * (tick + 4) + v["n_points_wave"] * cell,
        "marker": n * tick + v["n_markers"] * (FIELD_NAME_BYTES + n * (4 if v["marker_data_type"] else v["marker_length"])) if n else 0,
    }[v["kind"]]


class Reader:
    """Reads parts of one file through `read(offset, size)`."""

    def __init__(self, read: Callable[[int, int], bytes], size: int, options: ReadOptions | None = None):
        self.read_at, self.size, self.options = read, size, options or ReadOptions()
        self.header = self._header()

    @classmethod
    def of_bytes(cls, raw: bytes, options: ReadOptions | None = None) -> Reader:
        return cls(lambda offset, size: raw[offset : offset + size], len(raw), options)

    def _read(self, offset: int, size: int) -> bytes:
        raw = self.read_at(offset, size)
        if len(raw) < size:
            raise IncompleteRead(f"{size} bytes at {offset} of {self.size}")
        return raw

    def _array(self, offset: int, count: int, kind: str) -> np.ndarray:
        return np.frombuffer(self._read(offset, count * np.dtype(kind).itemsize), kind)

    def _header(self) -> Header:
        if self.size < 4:
            raise InvalidHeader("too short")
        magic = int(np.frombuffer(self._read(0, 4), "<i4")[0])
        layout = next((k for k, v in MAGIC.items() if v == magic), None)
        if layout is None or self.size < FILE_HEADER[layout].itemsize:
            raise InvalidHeader("no session file")
        h = np.frombuffer(self._read(0, FILE_HEADER[layout].itemsize), FILE_HEADER[layout])[0]
        f = float(h["frequency"])
        if not f > 0:
            raise InvalidFrequency(str(f))
        out = Header(layout, int(h["version"]), clean(bytes(h["comment"]), False), f, int(h["beg"]) / f, int(h["end"]) / f, int(h["meta_offset"]) if layout == "wide" else 0)
        kind = VARIABLE_HEADER[layout]
        rows = np.frombuffer(self._read(FILE_HEADER[layout].itemsize, int(h["n_vars"]) * kind.itemsize), kind)
        for i, r in enumerate(rows):
            v = DEFAULTS | {n: r[n].item() for n in kind.names if n not in ("pad", "name", "units")}
            v |= {"var_index": i, "var_name": clean(bytes(r["name"]), layout == "narrow"), "metadata": "{}"}
            if layout == "wide":
                v["units"] = clean(bytes(r["units"]), False)
                if v["cont_data_type"] == 1:
                    v |= {"ad_to_mv": 1.0, "mv_offset": 0.0}
            self._verify(v)
            out.variables.append(v)
        return out

    def _verify(self, v: dict) -> None:
        if v["var_type"] not in KIND_NAMES:
            raise InvalidHeader(f"{v['var_name']}: unknown kind {v['var_type']}")
        v["kind"] = KIND_NAMES[v["var_type"]]
        if v["count"] < 0 or v["kind"] == "waveform" and (v["n_points_wave"] <= 0 or not v["sampling_rate"] > 0) or v["kind"] == "continuous" and not v["sampling_rate"] > 0:
            raise InvalidHeader(f"{v['var_name']}: a count, length or rate that can't be")

    def payload_bytes(self, v: dict) -> int:
        return payload_size(v)

    def wanted(self, v: dict) -> bool:
        return self.options.names is None or v["var_name"] in self.options.names

    def metadata(self) -> dict:
        """The JSON behind the data, and its entries dealt to their variables; neurons and waveforms take wire, unit and place."""
        at = self.header.meta_offset
        if not 0 < at < self.size:
            return {}
        text = self._read(at, self.size - at).decode("utf-8", "replace").strip("\0").strip()
        try:
            meta = json.loads(text)
        except ValueError as e:
            if self.options.ignore_metadata_errors:
                return {}
            raise InvalidMetadata(str(e)) from e
        by_name = {v["var_name"]: v for v in self.header.variables}
        for m in meta.get("variables", []) if isinstance(meta, dict) else []:
            if v := by_name.get(m.get("name")):
                v["metadata"] = json.dumps(m)
                if v["kind"] in ("neuron", "waveform"):
                    probe = m.get("probe") or {}
                    place = probe.get("position") or {}
                    v |= {"unit": int(m.get("unitNumber", v["unit"])), "wire": int(probe.get("wireNumber", v["wire"])), "x_pos": float(place.get("x", v["x_pos"])), "y_pos": float(place.get("y", v["y_pos"]))}
        return meta

    def units(self, v: dict) -> int:
        """What a range of a variable counts in: samples of a continuous signal, else its rows."""
        return v["n_points_wave"] if v["kind"] == "continuous" else v["count"]

    def payload(self, v: dict, lo: int = 0, hi: int | None = None) -> dict:
        """The arrays of one variable, or of its rows (a continuous signal: samples) lo to hi, without hi."""
        size, at, n, f = self.payload_bytes(v), v["data_offset"], v["count"], self.header.frequency
        total = self.units(v)
        hi = total if hi is None else hi
        if not 0 <= lo <= hi <= total:
            raise IncompleteRead(f"{v['var_name']}: {lo} to {hi} of {total}")
        if total and size * (hi - lo) / total > self.options.max_payload_bytes:
            raise PayloadTooLarge(f"{v['var_name']}: {size} bytes")
        if self.options.validate_layout and n and (at > self.size or at + size > self.size):
            raise IncompleteRead(f"{v['var_name']}: its data pass the end of the file")
        tick_type = "<i8" if v["ts_data_type"] else "<i4"
        tick_size = np.dtype(tick_type).itemsize
        width, m, kind = n * tick_size, hi - lo, v["kind"]

        def seconds(offset: int, lo: int, m: int) -> tuple[np.ndarray, np.ndarray]:
            ticks = self._array(offset + lo * tick_size, m, tick_type).astype(np.int64)
            t = ticks / f
            return ticks, t.astype(np.float32).astype(np.float64) if self.options.compact_timestamps else t

        if kind in ("neuron", "event"):
            tick, t = seconds(at, lo, m)
            return {"tick": tick, "t": t}
        if kind == "interval":
            start, end = seconds(at, lo, m)[1], seconds(at + width, lo, m)[1]
            if (bad := np.flatnonzero(end < start)).size:
                raise InvalidValues(f"{v['var_name']}: interval {lo + bad[0]} ends before it starts")
            return {"t_start": start, "t_end": end}
        if kind == "population":
            return {"weight": self._array(at + 8 * lo, m, "<f8")}
        if not n:
            return {"t": np.zeros(0)} | ({"fields": []} if kind == "marker" else {"samples": np.zeros((0, 0), np.float32)} if kind == "waveform" else {"first": np.zeros(0, np.int64), "values": np.zeros(0)})
        scale, offset = (v["ad_to_mv"], v["mv_offset"]) if not v["cont_data_type"] else (1.0, 0.0)
        sample_type = "<f4" if v["cont_data_type"] else "<i2"
        sample_size = np.dtype(sample_type).itemsize
        if kind == "continuous":
            first = self._array(at + width, n, "<u4").astype(np.int64)
            raw = self._array(at + width + 4 * n + lo * sample_size, m, sample_type).astype(np.float64)
            return {"t": seconds(at, 0, n)[1], "first": first, "values": raw * scale + offset}
        t = seconds(at, lo, m)[1]
        at += width
        if kind == "waveform":
            raw = self._array(at + lo * v["n_points_wave"] * sample_size, m * v["n_points_wave"], sample_type)
            return {"t": t, "samples": (raw * scale + offset if not v["cont_data_type"] else raw).astype(np.float32).reshape(m, -1)}
        fields = []
        for _ in range(v["n_markers"]):
            name = clean(self._read(at, FIELD_NAME_BYTES))
            at += FIELD_NAME_BYTES
            if v["marker_data_type"]:
                cells: list = self._array(at + 4 * lo, m, "<u4").tolist()
                at += 4 * n
            else:
                length = v["marker_length"]
                raw = self._read(at + lo * length, m * length)
                cells = [clean(raw[i * length : (i + 1) * length]) for i in range(m)]
                at += n * length
            fields.append((name, [marker_value(c) for c in cells] if self.options.numeric_strings else cells))
        return {"t": t, "fields": fields}


def variable_row(session_id: str, v: dict) -> dict:
    return {"session_id": session_id} | {k: x for k, x in v.items() if k not in ("var_type", "cont_frag_index_type")}


def session_row(session_id: str, path: str, h: Header, metadata: dict) -> dict:
    return {"session_id": session_id, "path": path, "format": h.layout, "file_version": h.version, "comment": h.comment, "timestamp_frequency_hz": h.frequency, "beg_seconds": h.beg_seconds, "end_seconds": h.end_seconds, "metadata": json.dumps(metadata)}


#: Values of a long signal go into rows of so many; rows into batches of so many.
VALUES_PER_ROW, ROWS_PER_BATCH = 65_536, 50_000
TABLE_OF = {"neuron": "points", "event": "points", "interval": "intervals", "marker": "markers", "waveform": "waveforms", "continuous": "continuous", "population": "population"}


def payload_batches(session_id: str, v: dict, p: dict, base: int = 0) -> Iterator[pa.RecordBatch]:
    """One variable as Arrow batches in the columns of its kind's table; `base`: the number of the first row, or sample, in p."""
    kind = v["kind"]
    if kind == "continuous":
        end = base + len(p["values"])
        ends = [*p["first"][1:].tolist(), v["n_points_wave"]]
        for i, (t, a, b) in enumerate(zip(p["t"].tolist(), p["first"].tolist(), ends)):
            for lo in range(max(a, base), min(b, end), VALUES_PER_ROW):
                hi = min(b, end, lo + VALUES_PER_ROW)
                values = pa.ListArray.from_arrays(np.array([0, hi - lo], np.int32), pa.array(p["values"][lo - base : hi - base]))
                yield _batch(
                    session_id, v, 1, fragment=pa.array([i], pa.int32()), t0=pa.array([t + (lo - a) / v["sampling_rate"]]), first_sample=pa.array([lo], pa.int64()),
                    sampling_rate=pa.array([v["sampling_rate"]], pa.float64()), values=values)
        return
    fields = enumerate(p["fields"]) if kind == "marker" else [(0, ("", []))]
    n = len(p["weight"] if kind == "population" else p["t_start"] if kind == "interval" else p["t"])
    for f, (name, cells) in fields:
        for lo in range(0, n, ROWS_PER_BATCH):
            hi = min(n, lo + ROWS_PER_BATCH)
            idx = pa.array(np.arange(base + lo, base + hi))
            part = lambda key: pa.array(np.ascontiguousarray(p[key][lo:hi], np.float64))  # noqa: B023, E731
            if kind in ("neuron", "event"):
                yield _batch(session_id, v, hi - lo, kind=pa.repeat(kind, hi - lo), idx=idx, tick=pa.array(p["tick"][lo:hi]), t=part("t"))
            elif kind == "interval":
                yield _batch(session_id, v, hi - lo, idx=idx, t_start=part("t_start"), t_end=part("t_end"))
            elif kind == "population":
                yield _batch(session_id, v, hi - lo, idx=idx, weight=part("weight"))
            elif kind == "waveform":
                samples = p["samples"][lo:hi]
                lists = pa.ListArray.from_arrays(np.arange(hi - lo + 1, dtype=np.int32) * samples.shape[1], pa.array(np.ascontiguousarray(samples, np.float32).ravel()))
                yield _batch(session_id, v, hi - lo, idx=idx, t=part("t"), samples=lists)
            else:
                some = cells[lo:hi]
                yield _batch(
                    session_id, v, hi - lo, idx=idx, t=part("t"), field_index=pa.array(np.full(hi - lo, f, np.int32)), field_name=pa.repeat(name, hi - lo),
                    num=pa.array([c if isinstance(c, int) else None for c in some], pa.int64()), str=pa.array([c if isinstance(c, str) else None for c in some], pa.string()))


def _batch(session_id: str, v: dict, n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"session_id": pa.repeat(session_id, n), "var_name": pa.repeat(v["var_name"], n)} | columns)


def cell_text(cell: int | str) -> str:
    """How a cell stands in a file of text markers: numbers of five digits at least."""
    return f"{cell:05d}" if isinstance(cell, int) else cell


def scaling_of(v: dict, n: int, fits: bool, top: float, layout: str) -> tuple[int, float, float]:
    """Sample type, scale and offset to write with; float data made 16-bit get the scale of their range.

    `n` values, whether all stand on the variable's own 16-bit steps, and the largest without its sign.
    """
    if layout == "wide" and v["cont_data_type"] == 1 or not n:
        return (v["cont_data_type"] if layout == "wide" else 0), 1.0, 0.0
    if v["cont_data_type"] == 0 and v["ad_to_mv"] not in (0.0,) and fits:
        return 0, v["ad_to_mv"], v["mv_offset"]
    return 0, top / 32767 if top else 1.0, 0.0


def _scaling(v: dict, values: np.ndarray, layout: str) -> tuple[int, float, float]:
    fits = False
    if v["cont_data_type"] == 0 and v["ad_to_mv"] not in (0.0,) and len(values):
        raw = round_half_away((values - v["mv_offset"]) / v["ad_to_mv"])
        fits = bool(np.abs(raw).max() <= 32767 and np.allclose(raw * v["ad_to_mv"] + v["mv_offset"], values, rtol=1e-6, atol=abs(v["ad_to_mv"]) * 1e-3))
    return scaling_of(v, len(values), fits, float(np.abs(values).max()) if len(values) else 0.0, layout)


def raw_samples(values: np.ndarray, sample_type: int, scale: float, offset: float) -> np.ndarray:
    """Samples as they stand in a file."""
    if sample_type:
        return values.astype("<f4")
    return np.clip(np.nan_to_num(round_half_away((values - offset) / scale)), -32768, 32767).astype("<i2")


def tick_type_of(last: float, frequency: float, layout: str) -> str:
    """The type of ticks in a file whose latest time is `last`."""
    if math.floor(last * frequency + 0.5) < 2**31:
        return "<i4"
    if layout != "wide":
        raise TickOverflow(f"{last} s at {frequency} Hz")
    return "<i8"


def encode_variable(v: dict, p: dict, frequency: float, tick_type: str, layout: str) -> tuple[dict, bytes]:
    """A variable's header fields but for its place, and its payload's bytes. `p` holds the arrays that Reader.payload gives."""
    v = DEFAULTS | v
    if not v["var_name"]:
        raise InvalidValues("a variable needs a name")
    body, changed = _encode(v, p, frequency, tick_type, layout)
    return v | changed | {"var_type": KINDS[v["kind"]], "version": VARIABLE_VERSION[layout], "ts_data_type": int(tick_type == "<i8"), "cont_frag_index_type": 0}, body


def frame(session: dict, last: float, encoded: list[tuple[dict, int]], o: WriteOptions) -> tuple[bytes, list[int], bytes, int]:
    """A file but for its payloads, by header fields and payload sizes: headers, each payload's place, metadata, and their place."""
    wide, f = o.layout == "wide", float(session["timestamp_frequency_hz"])
    tick_type = tick_type_of(last, f, o.layout)
    kind = VARIABLE_HEADER[o.layout]
    at = FILE_HEADER[o.layout].itemsize + len(encoded) * kind.itemsize
    heads, places = np.zeros(len(encoded), kind), []
    for head, (v, size) in zip(heads, encoded):
        for n in kind.names:
            if n not in ("pad", "name", "units"):
                head[n] = at if n == "data_offset" else v[n]
        head["name"] = padded(v["var_name"], 64)
        if wide:
            head["units"] = padded(v["units"] or "", 32)
        places.append(at)
        at += size
    h = np.zeros(1, FILE_HEADER[o.layout])
    h["magic"], h["version"], h["comment"], h["frequency"], h["n_vars"] = MAGIC[o.layout], FILE_VERSION["wide64" if tick_type == "<i8" else o.layout], padded(session.get("comment") or "", 256), f, len(encoded)
    h["beg"], h["end"] = to_ticks([session.get("beg_seconds") or 0.0], f, "<i8" if wide else "<i4")[0], math.floor(last * f + 0.5)
    meta = b""
    if wide and o.embed_metadata:
        entries = []
        for v, _ in encoded:
            m: dict = {"name": v["var_name"]}
            if v["kind"] in ("neuron", "waveform"):
                m |= {"unitNumber": v.get("unit", 0), "probe": {"wireNumber": v.get("wire", 0), "position": {"x": v.get("x_pos", 0.0), "y": v.get("y_pos", 0.0)}}}
            entries.append(m)
        meta = json.dumps({"file": {"writerSoftware": {"name": o.writer_name, "version": o.writer_version}}, "variables": entries}).encode()
        h["meta_offset"] = at
    return h.tobytes() + heads.tobytes(), places, meta, at


def assemble(session: dict, last: float, encoded: list[tuple[dict, bytes]], o: WriteOptions) -> bytes:
    """A file's bytes: headers, payloads without gaps, and metadata."""
    head, _, meta, _ = frame(session, last, [(v, len(body)) for v, body in encoded], o)
    return b"".join([head, *(body for _, body in encoded), meta])


def encode_session(session: dict, variables: list[dict], payloads: dict[str, dict], options: WriteOptions | None = None) -> bytes:
    """A file's bytes from all its variables' arrays."""
    o, f = options or WriteOptions(), float(session["timestamp_frequency_hz"])
    if not f > 0:
        raise InvalidFrequency(str(f))
    last = max([0.0, *(_last_time(v, payloads[v["var_name"]]) for v in variables)])
    tick_type = tick_type_of(last, f, o.layout)
    return assemble(session, last, [encode_variable(v, payloads[v["var_name"]], f, tick_type, o.layout) for v in variables], o)


def _last_time(v: dict, p: dict) -> float:
    t = p.get("t_end") if v["kind"] == "interval" else p.get("t")
    if t is None or not len(t):
        return 0.0
    last = float(np.max(t))
    if v["kind"] == "waveform":
        last += max(0, p["samples"].shape[1] - 1) / v["sampling_rate"]
    if v["kind"] == "continuous":
        last = float(t[-1]) + (len(p["values"]) - int(p["first"][-1]) - 1) / v["sampling_rate"]
    return last


def _encode(v: dict, p: dict, f: float, tick_type: str, layout: str) -> tuple[bytes, dict]:
    ticks: Callable[[Iterable], bytes] = lambda t: to_ticks(t, f, tick_type).tobytes()
    kind = v["kind"]
    if kind in ("neuron", "event"):
        return ticks(p["t"]), {"count": len(p["t"])}
    if kind == "interval":
        return ticks(p["t_start"]) + ticks(p["t_end"]), {"count": len(p["t_start"])}
    if kind == "population":
        return np.asarray(p["weight"], "<f8").tobytes(), {"count": len(p["weight"])}
    if kind == "marker":
        cells = [c for _, column in p["fields"] for c in column]
        numeric = all(isinstance(c, int) for c in cells)
        if not numeric and any(isinstance(c, int) for c in cells):
            raise InvalidValues(f"{v['var_name']}: numbers and texts together")
        text = [cell_text(c) for c in cells]
        length = max(LEAST_CELL, max((len(c.encode()) for c in text), default=0) + 1)
        as_number = numeric and layout == "wide"
        body = [ticks(p["t"])]
        for name, column in p["fields"]:
            body.append(padded(name, FIELD_NAME_BYTES))
            body.append(np.array(column, "<u4").tobytes() if as_number else b"".join(padded(cell_text(c), length) for c in column))
        return b"".join(body) if len(p["t"]) else b"", {"count": len(p["t"]), "n_markers": len(p["fields"]), "marker_length": LEAST_CELL if as_number else length, "marker_data_type": int(as_number)}
    values = np.asarray(p["samples"] if kind == "waveform" else p["values"], np.float64)
    sample_type, scale, offset = _scaling(v, values.ravel(), layout)
    raw = raw_samples(values, sample_type, scale, offset)
    head = {"count": len(p["t"]), "cont_data_type": sample_type, "ad_to_mv": scale, "mv_offset": offset}
    if kind == "waveform":
        return ticks(p["t"]) + raw.tobytes(), head | {"n_points_wave": values.shape[1] if len(values) else v["n_points_wave"]}
    return ticks(p["t"]) + np.asarray(p["first"], "<u4").tobytes() + raw.tobytes(), head | {"n_points_wave": len(values)}
