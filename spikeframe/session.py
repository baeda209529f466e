"""A session as a bundle of DataFrames, and the algebra over its variables."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .errors import DuplicateVariable, IncompleteRead, InvalidFrequency, InvalidValues, VariableNotFound, WrongKind
from .functions import EPSILON
from .schema import KINDS, TABLES

TABLE_OF_KIND = {"neuron": "points", "event": "points", "interval": "intervals", "marker": "markers", "waveform": "waveforms", "continuous": "continuous", "population": "population"}
PAYLOADS = ("points", "intervals", "markers", "waveforms", "continuous", "population")


@dataclass(frozen=True)
class Session:
    """The tables of one or more sessions; nothing is read before an action asks for it."""

    sessions: DataFrame
    variables: DataFrame
    points: DataFrame
    intervals: DataFrame
    markers: DataFrame
    waveforms: DataFrame
    continuous: DataFrame
    population: DataFrame
    #: Variables whose payload the tables hold; None: all.
    loaded: frozenset[str] | None = None
    #: For tables that still stand for files: (table, variable, first row, row behind the last) opened on its own.
    reopen: Callable[[str, str, int, int | None], DataFrame] | None = None
    #: The sessions without what is computed from payloads (their ends), to count them by.
    heads: DataFrame | None = None

    def _sessions(self) -> int:
        return (self.sessions if self.heads is None else self.heads).count()

    def variable_names(self, kind: str | None = None) -> DataFrame:
        """(session_id, kind, var_name, place): the variables of each session, `place` counting those of the kind in file order."""
        rows = self.variables if kind is None else self.variables.where(F.col("kind") == kind)
        order = Window.partitionBy("session_id", "kind").orderBy("var_index")
        return rows.select("session_id", "kind", "var_name", (F.row_number().over(order) - 1).alias("place"))

    def names(self, kind: str | None = None) -> list[str]:
        """Names in file order, each once."""
        rows = self.variables if kind is None else self.variables.where(F.col("kind") == kind)
        return list(dict.fromkeys(r["var_name"] for r in rows.orderBy("session_id", "var_index").select("var_name").collect()))

    def _need(self, *names: str, kind: str | Sequence[str] | None = None) -> None:
        """Every session must have the variables, of one of the kinds."""
        have: dict[str, dict[str, str]] = {}
        for r in self.variables.where(F.col("var_name").isin(*names)).select("session_id", "var_name", "kind").collect():
            have.setdefault(r["var_name"], {})[r["session_id"]] = r["kind"]
        sessions = self._sessions()
        for name in names:
            if len(have.get(name, {})) < max(sessions, 1):
                raise VariableNotFound(name)
            for sid, found in have[name].items():
                if kind is not None and found not in ([kind] if isinstance(kind, str) else kind):
                    raise WrongKind(f"{name} of {sid} is of kind {found}")

    def payload(self, name: str, kind: str) -> DataFrame:
        """The rows of one variable of the given kind, of every session."""
        self._need(name, kind=kind)
        if not self.is_loaded(name):
            raise IncompleteRead(f"{name} was not among the variables to read")
        return self._rows(TABLE_OF_KIND[kind], name)

    def _rows(self, table: str, name: str, low: int = 0, high: int | None = None) -> DataFrame:
        """A variable's rows, from files if they can be read in part; numbers below `low` or from `high` on may be left out."""
        found = getattr(self, table) if self.reopen is None else self.reopen(table, name, low, high)
        return found.where(F.col("var_name") == name)

    def is_loaded(self, name: str) -> bool:
        """Whether the variable's payload is in the tables, and not its header alone; a variable without rows has all it needs."""
        return self.loaded is None or name in self.loaded or self.variables.where((F.col("var_name") == name) & (F.col("count") > 0)).isEmpty()

    def neuron(self, name: str) -> DataFrame:
        return self.payload(name, "neuron")

    def event(self, name: str) -> DataFrame:
        return self.payload(name, "event")

    def interval(self, name: str) -> DataFrame:
        return self.payload(name, "interval")

    def marker(self, name: str) -> DataFrame:
        return self.payload(name, "marker")

    def waveform(self, name: str) -> DataFrame:
        return self.payload(name, "waveform")

    def signal(self, name: str) -> DataFrame:
        return self.payload(name, "continuous")

    def weights(self, name: str) -> DataFrame:
        return self.payload(name, "population")

    def timestamps(self, name: str) -> DataFrame:
        """(session_id, idx, t) of a neuron, event, marker or waveform."""
        return self._timestamps(name)

    def _timestamps(self, name: str, low: int = 0, high: int | None = None) -> DataFrame:
        self._need(name, kind=("neuron", "event", "marker", "waveform"))
        parts = {t: self._rows(t, name, low, high) for t in ("points", "markers", "waveforms")}
        return all_timestamps(replace(self, **parts)).select("session_id", "idx", "t")

    def timestamp_range(self, name: str, start: int, count: int) -> DataFrame:
        """`count` timestamps from number `start`; a range beyond those that a session has is an error."""
        self._need(name, kind=("neuron", "event", "marker", "waveform"))
        if start < 0 or count < 0:
            raise IncompleteRead(f"{name}: {count} from {start}")
        least = self.variables.where(F.col("var_name") == name).agg(F.min("count")).first()[0]
        if start + count > least:
            raise IncompleteRead(f"{name}: {count} from {start}, where there are {least}")
        return self._timestamps(name, start, start + count).where((F.col("idx") >= start) & (F.col("idx") < start + count))

    def _map(self, f) -> Session:
        return replace(self, variables=f(self.variables), **{p: f(getattr(self, p)) for p in PAYLOADS}, reopen=None)

    def subset(self, names: Sequence[str]) -> Session:
        """The named variables of each session in the order asked for; a session's end is that of what remains of it."""
        if len(set(names)) < len(names):
            raise DuplicateVariable("a name is given twice")
        self._need(*names)
        out = self._map(lambda df: df.where(F.col("var_name").isin(*names)))
        order = F.create_map(*[F.lit(x) for pair in ((n, i) for i, n in enumerate(names)) for x in pair])
        out = replace(out, variables=out.variables.withColumn("var_index", order[F.col("var_name")]))
        return out.with_end()

    def rename(self, old: str, new: str) -> Session:
        """Only the variable's name changes, in every session; metadata keep the old one."""
        self._need(old)
        if new in self.names():
            raise DuplicateVariable(new)
        named = self._map(lambda df: df.withColumn("var_name", F.when(F.col("var_name") == old, new).otherwise(F.col("var_name"))))
        return named if self.loaded is None else replace(named, loaded=frozenset(new if n == old else n for n in self.loaded))

    def delete(self, name: str) -> Session:
        """Every session without the variable; the ends stay."""
        self._need(name)
        return self._map(lambda df: df.where(F.col("var_name") != name))

    def merge(self, other: Session) -> Session:
        """Other's variables behind this one's. Frequencies must agree, names must not clash; metadata stay this one's.

        Both sides hold one session; sessions by the thousand are put side by side with union().
        """
        a, b = self._only(), other._only()
        if abs(a["timestamp_frequency_hz"] - b["timestamp_frequency_hz"]) > EPSILON:
            raise InvalidFrequency("the sessions' frequencies differ")
        if clash := set(self.names()) & set(other.names()):
            raise DuplicateVariable(", ".join(sorted(clash)))
        n = self.variables.count()
        sid = a["session_id"]
        mine = other._map(lambda df: df.withColumn("session_id", F.lit(sid)))
        moved = mine.variables.withColumn("var_index", (F.col("var_index") + n).cast("int"))
        head = self.sessions.withColumn("beg_seconds", F.lit(min(a["beg_seconds"], b["beg_seconds"]))).withColumn("end_seconds", F.lit(max(a["end_seconds"], b["end_seconds"]))).withColumn("comment", F.lit(a["comment"] or b["comment"]))
        return replace(self, sessions=head, variables=self.variables.unionByName(moved), **{p: getattr(self, p).unionByName(getattr(mine, p)) for p in PAYLOADS}, reopen=None, heads=None)

    def _only(self):
        rows = self.sessions.limit(2).collect()
        if len(rows) != 1:
            raise InvalidValues("one session is wanted, and there are " + ("none" if not rows else "more"))
        return rows[0]

    def union(self, other: Session) -> Session:
        """The sessions of both, whose ids must differ."""
        if not self.sessions.join(other.sessions, "session_id", "left_semi").isEmpty():
            raise DuplicateVariable("a session is on both sides")
        return replace(self, **{name: getattr(self, name).unionByName(getattr(other, name)) for name in TABLES}, reopen=None, heads=None)

    def with_end(self) -> Session:
        """Each session's end set to the latest time in its variables."""
        ends = maximum_timestamps(self).groupBy("session_id").agg(F.max("max_t").alias("_end"))
        end = F.greatest(F.lit(0.0), F.coalesce("_end", F.lit(0.0)))
        heads = self.sessions if self.heads is None else self.heads
        return replace(self, sessions=heads.join(ends, "session_id", "left").withColumn("end_seconds", end).select(*heads.columns), heads=heads)

    def info(self) -> DataFrame:
        """One row a session: header fields and the number of neurons, events, continuous signals and intervals."""
        counts = self.variables.groupBy("session_id").agg(*(F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in ("neuron", "event", "continuous", "interval")))
        return self.sessions.join(counts, "session_id", "left").select("session_id", "comment", "timestamp_frequency_hz", "beg_seconds", "end_seconds", *(F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in ("neuron", "event", "continuous", "interval")))

    def metadata(self) -> DataFrame:
        """(session_id, var_name, unit, wire, x, y, raw) from each variable's JSON."""
        m = F.col("metadata")
        return self.variables.select(
            "session_id", "var_name", F.get_json_object(m, "$.unitNumber").cast("int").alias("unit"), F.get_json_object(m, "$.probe.wireNumber").cast("int").alias("wire"),
            F.get_json_object(m, "$.probe.position.x").cast("double").alias("x"), F.get_json_object(m, "$.probe.position.y").cast("double").alias("y"), m.alias("raw"))

    def to_json(self) -> str:
        """All tables as one JSON text; for sessions that fit a driver."""
        return json.dumps({name: [json.loads(x) for x in getattr(self, name).toJSON().collect()] for name in TABLES})

    @staticmethod
    def from_json(spark: SparkSession, text: str) -> Session:
        data = json.loads(text)
        return Session(**{name: spark.createDataFrame([json.dumps(r) for r in data[name]], "string").select(F.from_json("value", schema).alias("r")).select("r.*") if data[name] else spark.createDataFrame([], schema) for name, schema in TABLES.items()})


def all_timestamps(s: Session) -> DataFrame:
    """(session_id, var_name, kind, idx, t) of all that has timestamps."""
    cols = ("session_id", "var_name", "kind", "idx", "t")
    return s.points.select(*cols).unionByName(s.markers.where("field_index = 0").withColumn("kind", F.lit("marker")).select(*cols)).unionByName(s.waveforms.withColumn("kind", F.lit("waveform")).select(*cols))


def maximum_timestamps(s: Session) -> DataFrame:
    """(session_id, var_name, kind, count, max_t) of every variable; 0 where there is nothing later.

    A waveform ends with its last sample, a fragment with its last value, an interval at its end.
    """
    rates = s.variables.select("session_id", "var_name", "sampling_rate", "n_points_wave")
    key = ["session_id", "var_name"]
    waves = s.waveforms.join(rates, key).select(*key, (F.col("t") + F.coalesce(F.try_divide(F.greatest(F.col("n_points_wave") - 1, F.lit(0)), F.col("sampling_rate")), F.lit(0.0))).alias("t"))
    parts = [
        s.points.select(*key, "t"), s.intervals.select(*key, F.col("t_end").alias("t")), s.markers.where("field_index = 0").select(*key, "t"), waves,
        s.continuous.select(*key, (F.col("t0") + F.coalesce(F.try_divide(F.size("values") - 1, F.col("sampling_rate")), F.lit(0.0))).alias("t")), s.population.select(*key, F.lit(0.0).alias("t")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    ends = every.groupBy(*key).agg(F.count("*").alias("count"), F.greatest(F.lit(0.0), F.max("t")).alias("max_t"))
    return s.variables.select(*key, "kind").join(ends, key, "left").select(*key, "kind", F.coalesce("count", F.lit(0).cast("long")).alias("count"), F.coalesce("max_t", F.lit(0.0)).alias("max_t"))


def diff(a: Session, b: Session) -> DataFrame:
    """(var_name, status): only_in_a, only_in_b, or changed: kind or count differ, or the last times do. Values are not compared.

    Two single sessions are compared whatever their ids; of several, those of equal ids, and session_id comes first.
    """
    x, y = maximum_timestamps(a), maximum_timestamps(b)
    if max(a._sessions(), b._sessions()) <= 1:
        return diff_summaries(x, y)
    return diff_summaries(x, y, ("session_id", "var_name"))


def diff_summaries(a: DataFrame, b: DataFrame, key: Sequence[str] = ("var_name",)) -> DataFrame:
    x, y = (df.select(*key, F.struct("kind", "count", "max_t").alias(n)) for df, n in ((a, "_a"), (b, "_b")))
    changed = (F.col("_a.kind") != F.col("_b.kind")) | (F.col("_a.count") != F.col("_b.count")) | (F.abs(F.col("_a.max_t") - F.col("_b.max_t")) > EPSILON)
    status = F.when(F.col("_b").isNull(), "only_in_a").when(F.col("_a").isNull(), "only_in_b").when(changed, "changed")
    return x.join(y, list(key), "full_outer").select(*key, status.alias("status")).where("status IS NOT NULL")


def export_names(variables: DataFrame) -> DataFrame:
    """Names of neurons and events, each once, sorted."""
    return variables.where(F.col("kind").isin("neuron", "event")).select("var_name").distinct().orderBy("var_name")


def invalid_intervals(intervals: DataFrame) -> DataFrame:
    """Intervals that end before they start."""
    return intervals.where("t_end < t_start")


def require_valid_intervals(intervals: DataFrame) -> None:
    if row := invalid_intervals(intervals).orderBy("idx").first():
        raise InvalidValues(f"interval {row['idx']} ends before it starts")


class SessionBuilder:
    """Collects variables one by one; the frequency comes first."""

    def __init__(self, spark: SparkSession, frequency: float, comment: str = "", beg_seconds: float = 0.0, session_id: str = "session"):
        if not frequency > 0:
            raise InvalidFrequency(str(frequency))
        self.spark, self.id, self.f, self.comment, self.beg = spark, session_id, float(frequency), comment, float(beg_seconds)
        self.meta = "{}"
        self.rows: dict[str, list] = {name: [] for name in TABLES}

    def metadata(self, value: dict) -> SessionBuilder:
        self.meta = json.dumps(value)
        return self

    def _variable(self, name: str, kind: str, count: int, **header) -> None:
        if not name:
            raise InvalidValues("a variable needs a name")
        if any(v["var_name"] == name for v in self.rows["variables"]):
            raise DuplicateVariable(name)
        base = {"version": 500, "data_offset": 0, "ts_data_type": 0, "cont_data_type": 1, "sampling_rate": 0.0, "units": "", "ad_to_mv": 1.0, "mv_offset": 0.0, "n_points_wave": 0, "pre_thr_time": 0.0, "marker_data_type": 0, "n_markers": 0, "marker_length": 0, "gain": 0, "filter": 0, "wire": 0, "unit": 0, "x_pos": 0.0, "y_pos": 0.0}
        meta = {"name": name} | ({"unitNumber": header.get("unit", 0), "probe": {"wireNumber": header.get("wire", 0), "position": {"x": header.get("x_pos", 0.0), "y": header.get("y_pos", 0.0)}}} if kind in ("neuron", "waveform") else {})
        assert kind in KINDS
        self.rows["variables"].append({"session_id": self.id, "var_index": len(self.rows["variables"]), "var_name": name, "kind": kind, "count": count, "metadata": json.dumps(meta)} | base | header)

    def _points(self, name: str, kind: str, times: Sequence[float], **header) -> SessionBuilder:
        self._variable(name, kind, len(times), **header)
        self.rows["points"] += [{"session_id": self.id, "var_name": name, "kind": kind, "idx": i, "tick": _tick(t, self.f), "t": float(t)} for i, t in enumerate(times)]
        return self

    def event(self, name: str, times: Sequence[float]) -> SessionBuilder:
        return self._points(name, "event", times)

    def neuron(self, name: str, times: Sequence[float], wire: int = 0, unit: int = 0, x: float = 0.0, y: float = 0.0) -> SessionBuilder:
        return self._points(name, "neuron", times, wire=wire, unit=unit, x_pos=float(x), y_pos=float(y))

    def interval(self, name: str, pairs: Sequence[tuple[float, float]]) -> SessionBuilder:
        for i, (a, b) in enumerate(pairs):
            if b < a:
                raise InvalidValues(f"interval {i} ends before it starts")
        self._variable(name, "interval", len(pairs))
        self.rows["intervals"] += [{"session_id": self.id, "var_name": name, "idx": i, "t_start": float(a), "t_end": float(b)} for i, (a, b) in enumerate(pairs)]
        return self

    def marker(self, name: str, times: Sequence[float], fields: dict[str, Sequence[int | str]]) -> SessionBuilder:
        for k, v in fields.items():
            if len(v) != len(times):
                raise InvalidValues(f"field {k} has {len(v)} values for {len(times)} times")
        numeric = all(isinstance(x, int) for v in fields.values() for x in v)
        self._variable(name, "marker", len(times), n_markers=len(fields), marker_data_type=int(numeric))
        for f, (k, v) in enumerate(fields.items()):
            self.rows["markers"] += [{"session_id": self.id, "var_name": name, "idx": i, "t": float(t), "field_index": f, "field_name": k, "num": x if isinstance(x, int) else None, "str": x if isinstance(x, str) else None} for i, (t, x) in enumerate(zip(times, v))]
        return self

    def population(self, name: str, weights: Sequence[float]) -> SessionBuilder:
        self._variable(name, "population", len(weights))
        self.rows["population"] += [{"session_id": self.id, "var_name": name, "idx": i, "weight": float(w)} for i, w in enumerate(weights)]
        return self

    def waveform(self, name: str, rate: float, times: Sequence[float], waves: Sequence[Sequence[float]], **header) -> SessionBuilder:
        if not rate > 0:
            raise InvalidValues("the sampling rate must be positive")
        if len(times) != len(waves) or len({len(w) for w in waves}) > 1:
            raise InvalidValues("waveforms need one time each and one length")
        self._variable(name, "waveform", len(times), sampling_rate=float(rate), n_points_wave=len(waves[0]) if waves else 0, **header)
        self.rows["waveforms"] += [{"session_id": self.id, "var_name": name, "idx": i, "t": float(t), "samples": [float(x) for x in w]} for i, (t, w) in enumerate(zip(times, waves))]
        return self

    def continuous(self, name: str, rate: float, start: float, values: Sequence[float], **header) -> SessionBuilder:
        """One fragment."""
        return self._fragments(name, rate, [(float(start), 0, list(values))] if len(values) else [], **header)

    def continuous_i16(self, name: str, rate: float, start: float, raw: Sequence[int], scale: float, offset: float) -> SessionBuilder:
        return self.continuous(name, rate, start, [v * scale + offset for v in raw], ad_to_mv=float(scale), mv_offset=float(offset), cont_data_type=0)

    def continuous_timed(self, name: str, rate: float, times: Sequence[float], values: Sequence[float]) -> SessionBuilder:
        """A value for each time; a new fragment wherever the ticks are not one sample apart."""
        if len(times) != len(values):
            raise InvalidValues("times and values differ in number")
        if not rate > 0:
            raise InvalidValues("the sampling rate must be positive")
        step = self.f / rate
        if abs(step - round(step)) > 1e-6:
            raise InvalidValues("the sampling rate must divide the timestamp frequency")
        parts, last = [], None
        for i, (t, v) in enumerate(zip(times, values)):
            tick = _tick(t, self.f)
            if last is None or tick != last + round(step):
                parts.append((float(t), i, []))
            parts[-1][2].append(v)
            last = tick
        return self._fragments(name, rate, parts)

    def _fragments(self, name: str, rate: float, parts: list, **header) -> SessionBuilder:
        if not rate > 0:
            raise InvalidValues("the sampling rate must be positive")
        self._variable(name, "continuous", len(parts), sampling_rate=float(rate), n_points_wave=sum(len(v) for *_, v in parts), **header)
        self.rows["continuous"] += [{"session_id": self.id, "var_name": name, "fragment": i, "t0": t0, "first_sample": first, "sampling_rate": float(rate), "values": [float(x) for x in v]} for i, (t0, first, v) in enumerate(parts)]
        return self

    def build(self) -> Session:
        self.rows["sessions"] = [{"session_id": self.id, "path": "", "format": "", "file_version": 0, "comment": self.comment, "timestamp_frequency_hz": self.f, "beg_seconds": self.beg, "end_seconds": 0.0, "metadata": self.meta}]
        return Session(**{name: self.spark.createDataFrame(self.rows[name], schema) for name, schema in TABLES.items()}).with_end()


def _tick(t: float, frequency: float) -> int:
    """Halves away from zero."""
    x = t * frequency
    return int(x + 0.5) if x >= 0 else -int(-x + 0.5)


def write_offsets(sizes: DataFrame, start: int, order: str = "var_index", size: str = "bytes") -> DataFrame:
    """`data_offset` of each variable: the bytes of all before it, from `start`."""
    before = F.sum(size).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))  # one row a variable
    return sizes.withColumn("data_offset", F.coalesce(before, F.lit(0)) + F.lit(start))
