"""All queries of the engine's own operators by name, and the SQL that gives the same rows.

The test tables stand in for recordings: events are spike and stimulus trains (unit: user or type; time: seconds since
2024-01-01; value: a sampled signal; props: a marker field), embeddings are waveforms with cluster labels, orders and
their line items are intervals.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import EPSILON, dequantise_i16, l2, marker_fields, marker_number, quantise_i16, seconds_to_ticks, ticks_to_seconds
from ..operators import clustering, signals, spikes
from ..operators import sorting as spike_sorting
from ..operators.analysis import analyse
from ..operators.parts import numbered_once
from ..schema import TABLES, VARIABLES
from ..session import Session, diff, export_names, invalid_intervals, maximum_timestamps
from ..sources.codec import WriteOptions
from ..sources.datasource import read_session
from ..sources.detected import channel_neurons
from ..sources.interchange import Interchange, all_paths, decode_descriptions, descriptions_of, intervals_of, markers_of, plain_series, series_of, waveforms_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


SECONDS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) / 1e6D"
#: The same in the oracle's SQL.
SQL_T = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6::DOUBLE"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props", F.expr(SECONDS).alias("t"))


def of_type(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return trains(spark, sf_dir).where(F.col("event_type") == kind)


P = f"WITH p AS (SELECT event_id, user_id, event_type, value, props, {SQL_T} AS t FROM events)"

# PSTH, raster, correlograms ------------------------------------------------------------------------------------------

PSTH_SQL = P + """,
    n AS (SELECT count(*) AS n_events FROM p WHERE event_type = 'signup'),
    hits AS (
        SELECT floor((s.t - e.t - -3600e0) / 300e0)::BIGINT AS bin FROM p s JOIN p e
        ON s.event_type = 'view' AND e.event_type = 'signup' AND s.t >= e.t + -3600e0 AND s.t <= e.t + 7200e0
        WHERE s.t - e.t >= -3600e0 AND s.t - e.t < 7200e0),
    c AS (SELECT bin, count(*) AS n FROM hits GROUP BY bin)
    SELECT b.bin::BIGINT AS bin, -3600e0 + b.bin * 300e0 AS bin_start, coalesce(c.n, 0) AS count,
        coalesce(c.n, 0) / (n_events * 300e0) AS rate_hz, n_events
    FROM range(36) b(bin) CROSS JOIN n LEFT JOIN c USING (bin)"""


@query(PSTH_SQL)
def q_psth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.psth(of_type(spark, sf_dir, "view"), of_type(spark, sf_dir, "signup"), -3600.0, 7200.0, 300.0)


@query(P + """,
    n AS (SELECT user_id, count(*) AS n_events FROM p WHERE event_type = 'signup' GROUP BY user_id),
    c AS (
        SELECT s.user_id, floor((s.t - e.t - -86400e0) / 21600e0)::BIGINT AS bin, count(*) AS n FROM p s JOIN p e
        ON s.user_id = e.user_id AND s.event_type = 'view' AND e.event_type = 'signup' AND s.t >= e.t + -86400e0 AND s.t <= e.t + 86400e0
        WHERE s.t - e.t >= -86400e0 AND s.t - e.t < 86400e0 GROUP BY ALL)
    SELECT n.user_id, b.bin::BIGINT AS bin, -86400e0 + b.bin * 21600e0 AS bin_start, coalesce(c.n, 0) AS count,
        coalesce(c.n, 0) / (n_events * 21600e0) AS rate_hz, n_events
    FROM n CROSS JOIN range(8) b(bin) LEFT JOIN c USING (user_id, bin)""")
def q_psth_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.psth(of_type(spark, sf_dir, "view"), of_type(spark, sf_dir, "signup"), -86400.0, 86400.0, 21600.0, ["user_id"])


@query(P + """
    SELECT e.user_id, e.event_id, s.t - e.t AS rel FROM p e LEFT JOIN p s
    ON s.user_id = e.user_id AND s.event_type = 'view' AND s.t >= e.t + -86400e0 AND s.t <= e.t + 86400e0
    WHERE e.event_type = 'signup'""")
def q_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = spikes.raster(of_type(spark, sf_dir, "view"), of_type(spark, sf_dir, "signup"), -86400.0, 86400.0, ["user_id"], "event_id")
    return trials.select("user_id", "event_id", F.explode_outer("trial").alias("rel"))


@query(P + """,
    c AS (
        SELECT floor((a.t - b.t + 600e0) / 60e0)::BIGINT AS bin, count(*) AS n FROM p a JOIN p b
        ON a.event_type = 'click' AND b.event_type = 'view' AND a.t BETWEEN b.t - 601e0 AND b.t + 601e0
        WHERE abs(a.t - b.t) <= 600e0 GROUP BY ALL)
    SELECT b.bin::BIGINT AS bin, -600e0 + b.bin * 60e0 AS bin_start, coalesce(c.n, 0) AS count FROM range(20) b(bin) LEFT JOIN c USING (bin)""")
def q_xcorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.cross_correlogram(of_type(spark, sf_dir, "click"), of_type(spark, sf_dir, "view"), 600.0, 60.0)


@query(P + """,
    c AS (
        SELECT floor((a.t - b.t + 600e0) / 60e0)::BIGINT AS bin, count(*) AS n FROM p a JOIN p b
        ON a.event_type = 'purchase' AND b.event_type = 'purchase' AND a.t BETWEEN b.t - 601e0 AND b.t + 601e0
        WHERE abs(a.t - b.t) <= 600e0 GROUP BY ALL)
    SELECT b.bin::BIGINT AS bin, -600e0 + b.bin * 60e0 AS bin_start, coalesce(c.n, 0) AS count FROM range(20) b(bin) LEFT JOIN c USING (bin)""")
def q_autocorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = of_type(spark, sf_dir, "purchase")
    return spikes.cross_correlogram(train, train, 600.0, 60.0)


# Intervals between spikes, rates ---------------------------------------------------------------------------------------

ISI_SQL = P + """
    SELECT user_id, event_id, isi FROM (SELECT user_id, event_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS isi FROM p) WHERE isi IS NOT NULL"""


@query(ISI_SQL)
def q_isi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.intervals_between(trains(spark, sf_dir), ["user_id"], ["t", "event_id"]).select("user_id", "event_id", "isi")


@query(P + """,
    i AS (SELECT * FROM (SELECT event_type, t - lag(t) OVER (PARTITION BY event_type ORDER BY t, event_id) AS isi FROM p) WHERE isi IS NOT NULL),
    g AS (SELECT event_type, ceil(max(isi) / 600e0)::BIGINT + 1 AS n FROM i GROUP BY event_type),
    c AS (SELECT event_type, floor(isi / 600e0)::BIGINT AS bin, count(*) AS k FROM i GROUP BY ALL)
    SELECT g.event_type, b.bin::BIGINT AS bin, b.bin * 600e0 AS bin_start, coalesce(c.k, 0) AS count
    FROM g CROSS JOIN LATERAL (SELECT unnest(range(g.n)) AS bin) b LEFT JOIN c ON c.event_type = g.event_type AND c.bin = b.bin""")
def q_isi_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.isi_histogram(trains(spark, sf_dir), 600.0, ["event_type"], ["t", "event_id"])


def _smooth_sql() -> str:
    w = spikes.gaussian_weights(2.0)
    r = len(w) // 2
    terms = [(f"coalesce(lag(count, {r - k}) OVER (ORDER BY bin), 0)" if k < r else "count" if k == r else f"coalesce(lead(count, {k - r}) OVER (ORDER BY bin), 0)") + f" * {x!r}::DOUBLE" for k, x in enumerate(w)]
    total = "0e0"
    for term in terms:
        total = f"({total} + {term})"
    return P + f""",
        c AS (SELECT floor(t / 3600e0)::BIGINT AS bin, count(*) AS n FROM p WHERE event_type = 'view' GROUP BY ALL),
        b AS (SELECT r.bin::BIGINT AS bin, coalesce(c.n, 0) AS count FROM range(720) r(bin) LEFT JOIN c USING (bin))
        SELECT bin, count, {total} / 3600e0 AS rate FROM b"""


@query(_smooth_sql())
def q_smooth_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = of_type(spark, sf_dir, "view").groupBy(F.floor(F.col("t") / 3600.0).alias("bin")).agg(F.count("*").alias("n"))
    bins = spark.range(720).withColumnRenamed("id", "bin").join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("long")).alias("count"))
    return spikes.smooth_rate(bins, 3600.0, 2.0)


@query(P + """,
    v AS (SELECT user_id, dense_rank() OVER (ORDER BY user_id) - 1 AS var_index FROM (SELECT DISTINCT user_id FROM p)),
    r AS (SELECT v.var_index, p.user_id::VARCHAR AS var_name, count(*) AS n_spikes, count(*) / 2592000e0 AS rate_hz FROM p JOIN v USING (user_id) GROUP BY ALL)
    SELECT var_name, n_spikes, rate_hz, row_number() OVER (ORDER BY rate_hz DESC, var_index)::INTEGER AS rank FROM r""")
def q_units_by_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = trains(spark, sf_dir).select(F.col("user_id").cast("string").alias("var_name"), "user_id")
    variables = points.distinct().select("var_name", F.lit("neuron").alias("kind"), F.row_number().over(Window.orderBy("user_id")).alias("var_index"))
    return spikes.units_by_rate(variables, points, 0.0, 2592000.0)


@query(P + """,
    r AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'a' ELSE 'b' END AS session_id, event_type AS var_name, count(*) AS n_spikes, count(*) / 2592000e0 AS rate_hz FROM p GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rate_hz DESC, var_name)::INTEGER AS rank FROM r""")
def q_units_by_rate_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two recordings with units of the same names."""
    points = trains(spark, sf_dir).select(F.when(F.col("user_id") % 3 == 0, "a").otherwise("b").alias("session_id"), F.col("event_type").alias("var_name"))
    variables = points.distinct().withColumn("var_index", F.row_number().over(Window.partitionBy("session_id").orderBy("var_name"))).withColumn("kind", F.lit("neuron"))
    return spikes.units_by_rate(variables, points, 0.0, 2592000.0)


@query("""SELECT session_id, 'unit_' || label AS var_name, row_number() OVER (PARTITION BY session_id, label ORDER BY vec_id)::BIGINT - 1 AS idx, vec_id / 30000e0 AS t
    FROM (SELECT *, CASE WHEN vec_id % 3 = 0 THEN 'a' ELSE 'b' END AS session_id FROM embeddings)""")
def q_units_of_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted spikes of two recordings as neurons."""
    spikes_ = table(spark, sf_dir, "embeddings").select(F.when(F.col("vec_id") % 3 == 0, "a").otherwise("b").alias("session_id"), F.col("label").alias("unit"), (F.col("vec_id") / 30000.0).alias("t"))
    return spike_sorting.units(spikes_, by=["session_id"])


# Filters and ranges ----------------------------------------------------------------------------------------------------


@query(P + " SELECT event_id, t FROM p WHERE event_type = 'view' AND t BETWEEN 86400e0 AND 172800e0")
def q_time_filter_neuron(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.in_range(of_type(spark, sf_dir, "view"), 86400.0, 172800.0).select("event_id", "t")


@query(P + " SELECT event_id, t FROM p WHERE event_type = 'signup' AND t BETWEEN 86400e0 AND 864000e0")
def q_time_filter_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.in_range(of_type(spark, sf_dir, "signup"), 86400.0, 864000.0).select("event_id", "t")


@query(P + " SELECT event_id, t, row_number() OVER (ORDER BY t, event_id)::BIGINT - 1 AS place FROM p WHERE event_type = 'error'")
def q_sort_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("event_type").orderBy("t", "event_id")).cast("long") - 1
    return spikes.sorted_points(of_type(spark, sf_dir, "error").withColumn("place", place)).select("event_id", "t", "place")


INDEXED = P + ", i AS (SELECT event_type, event_id, t, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id)::BIGINT - 1 AS idx FROM p)"


def indexed(spark: SparkSession, sf_dir: str, *also: str) -> DataFrame:
    return numbered_once(trains(spark, sf_dir).select("event_type", "event_id", "t", *also), ["event_type"], ["t", "event_id"], "idx")


@query(INDEXED + " SELECT event_type, idx, t FROM i WHERE idx < 25")
def q_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.first_points(indexed(spark, sf_dir), 25).select("event_type", "idx", "t")


@query(INDEXED + " SELECT event_type, idx, t FROM i WHERE idx >= 100 AND idx < 150")
def q_idx_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.point_range(indexed(spark, sf_dir), 100, 50).select("event_type", "idx", "t")


@query(INDEXED + " SELECT event_type, idx // 256 AS chunk, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM i GROUP BY ALL")
def q_stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk = F.floor(F.col("idx") / 256).alias("chunk")
    return indexed(spark, sf_dir).groupBy("event_type", chunk).agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


# Sessions --------------------------------------------------------------------------------------------------------------

#: Two variables of each type: spikes of even users are a neuron, of odd users an event. Ticks are microseconds.
SESSION_SQL = P + """,
    points AS (
        SELECT event_type || '_' || (user_id % 2) AS var_name, CASE WHEN user_id % 2 = 0 THEN 'neuron' ELSE 'event' END AS kind, t, user_id,
            row_number() OVER (PARTITION BY event_type, user_id % 2 ORDER BY t, event_id)::BIGINT - 1 AS idx FROM p),
    vars AS (
        SELECT *, row_number() OVER (ORDER BY var_name)::INTEGER - 1 AS var_index
        FROM (SELECT var_name, kind, count(*) AS count, greatest(0, max(t)) AS max_t FROM points GROUP BY var_name, kind))"""


def session_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("user_id") % 2 == 0, "neuron").otherwise("event")
    name = F.concat("event_type", F.lit("_"), F.col("user_id") % 2)
    return numbered_once(trains(spark, sf_dir).select(name.alias("var_name"), kind.alias("kind"), "t", "event_id", "user_id"), ["var_name"], ["t", "event_id"], "idx")


def session(spark: SparkSession, frequency: float, **tables: DataFrame) -> Session:
    """One session, "rec", of tables (var_name, ...) with the columns that matter; `variables` lists var_name, kind, count and what else differs."""
    names = tables["variables"].withColumn("var_index", F.row_number().over(Window.orderBy("var_name")) - 1)  # one row a variable
    tables["variables"] = _filled(names, VARIABLES, {"cont_data_type": 1, "ad_to_mv": 1.0, "version": 500, "metadata": "{}", "units": ""})
    head = [{"session_id": "rec", "path": "", "format": "", "file_version": 0, "comment": "events", "timestamp_frequency_hz": frequency, "beg_seconds": 0.0, "end_seconds": 0.0, "metadata": "{}"}]
    given = {t: _filled(tables[t], TABLES[t], {}) if t in tables and t != "variables" else spark.createDataFrame([], TABLES[t]) for t in TABLES if t not in ("sessions", "variables")}
    return Session(sessions=spark.createDataFrame(head, TABLES["sessions"]), variables=tables["variables"], **given).with_end()


def _filled(rows: DataFrame, schema: str, defaults: dict) -> DataFrame:
    """Rows with all columns of the schema: numbers not given are 0."""
    out = []
    for name, kind in (c.split(" ") for c in schema.split(", ")):
        value = F.lit("rec") if name == "session_id" else F.col(name) if name in rows.columns else F.lit(defaults.get(name, None if kind == "string" else 0))
        out.append(value.cast(kind).alias(name))
    return rows.select(*out)


def counted(points: DataFrame, *keys: str) -> DataFrame:
    return points.groupBy("var_name", *keys).agg(F.count("*").alias("count"))


def recording(spark: SparkSession, sf_dir: str, frequency: float = 1e6) -> Session:
    points = session_points(spark, sf_dir)
    return session(spark, frequency, variables=counted(points, "kind"), points=points.withColumn("tick", seconds_to_ticks(F.col("t"), frequency)))


@query(SESSION_SQL + " SELECT 'rec' AS session_id, 'events' AS comment, 1e6::DOUBLE AS timestamp_frequency_hz, 0e0 AS beg_seconds, max(max_t) AS end_seconds, count(*) FILTER (kind = 'neuron') AS n_neuron, count(*) FILTER (kind = 'event') AS n_event, 0::BIGINT AS n_continuous, 0::BIGINT AS n_interval FROM vars")
def q_session_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recording(spark, sf_dir).info()


@query(SESSION_SQL + " SELECT 'rec' AS session_id, kind, var_name, row_number() OVER (PARTITION BY kind ORDER BY var_name)::INTEGER - 1 AS place FROM vars")
def q_variable_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recording(spark, sf_dir).variable_names()


@query(SESSION_SQL + " SELECT DISTINCT var_name FROM vars WHERE kind IN ('neuron', 'event') ORDER BY var_name")
def q_export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export_names(recording(spark, sf_dir).variables)


def waves_session(spark: SparkSession, sf_dir: str) -> Session:
    """Each label's vectors as a waveform variable, float samples at 30 kHz."""
    name = F.concat(F.lit("wave_"), "label")
    idx = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long") - 1
    waves = table(spark, sf_dir, "embeddings").select(name.alias("var_name"), idx.alias("idx"), (F.col("vec_id") / 1000.0).alias("t"), F.col("embedding").alias("samples"))
    variables = counted(waves).select("var_name", "count", F.lit("waveform").alias("kind"), F.lit(30000.0).alias("sampling_rate"), F.lit(64).alias("n_points_wave"))
    return session(spark, 1000.0, variables=variables, waveforms=waves)


@query(SESSION_SQL + """
    SELECT var_name, kind, count, max_t FROM vars
    UNION ALL SELECT 'wave_' || label, 'waveform', count(*), greatest(0, max(vec_id / 1000e0 + 63 / 30000e0)) FROM embeddings GROUP BY label""")
def q_max_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [maximum_timestamps(s) for s in (recording(spark, sf_dir), waves_session(spark, sf_dir))]
    return both[0].unionByName(both[1]).drop("session_id")


@query(SESSION_SQL + """, s AS (SELECT var_name, idx, t, max(t) OVER () AS end_seconds FROM points WHERE var_name IN ('view_0', 'click_1'))
    SELECT var_name, idx, t, CASE var_name WHEN 'view_0' THEN 0 ELSE 1 END AS var_index, end_seconds FROM s""")
def q_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = recording(spark, sf_dir).subset(["view_0", "click_1"])
    return s.points.join(s.variables.select("var_name", "var_index"), "var_name").join(s.sessions.select("session_id", "end_seconds"), "session_id").select("var_name", "idx", "t", "var_index", "end_seconds")


@query(SESSION_SQL + " SELECT CASE WHEN var_name = 'view_0' THEN 'unit_a' ELSE var_name END AS var_name, count(*) AS count FROM points GROUP BY ALL")
def q_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(recording(spark, sf_dir).rename("view_0", "unit_a").points)


@query(SESSION_SQL + " SELECT var_name, count(*) AS count, (SELECT max(t) FROM points) AS end_seconds FROM points WHERE var_name <> 'view_0' GROUP BY ALL")
def q_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = recording(spark, sf_dir).delete("view_0")
    return counted(s.points).join(F.broadcast(s.sessions.select("end_seconds")))  # one session


def halves(spark: SparkSession, sf_dir: str) -> list[Session]:
    points = session_points(spark, sf_dir)
    return [session(spark, 1e6, variables=counted(points.where(F.col("kind") == k), "kind"), points=points.where(F.col("kind") == k)) for k in ("neuron", "event")]


@query(SESSION_SQL + " SELECT var_name, kind, count, row_number() OVER (ORDER BY kind DESC, var_name)::INTEGER - 1 AS var_index, (SELECT max(t) FROM points) AS end_seconds FROM vars")
def q_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    neurons, events = halves(spark, sf_dir)
    s = neurons.merge(events)
    return s.variables.join(s.sessions.select("session_id", "end_seconds"), "session_id").select("var_name", "kind", "count", "var_index", "end_seconds")


@query(SESSION_SQL + f""",
    a AS (SELECT * FROM vars WHERE var_name <> 'click_0'),
    b AS (SELECT var_name, kind, count(*) AS count, max(t) AS max_t FROM points WHERE var_name <> 'click_1' AND NOT (var_name = 'view_0' AND t < 86400) GROUP BY ALL)
    SELECT * FROM (SELECT var_name, CASE WHEN b.kind IS NULL THEN 'only_in_a' WHEN a.kind IS NULL THEN 'only_in_b'
        WHEN a.kind <> b.kind OR a.count <> b.count OR abs(a.max_t - b.max_t) > {EPSILON!r}::DOUBLE THEN 'changed' END AS status FROM a FULL JOIN b USING (var_name))
    WHERE status IS NOT NULL""")
def q_session_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = recording(spark, sf_dir)
    b = s.delete("click_1")
    return diff(s.delete("click_0"), replace(b, points=b.points.where("NOT (var_name = 'view_0' AND t < 86400)")))


@query(SESSION_SQL + """,
    n AS (SELECT count(*) AS n_events FROM points WHERE var_name = 'signup_1'),
    c AS (
        SELECT floor((s.t - e.t - -3600e0) / 300e0)::BIGINT AS bin, count(*) AS n FROM points s JOIN points e
        ON s.var_name = 'view_0' AND e.var_name = 'signup_1' AND s.t >= e.t + -3600e0 AND s.t <= e.t + 7200e0
        WHERE s.t BETWEEN 86400e0 AND 1728000e0 AND s.t - e.t >= -3600e0 AND s.t - e.t < 7200e0 GROUP BY ALL)
    SELECT b.bin::BIGINT AS bin, -3600e0 + b.bin * 300e0 AS bin_start, coalesce(c.n, 0) AS count, coalesce(c.n, 0) / (n_events * 300e0) AS rate_hz, n_events
    FROM range(36) b(bin) CROSS JOIN n LEFT JOIN c USING (bin)""")
def q_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyse(recording(spark, sf_dir), "view_0", "signup_1", -3600.0, 7200.0, 300.0, spike_range=(86400.0, 1728000.0)).psth


@query("SELECT 'ch_' || (user_id % 8) AS var_name, row_number() OVER (PARTITION BY user_id % 8 ORDER BY epoch_us(ts))::BIGINT - 1 AS idx, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e3::DOUBLE / 1000e0 AS t FROM events")
def q_detected_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) / 1e3D")
    return channel_neurons(table(spark, sf_dir, "events").select((F.col("user_id") % 8).cast("int").alias("channel"), ms.alias("time_ms"))).select("var_name", "idx", "t")


# Session files: written by all tasks, and read back by several -----------------------------------------------------------------------------


def written(s: Session, layout: str = "wide", **options) -> Session:
    """The session from files that all tasks have written, no task a whole variable or file, and that several tasks read."""
    from ..sources.sink import write_files
    from ..storage import shared_folder

    spark = s.sessions.sparkSession
    folder = f"{shared_folder(spark).removeprefix('file:')}/files-{uuid.uuid4()}"
    write_files(s, folder, ".bin", WriteOptions(layout=layout))
    return read_session(spark, f"{folder}/*.bin", **options)


def read_back(s: Session, table: str, layout: str = "wide", **options) -> DataFrame:
    return getattr(written(s, layout, **options), table)


@query(SESSION_SQL + " SELECT var_name, kind, idx, round(t * 1e6)::BIGINT AS tick, round(t * 1e6)::BIGINT / 1e6::DOUBLE AS t FROM points")
def q_file_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(recording(spark, sf_dir), "points").drop("session_id")


@query(SESSION_SQL + " SELECT var_name, kind, idx, floor(t * 100e0 + 0.5e0)::BIGINT AS tick, floor(t * 100e0 + 0.5e0)::BIGINT / 100e0 AS t FROM points")
def q_file_points_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(recording(spark, sf_dir, 100.0), "points", "narrow").drop("session_id")


@query(SESSION_SQL + " SELECT idx, round(t * 1e6)::BIGINT / 1e6::DOUBLE AS t FROM points WHERE var_name = 'view_0' AND idx BETWEEN 10 AND 39")
def q_file_some_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One variable's rows 10 to 39; payload of others, and its other rows, are passed over."""
    return read_back(recording(spark, sf_dir), "points", names=["view_0"], from_row=10, before_row=40).select("idx", "t")


@query(SESSION_SQL + """
    SELECT var_index, var_name, kind, count, 1 AS ts_data_type, 500 AS version,
        (356 + 244 * (SELECT count(*) FROM vars) + 8 * coalesce(sum(count) OVER (ORDER BY var_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS data_offset FROM vars""")
def q_file_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(recording(spark, sf_dir), "variables").select("var_index", "var_name", "kind", "count", "ts_data_type", "version", "data_offset")


@query(SESSION_SQL + " SELECT 'wide' AS format, 502 AS file_version, 'events' AS comment, 1e6::DOUBLE AS timestamp_frequency_hz, 0e0 AS beg_seconds, max(max_t) AS end_seconds FROM vars")
def q_file_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(recording(spark, sf_dir), "sessions").drop("session_id", "path", "metadata")


@query(SESSION_SQL + " SELECT var_name, 0 AS unit, 0 AS wire, 0e0 AS x, 0e0 AS y FROM vars WHERE kind = 'neuron' UNION ALL SELECT var_name, NULL, NULL, NULL, NULL FROM vars WHERE kind = 'event'")
def q_file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = recording(spark, sf_dir)
    return replace(s, variables=read_back(s, "variables")).metadata().drop("session_id", "raw")


@query(P + """, i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id)::BIGINT - 1 AS idx FROM p)
    SELECT event_type AS var_name, idx, round(t * 1e6)::BIGINT / 1e6::DOUBLE AS t, 0 AS field_index, 'k' AS field_name, (props->>'$.k')::BIGINT AS num, NULL::VARCHAR AS str FROM i
    UNION ALL SELECT event_type, idx, round(t * 1e6)::BIGINT / 1e6::DOUBLE, 1, 'user', NULL, 'u' || user_id FROM i""")
def q_file_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text markers: cells that are numbers come back as numbers, those of the other field as texts."""
    rows = indexed(spark, sf_dir, "props", "user_id").select(F.col("event_type").alias("var_name"), "idx", "t", F.get_json_object("props", "$.k").alias("k"), F.concat(F.lit("u"), "user_id").alias("u"))
    cells = F.explode(F.array(F.struct(F.lit(0).alias("f"), F.lit("k").alias("n"), F.col("k").alias("s")), F.struct(F.lit(1).alias("f"), F.lit("user").alias("n"), F.col("u").alias("s"))))
    markers = rows.select("var_name", "idx", "t", cells.alias("c")).select("var_name", "idx", "t", F.col("c.f").alias("field_index"), F.col("c.n").alias("field_name"), F.lit(None).cast("long").alias("num"), F.col("c.s").alias("str"))
    variables = counted(rows).select("var_name", "count", F.lit("marker").alias("kind"), F.lit(2).alias("n_markers"))
    return read_back(session(spark, 1e6, variables=variables, markers=markers), "markers").drop("session_id")


WAVES_SQL = """WITH w AS (SELECT 'wave_' || label AS var_name, row_number() OVER (PARTITION BY label ORDER BY vec_id)::BIGINT - 1 AS idx, vec_id / 1000e0 AS t, embedding FROM embeddings),
    x AS (SELECT var_name, idx, t, generate_subscripts(embedding, 1)::INTEGER - 1 AS pos, unnest(embedding) AS x FROM w)"""


@query(WAVES_SQL + " SELECT * FROM x")
def q_file_waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(waves_session(spark, sf_dir), "waveforms").select("var_name", "idx", "t", F.posexplode("samples").alias("pos", "x"))


WAVES_I16_SQL = WAVES_SQL + """, s AS (SELECT var_name, max(abs(x::DOUBLE)) / 32767 AS scale FROM x GROUP BY var_name),
    q AS (SELECT var_name, idx, t, pos, scale, x::DOUBLE / scale AS y FROM x JOIN s USING (var_name))
    SELECT var_name, idx, t, pos, (greatest(-32768, least(32767, trunc(y + CASE WHEN y >= 0 THEN 0.5e0 ELSE -0.5e0 END)))::SMALLINT * scale)::FLOAT AS x FROM q"""


@query(WAVES_I16_SQL)
def q_file_waveforms_i16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of 16 bits, scaled by the range of each variable."""
    return read_back(waves_session(spark, sf_dir), "waveforms", "narrow").select("var_name", "idx", "t", F.posexplode("samples").alias("pos", "x"))


def signals_session(spark: SparkSession, sf_dir: str) -> Session:
    rows = indexed(spark, sf_dir, "value").withColumn("_c", F.floor(F.col("idx") / 1000))
    chunks = rows.groupBy(F.col("event_type").alias("var_name"), "_c").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "value"))), lambda v: v["value"]).alias("values"))
    signal = chunks.select("var_name", F.lit(0).alias("fragment"), (F.col("_c") * 1000 / 1000.0).alias("t0"), (F.col("_c") * 1000).alias("first_sample"), F.lit(1000.0).alias("sampling_rate"), "values")
    variables = rows.groupBy(F.col("event_type").alias("var_name")).agg(F.count("*").alias("n_points_wave")).select("var_name", "n_points_wave", F.lit(1).alias("count"), F.lit("continuous").alias("kind"), F.lit(1000.0).alias("sampling_rate"))
    return session(spark, 1e6, variables=variables, continuous=signal)


@query(P + " SELECT event_type AS var_name, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id)::BIGINT - 1 AS sample, value::FLOAT::DOUBLE AS value, 0 AS fragment FROM p")
def q_file_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type's values as a signal of one fragment, given in rows of 1,000 samples."""
    back = read_back(signals_session(spark, sf_dir), "continuous")
    return back.select("var_name", "fragment", "first_sample", F.posexplode("values").alias("p", "value")).select("var_name", (F.col("first_sample") + F.col("p")).alias("sample"), "value", "fragment")


@query("""
    SELECT row_number() OVER (ORDER BY t, event_id)::BIGINT - 1 AS sample, value::FLOAT::DOUBLE AS value FROM (SELECT event_id, value, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6::DOUBLE AS t FROM events WHERE event_type = 'view')
    QUALIFY sample BETWEEN 150 AND 1249""")
def q_file_samples_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled samples 150 to 1,249 of one signal; the rest of it, and the other signals, are passed over."""
    back = read_back(signals_session(spark, sf_dir), "continuous", names=["view"], from_row=150, before_row=1250).select("first_sample", F.posexplode("values").alias("p", "value"))
    return back.select((F.col("first_sample") + F.col("p")).alias("sample"), "value").where("sample BETWEEN 150 AND 1249")


def intervals_session(spark: SparkSession, sf_dir: str) -> Session:
    """From an order to the shipping of its lines, by line number."""
    since = lambda c: F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1990-01-01 00:00:00', cast({c} as timestamp_ntz))").cast("double")
    both = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate >= o_orderdate")
    rows = both.select(F.concat(F.lit("line_"), "l_linenumber").alias("var_name"), "l_orderkey", "l_linenumber", since("o_orderdate").alias("t_start"), since("l_shipdate").alias("t_end"))
    intervals = numbered_once(rows, ["var_name"], ["t_start", "l_orderkey", "l_linenumber", "t_end"], "idx")
    return session(spark, 1.0, variables=counted(intervals).withColumn("kind", F.lit("interval")), intervals=intervals)


INTERVALS_SQL = """
    WITH i AS (SELECT 'line_' || l_linenumber AS var_name, l_orderkey, l_linenumber, datediff('second', TIMESTAMP '1990-01-01', o_orderdate)::DOUBLE AS a, datediff('second', TIMESTAMP '1990-01-01', l_shipdate)::DOUBLE AS b
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate >= o_orderdate)
    SELECT var_name, row_number() OVER (PARTITION BY var_name ORDER BY a, l_orderkey, l_linenumber, b)::BIGINT - 1 AS idx, a AS t_start, b AS t_end FROM i"""


@query(INTERVALS_SQL)
def q_file_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(intervals_session(spark, sf_dir), "intervals").drop("session_id")


@query(P + " SELECT event_type AS var_name, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id)::BIGINT - 1 AS idx, value AS weight FROM p")
def q_file_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = indexed(spark, sf_dir, "value").select(F.col("event_type").alias("var_name"), "idx", F.col("value").alias("weight"))
    s = session(spark, 1.0, variables=counted(weights).withColumn("kind", F.lit("population")), population=weights)
    return read_back(s, "population").drop("session_id")


# Session files written by all tasks, and read by several ------------------------------------------------------------------


@query(SESSION_SQL + " SELECT var_name, kind, idx, round(t * 1e6)::BIGINT AS tick, t FROM points")
def q_written_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(recording(spark, sf_dir)).points.drop("session_id")


@query(P + " SELECT event_type AS var_name, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id)::BIGINT - 1 AS sample, value::FLOAT::DOUBLE AS value, 0 AS fragment FROM p")
def q_written_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = written(signals_session(spark, sf_dir)).continuous
    return back.select("var_name", "fragment", "first_sample", F.posexplode("values").alias("p", "value")).select("var_name", (F.col("first_sample") + F.col("p")).alias("sample"), "value", "fragment")


@query(WAVES_I16_SQL)
def q_written_waveforms_i16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of 16 bits: the range of each variable is known before its rows are written."""
    return written(waves_session(spark, sf_dir), "narrow").waveforms.select("var_name", "idx", "t", F.posexplode("samples").alias("pos", "x"))


@query("""
    SELECT l_orderkey, l_linenumber, datediff('second', o_orderdate, l_shipdate)::BIGINT AS seconds
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate""")
def q_intervals_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", F.col("o_orderdate").alias("t_start"), F.col("l_shipdate").alias("t_end"))
    return invalid_intervals(both).select("l_orderkey", "l_linenumber", F.expr("timestampdiff(SECOND, t_start, t_end)").alias("seconds"))


@query("""
    WITH s AS (SELECT var_index, bytes FROM (SELECT label AS var_index, count(*) * (8 + 64 * 4) AS bytes FROM embeddings GROUP BY label))
    SELECT var_index, bytes, (coalesce(sum(bytes) OVER (ORDER BY var_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 356)::BIGINT AS data_offset FROM s""")
def q_write_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..session import write_offsets

    sizes = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("var_index")).agg((F.count("*") * (8 + 64 * 4)).alias("bytes"))
    return write_offsets(sizes, 356)


# Fragments and markers -------------------------------------------------------------------------------------------------

FRAGMENTS_SQL = P + """,
    h AS (SELECT DISTINCT user_id, floor(t / 3600e0)::BIGINT AS tick FROM p),
    m AS (SELECT *, row_number() OVER w - 1 AS i, CASE WHEN lag(tick) OVER w IS NULL OR tick <> lag(tick) OVER w + 1 THEN 1 ELSE 0 END AS new FROM h WINDOW w AS (PARTITION BY user_id ORDER BY tick)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY tick) - 1 AS fragment FROM m)"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trains(spark, sf_dir).select("user_id", F.floor(F.col("t") / 3600.0).alias("tick")).distinct()


@query(FRAGMENTS_SQL + " SELECT user_id, fragment::BIGINT AS fragment, min(tick) AS first_tick, min(i)::BIGINT AS first_index, count(*) AS count FROM r GROUP BY ALL")
def q_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.fragments(hourly(spark, sf_dir), 1, ["user_id"])


@query(FRAGMENTS_SQL + """, f AS (SELECT user_id, fragment, min(i)::BIGINT AS first_index FROM r GROUP BY ALL), n AS (SELECT user_id, count(*) AS n_samples FROM h GROUP BY user_id)
    SELECT user_id, first_index, n_samples, (coalesce(lead(first_index) OVER (PARTITION BY user_id ORDER BY first_index), n_samples) - first_index)::BIGINT AS count FROM f JOIN n USING (user_id)""")
def q_fragment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = hourly(spark, sf_dir)
    n = ticks.groupBy("user_id").agg(F.count("*").alias("n_samples"))
    starts = signals.fragments(ticks, 1, ["user_id"]).select("user_id", "first_index").join(n, "user_id")
    return signals.fragment_counts(starts, "n_samples", ["user_id"])


@query("SELECT event_id, (props->>'$.k')::BIGINT AS num FROM events")
def q_marker_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", marker_number(F.get_json_object("props", "$.k")).alias("num"))


@query("SELECT event_type AS var_name, 'k' AS field_name, bool_and(regexp_full_match(props->>'$.k', '\\+?[0-9]+')) AS numeric, greatest(6, max(strlen(props->>'$.k')) + 1) AS cell_bytes FROM events GROUP BY event_type")
def q_marker_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return marker_fields(table(spark, sf_dir, "events").select(F.col("event_type").alias("var_name"), F.lit("k").alias("field_name"), k.alias("cell")))


# Waveforms and templates -----------------------------------------------------------------------------------------------

TEMPLATES_SQL = """
    WITH x AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
    b AS (SELECT label, pos, vec_id // 4096 AS blk, list_reduce(list_prepend(0e0, list(x ORDER BY vec_id)), lambda a, b: a + b) AS s, count(*) AS n FROM x GROUP BY ALL),
    m AS (SELECT label, pos, list_reduce(list_prepend(0e0, list(s ORDER BY blk)), lambda a, b: a + b) / sum(n) AS mean FROM b GROUP BY ALL),
    t AS (SELECT label, list(mean ORDER BY pos) AS template FROM m GROUP BY label),
    w AS (SELECT vec_id, label AS own, list_transform(embedding, lambda v: v::DOUBLE) AS s FROM embeddings),
    d AS (
        SELECT vec_id, own, t.label AS template_label,
            list_reduce(list_prepend(0e0, list_transform(list_zip(s, template), lambda z: z[1] * z[2])), lambda a, b: a + b) AS st,
            list_reduce(list_prepend(0e0, list_transform(s, lambda z: z * z)), lambda a, b: a + b) AS ss,
            list_reduce(list_prepend(0e0, list_transform(template, lambda z: z * z)), lambda a, b: a + b) AS tt,
            list_reduce(list_prepend(0e0, list_transform(list_zip(s, template), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), lambda a, b: a + b) AS dd
        FROM w CROSS JOIN t),
    c AS (SELECT *, CASE WHEN ss <= 1e-12 OR tt <= 1e-12 THEN 0e0 ELSE st / (sqrt(ss) * sqrt(tt)) END AS corr FROM d)"""


def waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), "label", F.col("embedding").alias("samples"))


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.mean_waveforms(waveforms(spark, sf_dir))


@query(TEMPLATES_SQL + " SELECT label, pos::INTEGER AS pos, mean FROM m")
def q_mean_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates(spark, sf_dir).select("label", F.posexplode("template").alias("pos", "mean"))


@query(TEMPLATES_SQL + " SELECT vec_id AS idx, template_label, corr FROM c")
def q_template_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.template_correlations(waveforms(spark, sf_dir), templates(spark, sf_dir))


@query(TEMPLATES_SQL + " SELECT idx, template_label, corr FROM (SELECT vec_id AS idx, template_label, corr, row_number() OVER (PARTITION BY vec_id ORDER BY corr DESC, template_label DESC) AS r FROM c) WHERE r = 1")
def q_nearest_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.nearest_template(waveforms(spark, sf_dir), templates(spark, sf_dir))


@query(TEMPLATES_SQL + """,
    f AS (SELECT own, vec_id // 4096 AS blk, list_reduce(list_prepend(0e0, list(dd ORDER BY vec_id)), lambda a, b: a + b) AS s, count(*) * 64 AS k FROM d WHERE own = template_label GROUP BY ALL),
    e AS (SELECT own, list_reduce(list_prepend(0e0, list(s ORDER BY blk)), lambda a, b: a + b) AS sq, sum(k) AS n FROM f GROUP BY own)
    SELECT own AS label, list_max(list_transform(template, lambda z: abs(z))) / greatest(sqrt(sq / n), 1e-9::DOUBLE) AS snr FROM e JOIN t ON t.label = own""")
def q_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.cluster_snr(waveforms(spark, sf_dir), templates(spark, sf_dir))


@query(TEMPLATES_SQL + " SELECT vec_id AS idx, sqrt(dd) AS distance FROM d WHERE own = template_label")
def q_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waveforms(spark, sf_dir).join(templates(spark, sf_dir), "label").select("idx", l2(F.col("samples"), F.col("template")).alias("distance"))


@query("SELECT vec_id AS idx, label, generate_subscripts(embedding, 1)::INTEGER - 1 AS pos, unnest(embedding) AS x FROM embeddings WHERE vec_id = 42")
def q_waveform_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waveforms(spark, sf_dir).where("idx = 42").select("idx", "label", F.posexplode("samples").alias("pos", "x"))


@query("""
    SELECT vec_id AS unit, peak AS sample, embedding[greatest(peak - 4, 0) + 1 : greatest(peak - 4, 0) + 10] AS snippet
    FROM (SELECT vec_id, embedding, list_position(embedding, list_max(embedding)) - 1 AS peak FROM embeddings) WHERE greatest(peak - 4, 0) + 10 <= 64""")
def q_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = waveforms(spark, sf_dir).select(F.col("idx").alias("unit"), F.col("samples").alias("values"))
    peaks = w.select("unit", (F.array_position("values", F.array_max("values")) - 1).cast("int").alias("sample"))
    return signals.snippets(w, peaks, 4, 10).select("unit", "sample", "snippet")


@query("""
    WITH f AS (SELECT label, min(vec_id) AS f FROM embeddings GROUP BY label), r AS (SELECT label, row_number() OVER (ORDER BY f)::INTEGER - 1 AS new_label FROM f)
    SELECT vec_id AS idx, label, new_label FROM embeddings JOIN r USING (label)""")
def q_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.relabel_contiguous(waveforms(spark, sf_dir).select("idx", "label"))


@query("""
    WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::INTEGER - 1 AS pos FROM embeddings),
    b AS (SELECT pos, vec_id // 4096 AS blk, max(x) FILTER (vec_id = 0) AS own, list_reduce(list_prepend(0e0, list(x ORDER BY vec_id)), lambda a, b: a + b) AS s, count(*) AS n FROM x GROUP BY ALL)
    SELECT pos, max(own) - list_reduce(list_prepend(0e0, list(s ORDER BY blk)), lambda a, b: a + b) / sum(n) AS value FROM b GROUP BY pos""")
def q_car(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is a channel."""
    channels = waveforms(spark, sf_dir).select(F.col("idx").alias("channel"), F.posexplode("samples").alias("pos", "value"))
    return signals.common_average_reference(channels)


@query("SELECT 'unit_' || label AS var_name, row_number() OVER (PARTITION BY label ORDER BY vec_id)::BIGINT - 1 AS idx, vec_id / 30000e0 AS t FROM embeddings WHERE label <> 0")
def q_phy_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.phy import cluster_points

    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("double").alias("sample"), F.col("label").alias("cluster"))
    return cluster_points(rows, 30000.0, session_id="phy").select("var_name", "idx", "t")


# Sampled signal --------------------------------------------------------------------------------------------------------

SIGMA_SQL = P + """,
    n AS (SELECT count(*) AS n FROM p),
    s AS (SELECT value AS x FROM (SELECT value, row_number() OVER (ORDER BY t, event_id) - 1 AS i FROM p) , n WHERE n <= 50000 OR i % (n // 50000) = 0),
    m AS (SELECT x AS median FROM (SELECT x, row_number() OVER (ORDER BY x) - 1 AS r, count(*) OVER () AS k FROM s) WHERE r = k // 2),
    d AS (SELECT median, abs(x - median) AS d FROM s, m)
    SELECT median, greatest(d, 1e-9::DOUBLE) * 1.4826e0 AS sigma FROM (SELECT *, row_number() OVER (ORDER BY d) - 1 AS r, count(*) OVER () AS k FROM d) WHERE r = k // 2"""


@query(SIGMA_SQL)
def q_robust_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.robust_sigma(trains(spark, sf_dir), (), "value", ["t", "event_id"])


PEAKS_SQL = P + """,
    k AS (SELECT user_id, event_id, value, row_number() OVER w - 1 AS sample, abs(value) AS x, abs(lag(value) OVER w) AS b, abs(lead(value) OVER w) AS a FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
    peaks AS (SELECT * FROM k WHERE x > 100e0 AND x >= b AND x >= a)"""


def peaks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.local_peaks(trains(spark, sf_dir), 100.0, ["user_id"], ["t", "event_id"])


@query(PEAKS_SQL + " SELECT user_id, event_id, value, sample::BIGINT AS sample FROM peaks")
def q_local_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks_of(spark, sf_dir).select("user_id", "event_id", "value", "sample")


@query("WITH RECURSIVE" + PEAKS_SQL.removeprefix("WITH") + """,
    g(user_id, sample) AS (
        SELECT user_id, min(sample) FROM peaks GROUP BY user_id
        UNION ALL SELECT user_id, nxt FROM (SELECT g.user_id, (SELECT min(q.sample) FROM peaks q WHERE q.user_id = g.user_id AND q.sample >= g.sample + 5) AS nxt FROM g) WHERE nxt IS NOT NULL)
    SELECT user_id, sample::BIGINT AS sample FROM g""")
def q_refractory_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.suppress_refractory(peaks_of(spark, sf_dir), 5, ["user_id"])


@query("""
    WITH q AS (SELECT event_id, value, greatest(-32768e0, least(32767e0, CASE WHEN (value - 0.2e0) / 0.015e0 >= 0 THEN
        floor((value - 0.2e0) / 0.015e0) + CASE WHEN (value - 0.2e0) / 0.015e0 - floor((value - 0.2e0) / 0.015e0) >= 0.5 THEN 1 ELSE 0 END ELSE
        ceil((value - 0.2e0) / 0.015e0) - CASE WHEN ceil((value - 0.2e0) / 0.015e0) - (value - 0.2e0) / 0.015e0 >= 0.5 THEN 1 ELSE 0 END END))::INTEGER AS raw FROM events)
    SELECT event_id, raw, raw * 0.015e0 + 0.2e0 AS restored FROM q""")
def q_quantise_i16(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select("event_id", quantise_i16(F.col("value"), 0.015, 0.2).alias("raw"))
    return raw.withColumn("restored", dequantise_i16(F.col("raw"), 0.015, 0.2))


@query(P + ", k AS (SELECT event_id, floor(t * 100000e0 + 0.5)::BIGINT AS tick FROM p) SELECT event_id, tick, tick / 100000e0 AS seconds FROM k")
def q_ticks_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = trains(spark, sf_dir).select("event_id", seconds_to_ticks(F.col("t"), 100000.0).alias("tick"))
    return k.withColumn("seconds", ticks_to_seconds(F.col("tick"), 100000.0))


def _bandpass_sql(rate: float, low: float, high: float) -> str:
    rc = [1.0 / (2 * math.pi * f) for f in (low, high)]
    up, down = rc[0] / (rc[0] + 1.0 / rate), (1.0 / rate) / (rc[1] + 1.0 / rate)
    return "WITH RECURSIVE" + P.removeprefix("WITH") + f""",
        s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id)::BIGINT - 1 AS sample, value::FLOAT::DOUBLE AS x FROM p),
        r AS (
            SELECT user_id, sample, x, x AS y, x AS z FROM s WHERE sample = 0
            UNION ALL SELECT user_id, sample, x, y, (z + {down!r}::DOUBLE * (y - z))::FLOAT::DOUBLE
            FROM (SELECT s.user_id, s.sample, s.x, ({up!r}::DOUBLE * (r.y + s.x - r.x))::FLOAT::DOUBLE AS y, r.z FROM r JOIN s ON s.user_id = r.user_id AND s.sample = r.sample + 1))
        SELECT user_id, sample, z::FLOAT AS filtered FROM r"""


@query(_bandpass_sql(1000.0, 10.0, 300.0))
def q_iir_bandpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-order filters keep their state from sample to sample."""
    signal = trains(spark, sf_dir).select("user_id", "t", "event_id", "value")
    return spike_sorting.bandpass(signal, 1000.0, 10.0, 300.0, ["user_id"], ["t", "event_id"])


@query()
def q_sort_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spike sorting of each user's samples as one electrode; clustering is iterative."""
    signal = trains(spark, sf_dir).select("user_id", "t", "event_id", "value")
    options = spike_sorting.SortOptions(sampling_rate=1000.0, highpass=10.0, lowpass=300.0, threshold=1.0, length=9, pre=3, max_clusters=4, min_snr=0.5)
    return spike_sorting.sort_signals(signal, options, ["user_id"], ["t", "event_id"])


@query(ISI_SQL)
def q_streaming_isi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intervals as a stream yields them, read from the table's files in one go."""
    from ..streaming import running_intervals, run_to_end

    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    points = stream.select("user_id", "event_id", F.expr(SECONDS).alias("t"))
    return run_to_end(running_intervals(points, "user_id"), spark).select("user_id", "event_id", "isi")


@query(ISI_SQL)
def q_streaming_isi_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same intervals of a stream of mixed files: rows come up to six hours late, in four waves, and are put in order by the watermark."""
    from ..storage import shared_folder
    from ..streaming.in_order import intervals_in_order, run_closed

    where = f"{shared_folder(spark)}/late-{uuid.uuid4()}"
    points = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(SECONDS).alias("t"))
    delay, span = 6 * 3600, points.agg((F.max("t") - F.min("t")).alias("span"), F.min("t").alias("first")).first()
    if span["span"] is None:
        span = {"span": 0.0, "first": 0.0}
    wide = span["span"] / 4 + 1
    arrival = F.col("t") - span["first"] + F.pmod(F.xxhash64("event_id"), F.lit(delay))
    wave = F.least(F.floor(arrival / wide), F.lit(3))
    for k in range(4):
        points.where(wave == k).write.mode("append").parquet(where)
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 2).parquet(where)
    # Files of one wave come in any order, so rows are late by a wave and the delay at most.
    return run_closed(stream, lambda p: intervals_in_order(p, "user_id", "event_id", f"{int(wide) + 2 * delay + 60} seconds")).select("user_id", "event_id", "isi")


# Series of an interchange file, and back ---------------------------------------------------------------------------------


@query(SESSION_SQL + " SELECT var_name AS path, idx, t, 1e0::DOUBLE AS value FROM points WHERE kind = 'event'")
def q_interchange_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events are series of ones; neurons have none."""
    return series_of(recording(spark, sf_dir)).samples.drop("session_id")


@query(SESSION_SQL + " SELECT 'events' AS comment, (SELECT list(var_name ORDER BY var_name) FROM vars WHERE kind = 'neuron') AS neuron_names")
def q_interchange_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_descriptions(descriptions_of(recording(spark, sf_dir))).select("comment", "neuron_names")


@query(INTERVALS_SQL)
def q_interchange_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of starts and of ends, paired again by name and number."""
    return intervals_of(series_of(intervals_session(spark, sf_dir))).drop("session_id")


@query(P + """, i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id)::BIGINT - 1 AS idx FROM p)
    SELECT event_type AS var_name, idx, t, 0 AS field_index, 'k' AS field_name, (props->>'$.k')::BIGINT AS num, NULL::VARCHAR AS str FROM i
    UNION ALL SELECT event_type, idx, t, 1, 'user', NULL, 'u' || user_id FROM i""")
def q_interchange_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of numbers, which is a series, and one of texts, which stand in the description."""
    rows = indexed(spark, sf_dir, "props", "user_id").select(F.col("event_type").alias("var_name"), "idx", "t", F.get_json_object("props", "$.k").cast("long").alias("k"), F.concat(F.lit("u"), "user_id").alias("u"))
    cells = F.explode(F.array(F.struct(F.lit(0).alias("f"), F.lit("k").alias("n"), F.col("k").alias("x"), F.lit(None).cast("string").alias("s")), F.struct(F.lit(1).alias("f"), F.lit("user").alias("n"), F.lit(None).cast("long").alias("x"), F.col("u").alias("s"))))
    markers = rows.select("var_name", "idx", "t", cells.alias("c")).select("var_name", "idx", "t", F.col("c.f").alias("field_index"), F.col("c.n").alias("field_name"), F.col("c.x").alias("num"), F.col("c.s").alias("str"))
    variables = counted(rows).select("var_name", "count", F.lit("marker").alias("kind"), F.lit(2).alias("n_markers"))
    return markers_of(series_of(session(spark, 1e6, variables=variables, markers=markers))).drop("session_id")


@query(WAVES_SQL + " SELECT * FROM x")
def q_interchange_waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat samples, cut into snippets again."""
    back = waveforms_of(series_of(waves_session(spark, sf_dir)))
    return back.select("var_name", "idx", "t", F.posexplode("samples").alias("pos", "x"))


@query(P + """,
    s AS (SELECT user_id, t, value, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i FROM p),
    u AS (SELECT user_id, bool_and(abs(value - 1) < 1e-9) AS ones, max(t) FILTER (i = 0) AS t0, max(t) FILTER (i = 1) AS t1 FROM s GROUP BY user_id)
    SELECT 'acquisition/user_' || user_id AS path, 'user_' || user_id AS var_name, CASE WHEN ones THEN 'event' ELSE 'continuous' END AS kind,
        CASE WHEN ones THEN NULL WHEN t1 > t0 THEN 1e0 / (t1 - t0) ELSE 1e0 END AS sampling_rate, t0 FROM u""")
def q_interchange_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values with their times as a series without a rate."""
    path = F.concat(F.lit("acquisition/user_"), F.col("user_id"))
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")).cast("long") - 1
    samples = trains(spark, sf_dir).select(F.lit("rec").alias("session_id"), path.alias("path"), idx.alias("idx"), "t", "value")
    number = F.row_number().over(Window.orderBy("path")).cast("long") - 1  # one row a series
    series = samples.select("session_id", "path").distinct().select("session_id", "path", number.alias("place"), F.lit(None).cast("double").alias("rate"), F.lit(None).cast("double").alias("starting_time"))
    nothing = spark.createDataFrame([], "session_id string, description string")
    return plain_series(Interchange(series, samples, nothing)).drop("session_id")


@query(P + """,
    a AS (SELECT event_type || '_' || (user_id % 2) AS path FROM p GROUP BY ALL), r AS (SELECT event_type || '_' || (user_id % 3) AS path FROM p GROUP BY ALL),
    b AS (SELECT path, 0 AS root FROM a UNION ALL SELECT path, 1 FROM r WHERE path NOT IN (SELECT path FROM a))
    SELECT path, row_number() OVER (ORDER BY root, path)::BIGINT - 1 AS place FROM b""")
def q_interchange_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of the acquisition group, then those of the root that are not among them."""

    def named(parts: int) -> DataFrame:
        paths = trains(spark, sf_dir).select(F.lit("rec").alias("session_id"), F.concat("event_type", F.lit("_"), F.col("user_id") % parts).alias("path")).distinct()
        return paths.withColumn("place", F.row_number().over(Window.orderBy("path")).cast("long"))  # one row a series

    return all_paths(named(2), named(3)).drop("session_id")


# Long trains and exact order statistics ----------------------------------------------------------------------------------


@query(P + """,
    r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM p),
    m AS (SELECT event_type, value AS median FROM r WHERE i = n // 2),
    d AS (SELECT event_type, median, abs(value - median) AS d FROM p JOIN m USING (event_type)),
    e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM d)
    SELECT event_type, median, greatest(d, 1e-9::DOUBLE) * 1.4826e0 AS sigma FROM e WHERE i = n // 2""")
def q_robust_std_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all samples of each type, by radix selection."""
    return signals.robust_sigma(trains(spark, sf_dir), ["event_type"], "value", most=None)


@query(P + """,
    h AS (SELECT DISTINCT floor(t / 60e0)::BIGINT AS tick FROM p),
    m AS (SELECT *, row_number() OVER w - 1 AS i, CASE WHEN lag(tick) OVER w IS NULL OR tick <> lag(tick) OVER w + 1 THEN 1 ELSE 0 END AS new FROM h WINDOW w AS (ORDER BY tick)),
    r AS (SELECT *, sum(new) OVER (ORDER BY tick) - 1 AS fragment FROM m)
    SELECT fragment::BIGINT AS fragment, min(tick) AS first_tick, min(i)::BIGINT AS first_index, count(*) AS count FROM r GROUP BY fragment""")
def q_fragments_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table as one train of minutes, in parts of 1,000."""
    ticks = trains(spark, sf_dir).select(F.floor(F.col("t") / 60.0).alias("tick")).distinct()
    return signals.fragments(ticks, 1, [], part_rows=1000)


@query("WITH RECURSIVE" + P.removeprefix("WITH") + """,
    k AS (SELECT event_id, row_number() OVER w - 1 AS sample, abs(value) AS x, abs(lag(value) OVER w) AS b, abs(lead(value) OVER w) AS a FROM p WINDOW w AS (ORDER BY t, event_id)),
    peaks AS (SELECT sample FROM k WHERE x > 10e0 AND x >= b AND x >= a),
    nxt AS MATERIALIZED (SELECT sample, min(sample) OVER (ORDER BY sample RANGE BETWEEN 9 FOLLOWING AND UNBOUNDED FOLLOWING) AS follow FROM peaks),
    g(sample) AS (SELECT min(sample) FROM peaks UNION ALL SELECT follow FROM g JOIN nxt USING (sample) WHERE follow IS NOT NULL)
    SELECT sample::BIGINT AS sample FROM g""")
def q_refractory_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of the whole table as one signal, in parts of 2,000 samples and 500 peaks."""
    peaks = signals.local_peaks(trains(spark, sf_dir), 10.0, [], ["t", "event_id"], part_rows=2000)
    return signals.suppress_refractory(peaks, 9, [], part_rows=500)


@query(_bandpass_sql(1000.0, 10.0, 300.0).replace("user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id)", "event_type AS user_id, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id)").replace("SELECT user_id, sample, z", "SELECT user_id AS event_type, sample, z"))
def q_iir_bandpass_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type's values as one recording, filtered in parts of 1,000 samples."""
    signal = trains(spark, sf_dir).select("event_type", "t", "event_id", "value")
    return spike_sorting.bandpass(signal, 1000.0, 10.0, 300.0, ["event_type"], ["t", "event_id"], part_rows=1000, warm_up=300)


def _kmeans_sql(clusters: int, rounds: int) -> str:
    """Rounds one after the other: distances added up in order, means of coordinates in steps of 2**-24."""
    parts = [f"""WITH n AS (SELECT count(*) AS n, least({clusters}, count(*)) AS k FROM embeddings),
        x AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i, list_transform(embedding, lambda v: v::DOUBLE) AS f FROM embeddings),
        c0 AS MATERIALIZED (SELECT c, f AS v FROM x JOIN (SELECT c, least(c * (n // k), n - 1) AS i FROM n, range(n.k) r(c)) USING (i))"""]
    for r in range(rounds):
        parts.append(f"""d{r} AS (SELECT vec_id, f, c, list_reduce(list_prepend(0e0, list_transform(list_zip(f, v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), lambda a, b: a + b) AS d FROM x, c{r}),
            l{r} AS MATERIALIZED (SELECT vec_id, f, c AS label FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        parts.append(f"""m{r} AS (SELECT label, pos, sum(floor(e * 16777216e0 + 0.5e0)::HUGEINT)::DOUBLE / count(*) / 16777216e0 AS m FROM (SELECT label, unnest(f) AS e, generate_subscripts(f, 1) AS pos FROM l{r}) GROUP BY ALL),
            c{r + 1} AS MATERIALIZED (SELECT c, coalesce(v, list_transform(range(64), lambda i: 0e0)) AS v FROM (SELECT c FROM c0) LEFT JOIN (SELECT label, list(m ORDER BY pos) AS v FROM m{r} GROUP BY label) ON label = c)""")
    return ", ".join(parts) + f" SELECT vec_id AS idx, label::BIGINT AS label FROM l{rounds - 1}"


@query(_kmeans_sql(6, 5))
def q_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All waveforms in six clusters, by five rounds over all tasks."""
    rows = waveforms(spark, sf_dir).select("idx", "samples")
    return clustering.kmeans(rows, 6, [], ["idx"], "samples", rounds=5).select("idx", "label")
