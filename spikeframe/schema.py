"""Tables of a recording session: long and narrow, keyed by (session_id, var_name)."""

from __future__ import annotations

#: Fixed: kinds of variables and their numbers in session files.
KINDS = {"neuron": 0, "event": 1, "interval": 2, "waveform": 3, "population": 4, "continuous": 5, "marker": 6}
KIND_NAMES = {number: name for name, number in KINDS.items()}

SESSIONS = "session_id string, path string, format string, file_version int, comment string, timestamp_frequency_hz double, beg_seconds double, end_seconds double, metadata string"
VARIABLES = (
    "session_id string, var_index int, var_name string, kind string, version int, data_offset long, count long, ts_data_type int, cont_data_type int, "
    "sampling_rate double, units string, ad_to_mv double, mv_offset double, n_points_wave long, pre_thr_time double, marker_data_type int, n_markers int, "
    "marker_length int, gain int, filter int, wire int, unit int, x_pos double, y_pos double, metadata string"
)
POINTS = "session_id string, var_name string, kind string, idx long, tick long, t double"
INTERVALS = "session_id string, var_name string, idx long, t_start double, t_end double"
MARKERS = "session_id string, var_name string, idx long, t double, field_index int, field_name string, num long, str string"
WAVEFORMS = "session_id string, var_name string, idx long, t double, samples array<float>"
CONTINUOUS = "session_id string, var_name string, fragment int, t0 double, first_sample long, sampling_rate double, values array<double>"
POPULATION = "session_id string, var_name string, idx long, weight double"

TABLES = {
    "sessions": SESSIONS, "variables": VARIABLES, "points": POINTS, "intervals": INTERVALS, "markers": MARKERS,
    "waveforms": WAVEFORMS, "continuous": CONTINUOUS, "population": POPULATION,
}
