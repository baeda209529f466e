"""Column functions: ticks and seconds, quantising, fixed-order sums over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16


def ticks_to_seconds(tick: Column, frequency) -> Column:
    return tick.cast("double") / F.lit(frequency)


def round_half_away(x: Column) -> Column:
    """To whole numbers, halves away from zero, as a double; NaN stays."""
    return F.when(F.isnan(x), x).when(x >= 0, F.floor(x) + F.when(x - F.floor(x) >= 0.5, 1).otherwise(0)).otherwise(F.ceil(x) - F.when(F.ceil(x) - x >= 0.5, 1).otherwise(0)).cast("double")


def saturate(x: Column, low: int, high: int) -> Column:
    """Within bounds; NaN becomes 0. (A cast beyond a type's range would be an error.)"""
    return F.when(F.isnan(x), 0.0).otherwise(F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def seconds_to_ticks(t: Column, frequency) -> Column:
    return saturate(round_half_away(t * F.lit(frequency)), -(2**63), 2**63 - 1024).cast("long")


def quantise_i16(value: Column, scale, offset=0.0) -> Column:
    """The nearest 16-bit step; values beyond its range take its ends."""
    return saturate(round_half_away((value - F.lit(offset)) / F.lit(scale)), -32768, 32767).cast("int")


def dequantise_i16(raw: Column, scale, offset=0.0) -> Column:
    return raw * F.lit(scale) + F.lit(offset)


def bin_index(x: Column, start, width) -> Column:
    return F.floor((x - F.lit(start)) / F.lit(width))


def ordered_sum(values: Column) -> Column:
    """Sum of an array of doubles from its first element to its last."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return ordered_sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(ordered_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def normalized_correlation(a: Column, b: Column) -> Column:
    """Of two arrays of one length, without centring; 0 if either has no energy."""
    ea, eb = dot(a, a), dot(b, b)
    return F.when((ea <= 1e-12) | (eb <= 1e-12), 0.0).otherwise(dot(a, b) / (F.sqrt(ea) * F.sqrt(eb)))


def sanitize_name(name: Column) -> Column:
    """For paths in hierarchical files."""
    clean = F.replace(F.trim(name), F.lit("/"), F.lit("_"))
    return F.when(clean == "", "unnamed").otherwise(clean)


def marker_number(text: Column) -> Column:
    """The cell as an unsigned 32-bit number, else null."""
    digits = F.regexp_like(text, F.lit(r"^\+?[0-9]{1,18}$"))
    n = F.when(digits, F.expr("1") * F.regexp_replace(text, r"^\+", "").cast("long"))
    return F.when(n <= 2**32 - 1, n)


def marker_fields(cells: DataFrame) -> DataFrame:
    """(var_name, field_name, numeric, cell_bytes) of text cells (var_name, field_name, cell): whether all are numbers, and the bytes a cell takes."""
    size = F.greatest(F.lit(6), F.max(F.octet_length("cell")) + 1).cast("long")
    return cells.groupBy("var_name", "field_name").agg(F.bool_and(marker_number(F.col("cell")).isNotNull()).alias("numeric"), size.alias("cell_bytes"))
