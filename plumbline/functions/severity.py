"""Severity functions of measurements, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero() -> Column:
    return F.lit(0.0)


def binary(v: Column) -> Column:
    return F.when(v > 0, 1.0).otherwise(0.0)


def count(v: Column) -> Column:
    return v.cast("double")


def log_count(v: Column) -> Column:
    return F.log2(1 + v)


def linear_over_threshold(v: Column, reference: float) -> Column:
    return F.when(v >= reference, v / reference).otherwise(_zero())


def log_ratio(v: Column, reference: float) -> Column:
    return F.when(v >= reference, 1 + F.log2(v / reference)).otherwise(_zero())


def continuous_log(v: Column, baseline: float, reference: float) -> Column:
    if reference <= baseline:
        raise ValueError("the reference must be above the baseline")
    return F.log2(1 + F.greatest(_zero(), v - baseline) / (reference - baseline))


def god_class(wmc: Column, atfd: Column, tcc_percent: Column) -> Column:
    """0 unless a class is large, uses much foreign data and holds together little."""
    third = 100.0 / 3
    score = 30 + 8 * (1 + F.log2(atfd / 5)) + 8 * (1 + F.log2(third / F.least(F.greatest(tcc_percent, F.lit(1.0)), F.lit(third))))
    return F.when((wmc >= 47) & (atfd > 5) & (tcc_percent < third), score).otherwise(_zero())


def checked(v: Column, what: str) -> Column:
    """``v``, or an error if it is not a finite number of at least zero."""
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v < 0)
    return F.when(bad, F.raise_error(F.lit(f"{what} must be finite and not negative")).cast("double")).otherwise(v)


def exact(v: Column) -> Column:
    """Half away from zero at the twelfth place; values beyond 4503 have no such place."""
    scaled = F.signum(v) * F.floor(F.abs(v) * 1e12 + 0.5) / 1e12
    return F.when(F.abs(v) >= 4503, v).otherwise(scaled + 0.0)


def one_decimal(v: Column) -> Column:
    """One digit behind the point."""
    return F.format_string("%.1f", v.cast("double"))


def display_number(v: Column) -> Column:
    """An integer where the value is one, else six significant digits."""
    return F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(F.regexp_replace(F.format_string("%.6g", v), r"(\.\d*?)0+$|\.$", "$1"))


def by_formula(formula: Column, v: Column, baseline: Column, reference: Column) -> Column:
    """Severity of ``v`` by the formula that a column names; an unknown one, or one whose reference doesn't
    allow it, is an error."""
    fails = lambda what: F.raise_error(F.concat(F.lit(what + ": "), formula)).cast("double")
    above = F.when(reference.isNull() | (reference <= 0), fails("the reference must be positive"))
    return (
        F.when(formula == "binary", binary(v))
        .when(formula == "count", count(v))
        .when(formula == "log-count", log_count(v))
        .when(formula == "linear-over-threshold", above.otherwise(F.when(v >= reference, v / reference).otherwise(_zero())))
        .when(formula == "log-ratio", above.otherwise(F.when(v >= reference, 1 + F.log2(v / reference)).otherwise(_zero())))
        .when(formula == "continuous-log", F.when(reference.isNull() | (reference <= baseline), fails("the reference must be above the baseline")).otherwise(F.log2(1 + F.greatest(_zero(), v - baseline) / (reference - baseline))))
        .otherwise(fails("unknown formula"))
    )


FORMULAS = {"binary": binary, "count": count, "log-count": log_count, "linear-over-threshold": linear_over_threshold, "log-ratio": log_ratio, "continuous-log": continuous_log}
