"""Numeric helpers as column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(v: Column, digits: int = 0) -> Column:
    return F.bround(v, digits)


def expected_time(o: Column, m: Column, p: Column) -> Column:
    """Three-point mean; null when any estimate is."""
    return (o + 4 * m + p) / 6


def variance(o: Column, p: Column) -> Column:
    return F.pow((p - o) / 6, F.lit(2))


def normal_cdf(z: Column) -> Column:
    """Phi(z) by erfc, which Spark has no function for; one Arrow batch at a time. Null for null."""

    @F.pandas_udf("double")
    def phi(v: pd.Series) -> pd.Series:
        return (v / -math.sqrt(2)).map(math.erfc, na_action="ignore") / 2

    return phi(z)


def completion_probability(target: Column, mean: Column, deviation: Column) -> Column:
    """P(duration <= target); a step for deviation 0, null for a negative or missing one."""
    z = (target - mean) / F.nullif(deviation, F.lit(0.0))
    return F.when(deviation > 0, normal_cdf(z)).when(deviation == 0, F.when(target >= mean, 1.0).otherwise(0.0))


def plain_number(v: Column) -> Column:
    """Six decimals without trailing zeros or point."""
    return F.regexp_replace(F.format_string("%.6f", v), r"\.?0+$", "")


def prf(tp: Column, detected: Column, expected: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 to four places; null on a zero denominator."""
    p, r = tp / F.nullif(detected, F.lit(0)), tp / F.nullif(expected, F.lit(0))
    f1 = 2 * p * r / F.nullif(p + r, F.lit(0.0))
    return half_even(p, 4), half_even(r, 4), half_even(F.when((p == 0) & (r == 0), F.lit(0.0)).otherwise(f1), 4)
