"""Percentile digests and distinct-count sketches of the SQL surface.

A digest is a KLL sketch: built and merged in the JVM, with map-side combine, in a few KB whatever the number of values.
Ranks read from it are off by at most RANK_ERROR of the count (99 % of the time); up to KLL_K values it holds them all.
Quantiles interpolate between its values, so that on few values they equal PERCENTILE_CONT. Distinct counts are
HyperLogLog sketches of 2^HLL_LG_K registers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KLL_K = 1_000
#: Fixed value: normalised rank error of a sketch of KLL_K, 2.296 / KLL_K^0.9723.
RANK_ERROR = 0.0028
HLL_LG_K = 12
#: Relative standard error of a distinct count: 1.04 / sqrt(2^HLL_LG_K).
HLL_ERROR = 0.0163


def finite_sql(value: str) -> str:
    """SQL of a value as a double; null for NaN and the infinities."""
    x = f"CAST({value} AS DOUBLE)"
    return f"CASE WHEN NOT isnan({x}) AND abs({x}) <> double('inf') THEN {x} END"


def digest_sql(value: str) -> str:
    return f"kll_sketch_agg_double({finite_sql(value)}, {KLL_K})"


def hashed_sql(value: str) -> str:
    """SQL that gives equal values of any type equal 64-bit numbers; null stays null."""
    return f"CASE WHEN {value} IS NOT NULL THEN xxhash64({value}) END"


def digest_of(value: Column) -> Column:
    """Aggregate: the digest of the finite values."""
    v = value.cast("double")
    return F.kll_sketch_agg_double(F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v), KLL_K)


def merge_digests(digest: Column) -> Column:
    """Aggregate: one digest of the digests of a group."""
    return F.kll_merge_agg_double(digest)


def parse_digest(state: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Values of a serialised KLL sketch of doubles, rising, and how many each stands for; both empty without any.

    Fixed values: the public DataSketches layout, flags in byte 3 (1 empty, 4 single item), the number of levels in byte 18,
    then the levels' starts from byte 20, the least and the greatest value, and the retained values level by level.
    """
    if state is None or state[3] & 1:
        return np.empty(0), np.empty(0)
    if state[3] & 4:
        return np.frombuffer(state, "<f8", 1, 8), np.ones(1)
    levels = state[18]
    start = np.frombuffer(state, "<i4", levels, 20).astype(np.int64)
    at = 20 + 4 * levels
    least, greatest = np.frombuffer(state, "<f8", 2, at)
    kept = np.frombuffer(state, "<f8", -1, at + 16)
    weight = np.repeat(2.0 ** np.arange(levels), np.diff(np.append(start, start[0] + len(kept))))
    order = np.argsort(kept, kind="stable")
    kept, weight = kept[order].copy(), weight[order]
    kept[0], kept[-1] = least, greatest  # both are known exactly
    return kept, weight


def quantile(x: np.ndarray, y: np.ndarray, p: float) -> float | None:
    """The value of rank p * (n - 1), interpolated between those next to it; a value spans as many ranks as it stands for."""
    if len(x) == 0:
        return None
    last = np.cumsum(y) - 1
    return float(np.interp(p * last[-1], np.stack((last - y + 1, last), 1).ravel(), np.repeat(x, 2)))


@F.pandas_udf(T.DoubleType())
def tdigest_quantile(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The quantile p of a digest; null for a null p or digest; p outside [0, 1] is an error."""
    for p, digest in batches:
        if ((p < 0) | (p > 1)).any():
            raise ValueError("percentile must be between 0 and 1")
        yield pd.Series([None if pd.isna(a) else quantile(*parse_digest(b), a) for a, b in zip(p, digest)], dtype="float64")


def distinct_sketch(value: Column) -> Column:
    """Aggregate: the sketch of the values, of any type that can be hashed."""
    return F.hll_sketch_agg(F.when(value.isNotNull(), F.xxhash64(value)), F.lit(HLL_LG_K))


def merge_distinct(sketch: Column) -> Column:
    return F.hll_union_agg(sketch)


def distinct_count(sketch: Column) -> Column:
    return F.hll_sketch_estimate(sketch)


def register(spark: SparkSession) -> None:
    spark.udf.register("tdigest_quantile", tdigest_quantile)
