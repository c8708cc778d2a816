"""Sketch results held against all rows they were made from, without gathering a group anywhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranks_within(got: DataFrame, rows: DataFrame, keys: list[str], value: str, points: dict[str, float], error: float) -> DataFrame:
    """(keys..., n, <point>_within...): whether the rank of each percentile of `got` is off by at most `error` of the group's count.

    A value between two neighbours has the ranks of both. One pass over `rows` joined with the few rows of `got`.
    """
    named = got.select(*[F.col(k).alias(f"k_{k}") for k in keys], *points)
    on = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(F.col(f"k_{k}")) for k in keys])
    held = rows.where(F.col(value).isNotNull()).join(named, on)
    n, tests = F.count("*"), []
    for name, q in points.items():
        slack = 1e-9 * F.abs(F.col(name)) + 1e-9
        below, up_to = F.count_if(F.col(value) < F.col(name) - slack), F.count_if(F.col(value) <= F.col(name) + slack)
        rank, off = 1 + q * (n - 1), 1 + error * n
        tests.append(((below - off <= rank) & (rank <= up_to + 1 + off)).alias(f"{name}_within"))
    return held.groupBy(*[rows[k] for k in keys]).agg(n.alias("n"), *tests)
