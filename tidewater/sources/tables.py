"""Readers of the engine's tables: one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def routed_table(
    spark: SparkSession, schema: T.StructType, shared: str, custom: dict[str, str] | None = None, staging: list[str] = ()
) -> DataFrame:
    """One table from several places: the shared folder, projects with storage of their own, and staged batches.

    Each leg states which projects it can hold, so a condition on project_id leaves the other legs unread. Rows
    may be in staging and storage at once; version resolution above makes them one.
    """
    own = sorted(custom or {})

    def leg(path: str) -> DataFrame:
        return spark.read.schema(schema).parquet(path).select(*[f"`{f.name}`" for f in schema.fields])

    out = leg(shared)
    if own:
        out = out.where(~F.coalesce(F.col("project_id").isin(*own), F.lit(False)))
    for project in own:
        out = out.unionByName(leg(custom[project]).where(F.col("project_id") == project))
    for path in staging:
        out = out.unionByName(leg(path))
    return out
