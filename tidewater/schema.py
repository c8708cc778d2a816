"""Declared table schemas and rollup specifications.

Schemas are fixed: no inference, new columns are appended last, nested keys are flattened with ___.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Type names of declarations and Spark's types. Unsigned 32-bit values need a long.
TYPES = {
    "Utf8": T.StringType(), "Date32": T.DateType(), "Boolean": T.BooleanType(), "Int32": T.IntegerType(), "UInt32": T.LongType(),
    "Int64": T.LongType(), "UInt64": T.LongType(), "Float64": T.DoubleType(), "Binary": T.BinaryType(), "Variant": T.VariantType(),
    "List(Utf8)": T.ArrayType(T.StringType()), "List(Int64)": T.ArrayType(T.LongType()), "List(Float64)": T.ArrayType(T.DoubleType()),
    "Timestamp(Microsecond, None)": T.TimestampNTZType(), "Timestamp(Microsecond, Some(\"UTC\"))": T.TimestampType(),
}
#: Seconds of the grains a rollup may have.
GRAINS = {"1m": 60, "5m": 300, "10m": 600, "15m": 900, "30m": 1800, "1h": 3600, "6h": 21600, "12h": 43200, "1d": 86400}
AGGREGATES = ("count", "sum", "min", "max", "tdigest", "hll")
#: Columns every rollup table has of its own.
IDENTITY = ("project_id", "timestamp", "date", "id", "updated_at", "deleted", "rollup_generation")
#: Columns of point lookups, written with Bloom filters.
NEEDLES = ("id", "parent_id", "context___trace_id", "context___span_id", "attributes___session___id", "attributes___user___id", "series_id", "metric_name")
DEFAULT_TABLE = "otel_logs_and_spans"


class SchemaError(ValueError):
    """The declaration contradicts itself."""


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    nullable: bool = True
    mutable: bool = False
    bloom: bool = False

    def spark(self) -> T.StructField:
        if self.kind not in TYPES:
            raise SchemaError(f"{self.name}: unknown type {self.kind}")
        return T.StructField(self.name, TYPES[self.kind], self.nullable)


@dataclass(frozen=True)
class Measure:
    name: str
    agg: str
    column: str | None = None
    filter: str | None = None


@dataclass(frozen=True)
class RollupSpec:
    grain: str
    dimensions: tuple[str, ...]
    measures: tuple[Measure, ...]
    name: str = ""
    derive_from: str | None = None

    @property
    def seconds(self) -> int:
        return GRAINS[self.grain]

    def validate(self, columns: set[str], others: dict[str, RollupSpec] | None = None) -> RollupSpec:
        if self.grain not in GRAINS:
            raise SchemaError(f"grain {self.grain!r}")
        names = [*self.dimensions, *(m.name for m in self.measures)]
        for n in [*names, *([self.name] if self.name else [])]:
            if not re.fullmatch(r"[A-Za-z_]\w*", n):
                raise SchemaError(f"{n!r} is no identifier")
        if len(set(names)) != len(names):
            raise SchemaError("dimensions and measures must be unique")
        for d in self.dimensions:
            if d not in columns or d in IDENTITY:
                raise SchemaError(f"dimension {d!r}")
        if not self.measures:
            raise SchemaError("a rollup needs a measure")
        for m in self.measures:
            if m.agg not in AGGREGATES or (m.column is None and m.agg != "count") or (m.column is not None and m.column not in columns):
                raise SchemaError(f"measure {m.name!r}")
        if self.derive_from is not None and others is not None:
            finer = others.get(self.derive_from)
            if finer is None or finer.derive_from is not None:
                raise SchemaError("derive_from is one level only")
            if GRAINS[finer.grain] >= self.seconds or self.seconds % GRAINS[finer.grain]:
                raise SchemaError("derive_from needs a finer grain that divides this one")
            kept = {(m.name, m.agg) for m in finer.measures}
            if not set(self.dimensions) <= set(finer.dimensions) or any((m.name, m.agg) not in kept for m in self.measures):
                raise SchemaError("derive_from lacks a dimension or measure")
        return self


@dataclass(frozen=True)
class TableSchema:
    name: str
    fields: tuple[Field, ...]
    time_column: str = "timestamp"
    partitions: tuple[str, ...] = ("project_id", "date")
    dedup_keys: tuple[str, ...] = ()
    version: str | None = None
    tombstone: str | None = None
    version_append: bool = False
    sort: tuple[str, ...] = ()
    rollups: tuple[RollupSpec, ...] = field(default=())

    def spark(self) -> T.StructType:
        return T.StructType([f.spark() for f in self.fields])

    def columns(self) -> set[str]:
        return {f.name for f in self.fields}

    def mutable(self) -> set[str]:
        return {f.name for f in self.fields if f.mutable}

    def validate(self) -> TableSchema:
        by = {f.name: f for f in self.fields}
        if len(by) != len(self.fields):
            raise SchemaError("columns must be unique")
        for k in (*self.dedup_keys, *self.partitions, self.time_column):
            if k not in by or by[k].kind == "Variant":
                raise SchemaError(f"key {k!r}")
        if self.tombstone and (self.tombstone not in by or by[self.tombstone].kind != "Boolean" or not by[self.tombstone].nullable):
            raise SchemaError("the tombstone is a nullable Boolean")
        if self.version_append and not (self.dedup_keys and self.version and self.tombstone):
            raise SchemaError("version_append needs keys, a version and a tombstone")
        others = {r.name: r for r in self.rollups}
        for r in self.rollups:
            r.validate(self.columns(), others)
        return self


def _fields(kind: str, names: str, **flags) -> list[Field]:
    return [Field(n, kind, **flags) for n in names.split()]


_TS = 'Timestamp(Microsecond, Some("UTC"))'
_ERRORS = "status_code = 'ERROR' OR COALESCE(attributes___http___response___status_code, 0) >= 500"
_SERVER = "kind = 'server'"


def _span_measures() -> tuple[Measure, ...]:
    plain = [Measure("request_count", "count"), Measure("error_count", "count", None, _ERRORS)]
    for prefix, condition in (("", None), ("server_", _SERVER)):
        plain += [Measure(f"{prefix}duration_{a}", a, "duration", condition) for a in ("count", "sum", "min", "max")]
        plain.append(Measure(f"{prefix}duration_digest", "tdigest", "duration", condition))
    plain += [Measure("server_request_count", "count", None, _SERVER), Measure("server_error_count", "count", None, f"({_SERVER}) AND ({_ERRORS})")]
    return tuple(plain)


def _metric_measures() -> tuple[Measure, ...]:
    return (Measure("point_count", "count"), *(Measure(f"value_{a}", a, "value") for a in ("count", "sum", "min", "max")), Measure("value_digest", "tdigest", "value"))


def _tiers(prefix: str, dimensions: tuple[str, ...], measures: tuple[Measure, ...]) -> tuple[RollupSpec, ...]:
    fine = RollupSpec("1m", dimensions, measures, f"{prefix}_1m")
    return fine, RollupSpec("1h", dimensions, measures, f"{prefix}_1h", fine.name)


def change_feed_schema() -> TableSchema:
    f = [Field("date", "Date32", False), Field("timestamp", _TS, False), Field("id", "Utf8", False), Field("name", "Utf8", mutable=True), Field("project_id", "Utf8"), Field("updated_at", _TS), Field("deleted", "Boolean")]
    return TableSchema("mor_versioned", tuple(f), dedup_keys=("timestamp", "id"), version="updated_at", tombstone="deleted", version_append=True).validate()


def spans_rollups() -> tuple[RollupSpec, ...]:
    return _tiers("dashboard", ("resource___service___name", "kind", "status_code"), _span_measures())


def metrics_rollups() -> tuple[RollupSpec, ...]:
    return _tiers("metrics", ("metric_name", "resource___service___name"), _metric_measures())


def declared(name: str, schema: T.StructType, mutable: tuple[str, ...] = (), rollups: tuple[RollupSpec, ...] = (), **more) -> TableSchema:
    """A declaration taken over from a table's files, for the wide tables whose columns those files list."""
    kinds = {v: k for k, v in TYPES.items() if k not in ("UInt32", "UInt64")}
    fields = tuple(Field(f.name, kinds[f.dataType], f.nullable, f.name in mutable, f.name in NEEDLES) for f in schema.fields)
    return TableSchema(name, fields, rollups=rollups, **more).validate()


def spans_schema(schema: T.StructType) -> TableSchema:
    return declared(
        "otel_logs_and_spans", schema, ("hashes",), spans_rollups(), dedup_keys=("timestamp", "id"), version="updated_at", tombstone="deleted", version_append=True,
        sort=("timestamp", "resource___service___name", "id", "level", "status_code"),
    )


def metrics_schema(schema: T.StructType) -> TableSchema:
    return declared("otel_metrics", schema, (), metrics_rollups(), dedup_keys=("timestamp", "id"), version="updated_at", tombstone="deleted", version_append=True)
