"""Catalogue views that clients ask for: tables and columns, empty runtime views, and the engine's counters."""

from __future__ import annotations

from tidewater.engine import Engine

#: Runtime views that exist but have no rows, and their columns.
EMPTY = {
    "pg_catalog_pg_stat_activity": "pid int, usename string, state string, query string", "pg_catalog_pg_locks": "locktype string, pid int, mode string",
    "pg_catalog_pg_index": "indexrelid long, indrelid long, indisunique boolean", "pg_catalog_pg_constraint": "oid long, conname string, contype string",
    "pg_catalog_pg_description": "objoid long, description string", "pg_catalog_pg_trigger": "oid long, tgname string", "pg_catalog_pg_matviews": "schemaname string, matviewname string",
}
#: Type names by Spark type, as clients know them, and their object ids.
PG_TYPES = {
    "string": ("text", 25), "bigint": ("bigint", 20), "int": ("integer", 23), "double": ("double precision", 701), "boolean": ("boolean", 16), "date": ("date", 1082),
    "timestamp": ("timestamp with time zone", 1184), "timestamp_ntz": ("timestamp without time zone", 1114), "binary": ("bytea", 17), "variant": ("jsonb", 3802),
    "array<string>": ("text[]", 1009), "array<bigint>": ("bigint[]", 1016), "array<double>": ("double precision[]", 1022),
}


def install(engine: Engine) -> None:
    """Create or refresh the views. They are as large as the catalogue, so the driver makes them."""
    spark = engine.spark
    names = sorted(t.name for t in spark.catalog.listTables() if not t.name.startswith(("pg_catalog_", "information_schema_", "engine_")) and not t.name.endswith("__all"))
    columns = []
    for n in names:
        for i, f in enumerate(spark.table(n).schema.fields):
            pg, oid = PG_TYPES.get(f.dataType.simpleString(), ("text", 25))
            columns.append(("public", n, f.name, i + 1, "YES" if f.nullable else "NO", pg, oid))
    spark.createDataFrame([("public", n, "BASE TABLE") for n in names] or [], "table_schema string, table_name string, table_type string").createOrReplaceTempView("information_schema_tables")
    spark.createDataFrame(columns or [], "table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, data_type string, type_oid int").createOrReplaceTempView("information_schema_columns")
    spark.createDataFrame([("public", n) for n in names] or [], "schemaname string, tablename string").createOrReplaceTempView("pg_catalog_pg_tables")
    spark.createDataFrame([(k, n, 2200, "r") for k, n in enumerate(names, 16_384)] or [], "oid long, relname string, relnamespace long, relkind string").createOrReplaceTempView("pg_catalog_pg_class")
    spark.createDataFrame([(2200, "public"), (11, "pg_catalog"), (13_000, "information_schema")], "oid long, nspname string").createOrReplaceTempView("pg_catalog_pg_namespace")
    spark.createDataFrame(sorted({(oid, pg) for pg, oid in PG_TYPES.values()}), "oid long, typname string").createOrReplaceTempView("pg_catalog_pg_type")
    spark.createDataFrame([(1, spark.catalog.currentDatabase())], "oid long, datname string").createOrReplaceTempView("pg_catalog_pg_database")
    for n, schema in EMPTY.items():
        spark.createDataFrame([], schema).createOrReplaceTempView(n)
    stats = [("engine", k, float(v)) for k, v in sorted(engine.stats.items())] + [("catalog", "tables", float(len(names)))]
    spark.createDataFrame(stats, "component string, key string, value double").createOrReplaceTempView("engine_stats")


#: Settings that clients probe, and what they are told.
SETTINGS = {
    "server_version": "16.0", "timezone": "UTC", "statement_timeout": "60s", "standard_conforming_strings": "on", "client_encoding": "UTF8",
    "transaction_isolation": "read committed", "search_path": "public", "datestyle": "ISO, MDY", "integer_datetimes": "on",
}


def show(engine: Engine, name: str) -> str:
    """The value of SHOW name."""
    key = name.strip().lower()
    if key not in SETTINGS:
        raise KeyError(f"unrecognised setting {name}")
    return engine.spark.conf.get("spark.sql.session.timeZone") if key == "timezone" else SETTINGS[key]
