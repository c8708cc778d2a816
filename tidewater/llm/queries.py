"""Queries of the training-data problems, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.ids import tenant, trace_id
from tidewater.llm import distinct, packing, quantiles, spam, tokens
from tidewater.session import materialize
from tidewater.sources.tables import table

POINTS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
PARTITION = {"project_id": "string", "service": "string", "date": "date"}
SERVICE = {"service": "string", "date": "date"}
LEVELLED = ["level", "project_id", "service", "date"]


def _durations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "otel_logs_and_spans").select(
        tenant(F.col("project_id")).alias("project_id"), F.col("resource___service___name").alias("service"), "date", F.col("duration").cast("double").alias("duration")
    )


def _levelled(df: DataFrame, level: str) -> DataFrame:
    missing = {k: F.lit(None).cast(t).alias(k) for k, t in PARTITION.items() if k not in df.columns}
    rest = [x for x in df.columns if x not in PARTITION]
    return df.select(F.lit(level).alias("level"), *[missing.get(k, F.col(k)) for k in PARTITION], *rest)


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per project, service and day (level partition), per service and day (day) and per service (period).

    Only the partitions' sketches are made from rows; days are added up from partitions, periods from days.
    """
    partitions = materialize(quantiles.sketches(_durations(spark, d), PARTITION, F.col("duration")))
    days = quantiles.merge(partitions, SERVICE)
    period = quantiles.merge(days, {"service": "string"})
    of = lambda df, keys, level: _levelled(quantiles.percentiles(df, keys, POINTS), level)
    return of(partitions, PARTITION, "partition").unionByName(of(days, SERVICE, "day")).unionByName(of(period, {"service": "string"}, "period"))


def p2_within(spark: SparkSession, d: str) -> DataFrame:
    """p2_percentiles per service and day held against all durations: the count, and whether each percentile keeps its bound.

    A percentile keeps it if its rank, give or take the values that share its code, is within RANK_ERROR of the wanted one.
    """
    got = p2_percentiles(spark, d).where("level = 'day'").select("service", "date", F.col("n").alias("sketched"), *POINTS)
    rows = _durations(spark, d).where("duration is not null").select(F.col("service").alias("s"), F.col("date").alias("day"), "duration")
    joined = rows.join(got, F.col("s").eqNullSafe(F.col("service")) & F.col("day").eqNullSafe(F.col("date")))
    width = 2.0**-quantiles.MANTISSA
    n = F.count("*")
    tests = []
    for name, q in POINTS.items():
        slack = F.abs(F.col(name)) * width
        below, up_to = F.count_if(F.col("duration") < F.col(name) - slack), F.count_if(F.col("duration") <= F.col(name) + slack)
        rank, error = F.greatest(F.lit(1), F.ceil(n * q)), n * quantiles.RANK_ERROR
        tests.append(((below + 1 - error <= rank) & (rank <= up_to + error)).alias(f"{name}_within"))
    return joined.groupBy(F.col("s").alias("service"), F.col("day").alias("date")).agg(F.first("sketched").alias("n"), *tests)


TRACED = {"project_id": "string", "date": "date", "hour": "int"}


def _traces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "otel_logs_and_spans").select(
        tenant(F.col("project_id")).alias("project_id"), "date", F.hour(F.col("timestamp").cast("timestamp")).alias("hour"), trace_id(F.col("context___trace_id")).alias("trace")
    )


def p5_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct traces per project and hour, project and day, project, day and in all, with 95 % intervals.

    Only the hours' registers are made from identifiers; days are merged from hours, everything else from days.
    """
    keys = {"project_id": "string", "date": "date"}
    hourly = materialize(distinct.merge(distinct.partials(_traces(spark, d), TRACED, F.col("trace")), TRACED))
    daily = materialize(distinct.coarser(hourly, keys))
    hours = distinct.counts(hourly, TRACED).select(F.lit("project_id+date+hour").alias("level"), *TRACED, "n_distinct", "low", "high")
    rest = distinct.counts(distinct.cube(daily, keys), {"level": "string", **keys}).withColumn("hour", F.lit(None).cast("int"))
    return hours.unionByName(rest)


def p5_within(spark: SparkSession, d: str) -> DataFrame:
    """p5_distinct held against exact counts: the exact count of every group, and whether the estimate is within five standard errors of it."""
    got = p5_distinct(spark, d)
    exact = _traces(spark, d).where("trace is not null").groupingSets(
        [[F.col("project_id"), F.col("date"), F.col("hour")], [F.col("project_id"), F.col("date")], [F.col("project_id")], [F.col("date")], []], "project_id", "date", "hour"
    ).agg(F.count_distinct("trace").alias("n"))
    on = [exact[k].eqNullSafe(got[k]) for k in TRACED]
    within = F.abs(F.col("n_distinct") / F.col("n") - 1) <= 5 * distinct.RELATIVE_ERROR
    return exact.join(got, on, "full").select("level", exact["project_id"], exact["date"], exact["hour"], "n", within.alias("within"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_column(table(spark, d, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokens.count_column(table(spark, d, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return spam.flag(documents, spam.train(documents, table(spark, d, "doc_labels")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).where("flagged").select("doc_id")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of list text of every document."""
    return _pages(spark, d)


QUERIES = {f.__name__: f for f in (p2_percentiles, p2_within, p5_distinct, p5_within, p8_ids, p9_containers, p10_found, p10_shares)}

_BARE_TRACE = "ltrim(regexp_replace(regexp_replace(lower(trim(context___trace_id)), '^\\{?0x', ''), '[\\s{}\\-]', '', 'g'), '0')"
SQL: dict[str, str] = {
    "p2_within": "SELECT resource___service___name AS service, date, count(*) AS n, true AS p50_within, true AS p90_within, true AS p95_within, true AS p99_within FROM otel_logs_and_spans WHERE duration IS NOT NULL GROUP BY ALL",
    "p5_within": f"""
WITH t AS (SELECT coalesce(project_id, 'default') AS project_id, date, CAST(hour(timestamp AT TIME ZONE 'UTC') AS INTEGER) AS hour, lpad(b, 32, '0') AS trace
  FROM (SELECT *, {_BARE_TRACE} AS b FROM otel_logs_and_spans) WHERE regexp_full_match(b, '[0-9a-f]{{1,32}}'))
SELECT CASE grouping(project_id, date, hour) WHEN 0 THEN 'project_id+date+hour' WHEN 1 THEN 'project_id+date' WHEN 3 THEN 'project_id' WHEN 5 THEN 'date' ELSE 'all' END AS level,
  project_id, date, hour, count(DISTINCT trace) AS n, true AS within
FROM t GROUP BY GROUPING SETS ((project_id, date, hour), (project_id, date), (project_id), (date), ())""",
}
