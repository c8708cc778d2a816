"""Queries of the general data-processing problems, over whole tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.ids import span_id, tenant, trace_id
from tidewater.operators import changefeed, hierarchy, late_events, redelivery, small_files
from tidewater.session import materialize, utc_micros, work_dir
from tidewater.sources.store import PartitionStore
from tidewater.sources.tables import table

KEYS = ["project_id", "timestamp", "id"]


def _feed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mor_versioned").withColumn("project_id", tenant(F.col("project_id")))


def _records(current: DataFrame) -> DataFrame:
    return current.select(
        "project_id", "id", utc_micros(F.col("timestamp")).alias("ts_us"),
        F.coalesce(utc_micros(F.col("updated_at")), F.lit(-1)).cast("long").alias("version_us"),
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The changes of the later half of the feed's time, merged into the state that the earlier half left."""
    feed = _feed(spark, d)
    stamp = utc_micros(F.col("updated_at"))
    lo, hi = feed.agg(F.min(stamp), F.max(stamp)).first()
    early = F.coalesce(stamp, F.lit(0)) < F.lit((lo or 0) + ((hi or 0) - (lo or 0)) // 2)
    base = changefeed.merge_changes(None, feed.where(early), KEYS, "updated_at", "deleted")
    return _records(changefeed.current_rows(changefeed.merge_changes(base, feed.where(~early), KEYS, "updated_at", "deleted"), "deleted"))


def p1_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The feed in two cuts by arrival-independent hash: the order in which they are merged does not matter."""
    feed = _feed(spark, d)
    cut = F.pmod(F.xxhash64("updated_at", "name"), F.lit(2))
    base = changefeed.latest_changes(feed.where(cut == 0), KEYS, "updated_at", "deleted")
    state = changefeed.merge_changes(base, feed.where(cut == 1), KEYS, "updated_at", "deleted")
    return _records(changefeed.current_rows(state, "deleted"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "otel_logs_and_spans").select(
        trace_id(F.col("context___trace_id")).alias("tree"),
        span_id(F.col("context___span_id")).alias("node"),
        span_id(F.col("parent_id")).alias("parent"),
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    spans = hierarchy.hierarchies(_links(spark, d))
    return spans.where("depth >= 8 or cycle is not null").select(
        F.col("tree").alias("trace_id"), F.col("node").alias("span_id"), F.col("root").alias("root_span_id"), "depth"
    )


def p3_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Every span with its full path."""
    return hierarchy.hierarchies(_links(spark, d), with_path=True).select(
        "tree", "node", "root", "depth", F.concat_ws("/", "path").alias("path"), F.coalesce("cycle", F.lit("")).alias("cycle")
    )


def p3_joined(spark: SparkSession, d: str) -> DataFrame:
    """Root, depth and circle of every span by the joins that trees too large for a task take, for all trees."""
    return hierarchy.hierarchies(_links(spark, d), tree_limit=0).select("tree", "node", "root", "depth", F.coalesce("cycle", F.lit("")).alias("cycle"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """The number of descendants of each span and how far down they reach."""
    pairs = hierarchy.descendants(hierarchy.hierarchies(_links(spark, d), with_path=True))
    return pairs.groupBy("tree", "ancestor").agg(F.count("*").alias("descendants"), F.max("distance").alias("height"))


def p3_descendants_whole(spark: SparkSession, d: str) -> DataFrame:
    """p3_descendants for every span: 0 where there are none, and those on and below circles."""
    return hierarchy.descendant_counts(_links(spark, d)).withColumnRenamed("node", "ancestor")


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    """One row per message: it arrived with its first copy that has an arrival time."""
    rows = table(spark, d, "otel_logs_and_spans").select("id", "timestamp", "observed_timestamp", "project_id", "duration")
    keyed = redelivery.messages(rows)
    return keyed.groupBy("msg_id", "ts_ms").agg(
        F.min(tenant(F.col("project_id"))).alias("source"), F.min(utc_micros(F.col("timestamp"))).alias("event_us"),
        F.min(utc_micros(F.col("observed_timestamp"))).alias("arrival_us"), F.max("duration").alias("duration"),
    )


def _fates(spark: SparkSession, d: str) -> DataFrame:
    rule = late_events.Lateness()
    events = _arrivals(spark, d)
    raw = table(spark, d, "otel_logs_and_spans").select(
        tenant(F.col("project_id")).alias("source"), rule.start(utc_micros(F.col("timestamp"))).alias("event_us")
    )
    seen = materialize(raw.distinct())  # the periods of each source, as many as sources times hours
    marks = late_events.scheduled_punctuations(seen, rule)
    return late_events.classify(events, late_events.closing_times(seen, marks, rule), rule)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    hour = F.date_format(F.timestamp_micros(F.col("period_us")), "yyyy-MM-dd HH")
    return _fates(spark, d).where("fate = 'correction'").select(F.col("msg_id").alias("id"), hour.alias("period"))


def p4_hourly(spark: SparkSession, d: str) -> DataFrame:
    hour = F.date_format(F.timestamp_micros(F.col("period_us")), "yyyy-MM-dd HH")
    return late_events.corrected_aggregates(_fates(spark, d), "duration").select(
        hour.alias("period"), "published_n", "published_sum", "corrections", "final_n", "final_sum", "diverted_n"
    )


def p4_hourly_whole(spark: SparkSession, d: str) -> DataFrame:
    """p4_hourly with the messages that have no arrival time, so that final, diverted and unknown are all messages."""
    hour = F.date_format(F.timestamp_micros(F.col("period_us")), "yyyy-MM-dd HH")
    return late_events.corrected_aggregates(_fates(spark, d), "duration", whole=True).select(
        hour.alias("period"), "published_n", "published_sum", "corrections", "final_n", "final_sum",
        "diverted_n", "diverted_sum", "unknown_n", "unknown_sum",
    )


def p4_watermarked(spark: SparkSession, d: str) -> DataFrame:
    """Every message that came after its hour had closed, corrections and diverted ones, where hours close by what projects sent.

    A project's watermark trails its greatest event time by 15 minutes; an hour closes when every project with messages in it has passed its
    end, one that fell silent 6 hours after its last arrival. Hours that a project holds open take messages on time until the cut-off.
    """
    rule = late_events.Lateness(idle=timedelta(hours=6))
    events = materialize(_arrivals(spark, d))
    closed = late_events.closing_times(events, late_events.observed_punctuations(events, rule), rule)
    fates = late_events.classify(events, closed, rule).where("fate in ('correction', 'diverted')")
    return fates.join(closed.withColumnRenamed("bound", "period_end"), F.col("period_end") == rule.end(F.col("event_us")), "left").select(F.col("msg_id").alias("id"), "ts_ms", "fate", "closed_at")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The flushes of the first half of the time are history, the rest arrives as a batch."""
    rows = table(spark, d, "otel_logs_and_spans").select("id", "timestamp", "project_id", "updated_at")
    lo, hi = rows.agg(F.min(utc_micros(F.col("updated_at"))), F.max(utc_micros(F.col("updated_at")))).first()
    half = F.lit((lo or 0) + ((hi or 0) - (lo or 0)) // 2)
    early = F.coalesce(utc_micros(F.col("updated_at")), F.lit(0)) < half
    store = redelivery.ingest(spark, work_dir(spark, "messages"), rows, "updated_at", [early, ~early])
    return store.read().where("deliveries > 1").select(F.col("msg_id").alias("id"), "ts_ms")


def p6_messages(spark: SparkSession, d: str) -> DataFrame:
    """Exactly one copy of each message, with all its columns."""
    return redelivery.deliver_once(table(spark, d, "otel_logs_and_spans"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return small_files.small_live_files(table(spark, d, "file_actions")).select("path")


def p7_plan(spark: SparkSession, d: str) -> DataFrame:
    return small_files.compaction_plan(table(spark, d, "file_actions"))


def p7_compacted(spark: SparkSession, d: str) -> DataFrame:
    """The spans in as many small files as the log has, rewritten by compact(): files and rows per partition before and after.

    Rows before are counted in the source, rows after in the rewritten table, files in the listings of both versions.
    """
    spans = table(spark, d, "otel_logs_and_spans").withColumn("project_id", tenant(F.col("project_id")))
    keys = ["project_id", "date"]
    store = PartitionStore(spark, work_dir(spark, "small-files"), T.StructType([f for f in spans.schema.fields if f.name not in keys] + [f for f in spans.schema.fields if f.name in keys]), keys)
    small_files.lay_out(spans, small_files.small_live_files(table(spark, d, "file_actions")), store, ["id", "timestamp"])
    files = lambda name: small_files.stored_files(store, store.state()).groupBy("folder").agg(F.count("*").alias(name))
    before = materialize(files("files_before"))
    small_files.compact(store, small_bytes=small_files.TARGET_BYTES // 4)
    counted = spans.groupBy(*keys).agg(F.count("*").alias("rows_before"))
    rows = store.read().groupBy(*keys).agg(F.count("*").alias("rows_after"))
    listed = before.join(files("files_after"), "folder", "full")
    part = lambda k: F.try_url_decode(F.regexp_extract("folder", f"{k}=([^/]*)", 1))
    named = listed.select(part("project_id").alias("project_id"), part("date").cast("date").alias("date"), "files_before", "files_after")
    return counted.join(rows, keys, "full").join(named, keys, "full").select(*keys, "files_before", "files_after", "rows_before", "rows_after")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_incremental, p3_found, p3_hierarchy, p3_joined, p3_descendants, p3_descendants_whole, p4_found, p4_hourly, p4_hourly_whole, p4_watermarked, p6_found, p6_messages, p7_found, p7_plan, p7_compacted)
}
