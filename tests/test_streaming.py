from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewater.operators.late_events import Lateness
from tidewater.operators.mor import Clock, VersionedTable
from tidewater.schema import SchemaError, TableSchema, change_feed_schema, declared
from tidewater.streaming.ingest import StreamIngest, tumbling_counts
from tidewater.streaming.late import LateAggregator

T = datetime(2023, 1, 5, 10)


def drop_files(spark, folder, schema, *batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_ingest_late_repeated_and_rerun(spark, tmp_path):
    clock = Clock()
    clock.set(1_700_000_000_000_000)
    table = VersionedTable(spark, str(tmp_path / "t"), change_feed_schema(), clock)
    ingest = StreamIngest(table)
    schema = "id string, timestamp timestamp, name string, project_id string, junk int"
    first = [("a", T, "x", "p", 1), ("a", T, "x", "p", 1), ("old", datetime(1990, 1, 1), "no", "p", 1), ("b", T - timedelta(days=300), "late", None, 1)]
    stream = drop_files(spark, str(tmp_path / "in"), schema, first, [("a", T, "x2", "p", 1), ("c", T, None, "q", 1)])
    for _ in range(2):
        ingest.start(stream, str(tmp_path / "cp"), once=True).awaitTermination()
    got = sorted((r.project_id, r.id, r.name) for r in table.read().collect())
    assert [x[:2] for x in got] == [("default", "b"), ("p", "a"), ("q", "c")] and len(got) == 3
    before = table.versions().count()
    ingest.batch(spark.createDataFrame(first, schema), 0)  # a batch that is run again
    assert table.versions().count() == before


def test_late_aggregator(spark, tmp_path):
    H = 3_600_000_000
    rule = Lateness(delay=timedelta(0), cutoff=timedelta(hours=2))
    agg = LateAggregator(spark, str(tmp_path / "state"), rule)
    schema = "source string, event_us long, arrival_us long, value long"
    batches = [
        [("a", 10 * H, 10 * H, 1), ("b", 10 * H, 10 * H, 2), ("a", None, 5, 9)],
        [("a", 11 * H, 11 * H, 4)],
        [("a", 10 * H, 11 * H + 1, 8), ("b", 11 * H, 11 * H, 16)],
        [("a", 10 * H + 1, 12 * H, 32), ("b", 10 * H, 14 * H, 64)],
    ]
    for k, rows in enumerate(batches):
        for _ in range(1 + (k == 2)):  # the third batch runs twice
            agg.batch(spark.createDataFrame(rows, schema), k)
    got = {r.period_us // H: r for r in agg.periods(3).collect()}
    ten = got[10]
    assert (ten.published_n, ten.published_sum, ten.corrections, ten.correction_sum, ten.diverted_n, ten.closed) == (3, 11.0, 1, 32.0, 1, True)
    assert (got[11].published_n, got[11].closed) == (2, False)
    odd = [("a", 10 * H, 99 * H, 128), ("a", 30 * H, None, 256), (None, None, 5, 512)]
    agg.batch(spark.createDataFrame(odd, schema), 4)
    assert sorted((r.value, r.fate) for r in agg.side(4).collect()) == [(128.0, "diverted"), (256.0, "unknown"), (512.0, "unknown")]
    last = {r.period_us // H: r for r in agg.periods(4).collect()}
    assert (last[10].diverted_n, last[10].diverted_sum - (ten.diverted_sum or 0)) == (2, 128.0) and (last[30].unknown_n, last[30].unknown_sum, last[30].published_n) == (1, 256.0, 0)
    stream = drop_files(spark, str(tmp_path / "in"), schema, *batches[:2])
    again = LateAggregator(spark, str(tmp_path / "state2"), rule)
    again.start(stream, str(tmp_path / "cp"), once=True).awaitTermination()
    assert again.periods(1).agg(F.sum("published_n")).first()[0] == 3


def test_idle_source_does_not_hold_the_watermark(spark, tmp_path):
    agg = LateAggregator(spark, str(tmp_path), Lateness(delay=timedelta(0), idle=timedelta(minutes=5)))
    sources = spark.createDataFrame([("a", 100, 10**9), ("b", 5, 10)], "source string, top_us long, last_us long")
    assert agg.low_watermark(sources) == 100 and agg.low_watermark(sources.limit(0)) is None


def test_tumbling_windows(spark, tmp_path):
    stream = drop_files(spark, str(tmp_path / "in"), "k string, ts timestamp", [("a", T), ("a", T + timedelta(minutes=4)), ("b", T)], [("a", T + timedelta(hours=3))])
    q = tumbling_counts(stream, "ts", "5 minutes", "10 minutes", ["k"]).writeStream.format("memory").queryName("tumbled").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.k, r.n) for r in spark.table("tumbled").collect()) == [("a", 2), ("b", 1)]


def test_schema_declarations(spark):
    from pyspark.sql import types as T_

    s = declared("x", T_.StructType([T_.StructField("timestamp", T_.TimestampType()), T_.StructField("date", T_.DateType()), T_.StructField("project_id", T_.StringType()), T_.StructField("id", T_.StringType())]), ("id",), dedup_keys=("id",))
    assert s.mutable() == {"id"} and s.spark().fieldNames() == ["timestamp", "date", "project_id", "id"]
    for bad in ({"dedup_keys": ("nope",)}, {"tombstone": "id"}, {"version_append": True}):
        with pytest.raises(SchemaError):
            TableSchema("x", s.fields, **bad).validate()
