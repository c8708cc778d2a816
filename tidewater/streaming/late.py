"""The late-event operator over a stream: per-source low watermarks kept between micro-batches.

State is two small Parquet tables per batch, sources and periods, written to a new folder each time and read from
that of the batch before; a batch that is run again writes the same folder again. So does a third table with the
records that no period takes any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater.operators.late_events import Lateness, _us

SOURCES = "source string, top_us long, last_us long"
SIDE = "source string, event_us long, arrival_us long, value double, fate string"
COUNTS = ("published_n", "published_sum", "corrections", "correction_sum", "diverted_n", "diverted_sum", "unknown_n", "unknown_sum")
PERIODS = "period_us long, " + ", ".join(f"{x} {'double' if x.endswith('sum') else 'long'}" for x in COUNTS) + ", closed boolean"


class LateAggregator:
    """Per-period counts and sums of a stream of (source, event_us, arrival_us, value).

    At the start of a batch the low watermark is the least over sources of the greatest event time seen minus
    `delay`; sources silent for `idle` before the newest arrival don't count. Periods that end at or below it are
    closed: later events correct them until the cut-off. Events after it are diverted: they are written whole to
    the side table of their batch and counted and summed in their period, as are events without an arrival time
    (fate unknown); those without an event time are in the side table only.
    """

    def __init__(self, spark: SparkSession, state: str, rule: Lateness):
        self.spark, self.state, self.rule = spark, state.rstrip("/"), rule

    def _read(self, table: str, schema: str, batch_id: int) -> DataFrame:
        path = f"{self.state}/{table}/batch={batch_id}"
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if batch_id < 0 or not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def low_watermark(self, sources: DataFrame) -> int | None:
        now = F.max("last_us").alias("now")
        newest = sources.agg(now).first()[0]
        if newest is None:
            return None
        active = sources if self.rule.idle is None else sources.where(F.col("last_us") > newest - _us(self.rule.idle))
        top = active.agg(F.min("top_us")).first()[0]
        return None if top is None else top - _us(self.rule.delay)

    def batch(self, rows: DataFrame, batch_id: int) -> None:
        events = rows.select("source", "event_us", "arrival_us", F.col("value").cast("double").alias("value"))
        known = events.where("event_us is not null and arrival_us is not null")
        sources, periods = self._read("sources", SOURCES, batch_id - 1), self._read("periods", PERIODS, batch_id - 1)
        low = self.low_watermark(sources)
        shut = F.lit(False) if low is None else self.rule.end(F.col("event_us")) <= low
        late = F.col("arrival_us") > self.rule.end(F.col("event_us")) + _us(self.rule.cutoff)
        fate = F.when(F.col("event_us").isNull() | F.col("arrival_us").isNull(), "unknown").when(late, "diverted").when(shut, "correction").otherwise("on_time")
        fates = events.withColumn("fate", fate)
        fates.where("fate in ('diverted', 'unknown')").write.mode("overwrite").parquet(f"{self.state}/side/batch={batch_id}")
        kinds = dict(zip(("on_time", "correction", "diverted", "unknown"), zip(COUNTS[::2], COUNTS[1::2])))
        counted = [x for k, (n, total) in kinds.items() for x in (F.count_if(F.col("fate") == k).alias(n), F.sum(F.when(F.col("fate") == k, F.col("value"))).alias(total))]
        new = fates.where("event_us is not null").groupBy(self.rule.start(F.col("event_us")).alias("period_us")).agg(*counted, F.lit(False).alias("closed"))
        merged = periods.unionByName(new).groupBy("period_us").agg(*[F.sum(x).alias(x) for x in COUNTS], F.max("closed").alias("closed"))
        tops = sources.unionByName(known.groupBy("source").agg(F.max("event_us").alias("top_us"), F.max("arrival_us").alias("last_us")))
        after = tops.groupBy("source").agg(F.max("top_us").alias("top_us"), F.max("last_us").alias("last_us"))
        after.write.mode("overwrite").parquet(f"{self.state}/sources/batch={batch_id}")
        reached = self.low_watermark(self._read("sources", SOURCES, batch_id))
        closed = F.col("closed") if reached is None else F.col("closed") | (F.col("period_us") + _us(self.rule.period) <= reached)
        merged.withColumn("closed", closed).write.mode("overwrite").parquet(f"{self.state}/periods/batch={batch_id}")

    def periods(self, batch_id: int) -> DataFrame:
        return self._read("periods", PERIODS, batch_id)

    def side(self, batch_id: int) -> DataFrame:
        """The records of a batch that no period took."""
        return self._read("side", SIDE, batch_id)

    def start(self, stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
