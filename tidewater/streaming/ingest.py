"""Streaming ingestion: micro-batches become row versions, late rows included, and rollup hours are marked dirty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidewater.operators.mor import VersionedTable, admitted, flush_dedup, normalize
from tidewater.session import c


class StreamIngest:
    """Appends a stream to a table. `trigger` is the flush cadence.

    A batch is normalised, freed of rows outside the admission bound and of repeats within it, and appended
    under one version stamp. Nothing is dropped for being late: a late or repeated row is a further version that
    readers resolve. After a failure between the append and the checkpoint a batch may be appended again, which
    resolves to the same rows; batches that are known to be complete are skipped.
    """

    def __init__(self, table: VersionedTable, trigger: str = "300 seconds"):
        self.table, self.trigger = table, trigger

    def _marker(self, batch_id: int):
        spark = self.table.spark
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.table.path}_batches/{batch_id:012d}")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def batch(self, rows: DataFrame, batch_id: int) -> None:
        fs, marker = self._marker(batch_id)
        if fs.exists(marker):
            return
        schema = self.table.schema
        ready = admitted(normalize(rows, schema), schema.time_column, self.table.clock.now())
        arrived = schema.version if schema.version in rows.columns else None
        self.table._append(flush_dedup(ready, list(schema.dedup_keys), arrived))
        fs.create(marker, True).close()

    def start(self, stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=self.trigger)).start()


def tumbling_counts(stream: DataFrame, time_column: str, width: str, lateness: str, by: list[str] = ()) -> DataFrame:
    """Counts per epoch-aligned window as a stream of its own; state is kept until the watermark passes a window."""
    from pyspark.sql import functions as F

    timed = stream.withColumn("event_time", c(time_column).cast("timestamp")).withWatermark("event_time", lateness)
    return timed.groupBy(F.window("event_time", width), *[c(x) for x in by]).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *[c(x) for x in by], "n")
