"""At-least-once deliveries become exactly one row per message.

A store keeps one winner per message, in partitions, next to an identifier index: per partition, the sorted
hashes of its keys. A batch of incoming rows looks its keys up in the index, which names the historical
partitions that hold earlier copies; only those are read, combined with the batch, reduced to single winners
and overwritten. Messages and index of a batch become visible by one commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.ids import message_id, tenant
from tidewater.session import c, fresh, row_hash
from tidewater.sources.store import PartitionStore, partition_folders

#: Partitions a date is divided into, by project.
SLOTS = 16


def messages(rows: DataFrame, identifier: str = "id", event_time: str = "timestamp", project: str = "project_id") -> DataFrame:
    """Rows plus msg_id, ts_ms, msg_date and slot. Rows without identifier or time have no identity and are left out."""
    micros = F.unix_micros(c(event_time).cast("timestamp"))
    return rows.select(
        *[c(x) for x in rows.columns if x.lower() not in ("msg_id", "ts_ms", "msg_date", "slot", "deliveries")],
        message_id(c(identifier)).alias("msg_id"),
        ((micros - F.pmod(micros, F.lit(1000))) / F.lit(1000)).cast("long").alias("ts_ms"),
        F.to_date(F.timestamp_micros(micros)).alias("msg_date"),
        F.pmod(F.xxhash64(tenant(c(project))), F.lit(SLOTS)).cast("int").alias("slot"),
    ).where(F.col("msg_id").isNotNull() & F.col("ts_ms").isNotNull())


def single_winners(rows: DataFrame, stamp: str = "updated_at") -> DataFrame:
    """One row per (msg_id, ts_ms): the copy with the greatest stamp, null stamps last, then the greatest hash.

    `deliveries` counts all copies (rows that already carry it count so many). An aggregate, not a window:
    copies are reduced before the shuffle, so a message delivered millions of times costs one row a task.
    """
    (best,) = fresh(rows, "best")
    names = [x for x in rows.columns if x not in ("msg_id", "ts_ms", "deliveries")]
    n = c("deliveries") if "deliveries" in rows.columns else F.lit(1).cast("long")
    tie = row_hash(rows, ("deliveries",))
    packed = rows.select(
        "msg_id", "ts_ms", n.alias("deliveries"),
        F.struct(c(stamp).alias("stamp"), tie.alias("tie")).alias("rank"), F.struct(*[c(x) for x in names]).alias(best),
    )
    won = packed.groupBy("msg_id", "ts_ms").agg(F.sum("deliveries").alias("deliveries"), F.max_by(best, "rank").alias(best))
    return won.select("msg_id", "ts_ms", "deliveries", f"{best}.*")


class MessageStore:
    """Exactly one row per message, kept up to date batch by batch."""

    PARTITIONS = ["msg_date", "slot"]
    INDEX = "index"

    def __init__(self, spark: SparkSession, root: str, columns: T.StructType, stamp: str = "updated_at"):
        own = {"msg_id", "ts_ms", "deliveries", "msg_date", "slot"}
        kept = [f for f in columns.fields if f.name.lower() not in own]
        schema = T.StructType(
            [T.StructField("msg_id", T.StringType()), T.StructField("ts_ms", T.LongType()), T.StructField("deliveries", T.LongType())]
            + kept
            + [T.StructField("msg_date", T.DateType()), T.StructField("slot", T.IntegerType())]
        )
        key = T.StructType([T.StructField("key_hash", T.LongType()), T.StructField("msg_date", T.DateType()), T.StructField("slot", T.IntegerType())])
        self.spark, self.stamp = spark, stamp
        self.store = PartitionStore(spark, root, schema, self.PARTITIONS, side={self.INDEX: key})

    def affected(self, batch: DataFrame) -> set[str]:
        """Historical partitions that hold a message of the batch. Of the index, the batch's dates are read; its files are
        sorted by key hash, so of these only what lies between the least and the greatest hash of the batch."""
        now = self.store.state()
        if not now.refs:
            return set()
        wanted = batch.select(F.xxhash64("msg_id", "ts_ms").alias("key_hash"), "msg_date").distinct()
        seen = wanted.groupBy("msg_date").agg(F.min("key_hash").alias("lo"), F.max("key_hash").alias("hi")).collect()  # a row per date
        held = {f: r for f, r in now.refs.items() if any(f.startswith(f"msg_date={d['msg_date']}/") for d in seen)}
        if not held:
            return set()
        lo, hi = min(d["lo"] for d in seen), max(d["hi"] for d in seen)
        index = self.store.scan(self.store.paths(held, now.written, self.INDEX), self.INDEX).where(F.col("key_hash").between(lo, hi))
        return partition_folders(index.join(wanted, ["key_hash", "msg_date"], "left_semi"), self.PARTITIONS)

    def apply(self, incoming: DataFrame) -> set[str]:
        """Merge a batch; returns the folders that were written. Applying a batch of new deliveries counts them."""
        batch = messages(incoming)
        folders = self.affected(batch)
        combined = batch.withColumn("deliveries", F.lit(1).cast("long"))
        if folders:
            history = self.store.read(folders)
            combined = history.select(*[c(x) for x in combined.columns]).unionByName(combined)
        won = single_winners(combined, self.stamp)
        # rebalancing gathers each partition's rows, splits a hot partition by size and joins small ones into a task
        placed = won.hint("rebalance", F.col("msg_date"), F.col("slot"))
        keys = lambda new: new.select(F.xxhash64("msg_id", "ts_ms").alias("key_hash"), "msg_date", "slot").sortWithinPartitions("msg_date", "slot", "key_hash")
        # partitions that only receive new messages are appended to, the affected ones are overwritten
        return self.store.replace(placed, drop=folders, append=True, operation="messages", side={self.INDEX: keys})[1]

    def index(self) -> DataFrame:
        return self.store.read(dataset=self.INDEX)

    def read(self) -> DataFrame:
        return self.store.read()


def ingest(spark: SparkSession, root: str, rows: DataFrame, stamp: str, batches: list) -> MessageStore:
    """Apply rows batch by batch; `batches` are the conditions that cut them, in order of arrival."""
    store = MessageStore(spark, root, rows.schema, stamp)
    for condition in batches:
        store.apply(rows.where(condition))
    return store


def deliver_once(rows: DataFrame, stamp: str = "updated_at") -> DataFrame:
    """Without a store: the winners of rows that are all at hand, with every column and `deliveries`.

    Keys alone tell which messages came more than once. Where Spark finds these small enough to broadcast, only
    their copies are shuffled with all columns and every other row stays where it is; else all rows are, once,
    as both joins read the same exchange.
    """
    keyed = messages(rows)
    repeated = keyed.groupBy("msg_id", "ts_ms").count().where("count > 1").select("msg_id", "ts_ms")
    once = keyed.join(repeated, ["msg_id", "ts_ms"], "left_anti").withColumn("deliveries", F.lit(1).cast("long"))
    several = single_winners(keyed.join(repeated, ["msg_id", "ts_ms"], "left_semi"), stamp)
    return several.select(*[c(x) for x in once.columns]).unionByName(once)


__all__ = ["MessageStore", "deliver_once", "ingest", "messages", "single_winners"]
