"""Merge-on-read tables: every change appends a full row version, readers see the newest one of each key."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions.ids import tenant
from tidewater.operators.changefeed import current_rows, latest_changes
from tidewater.schema import TableSchema
from tidewater.session import c, fresh, materialize
from tidewater.sources.store import PartitionStore, partition_folders

#: Source rows of one key that an UPDATE ... FROM folds at once; more are folded in further passes.
FOLD_ROWS = 10_000
#: Admission bound of event times: earliest instant, and how far ahead of now, in microseconds.
EARLIEST_US, AHEAD_US = 946_684_800_000_000, 48 * 3_600_000_000


class DmlError(ValueError):
    """The statement is refused."""


class Clock:
    """Version stamps in microseconds: now, but always later than the one before. Tests may set it."""

    def __init__(self, now: Callable[[], int] | None = None):
        self._now, self._last, self._fixed = now or (lambda: time.time_ns() // 1000), 0, None

    def set(self, micros: int) -> None:
        self._fixed = micros

    def advance(self, micros: int) -> None:
        self._fixed = (self._fixed if self._fixed is not None else self._now()) + micros

    def now(self) -> int:
        return self._fixed if self._fixed is not None else self._now()

    def stamp(self) -> int:
        self._last = max(self.now(), self._last + 1)
        return self._last


def resolve(versions: DataFrame, schema: TableSchema) -> DataFrame:
    """The newest version of each key, tombstones left out.

    The key also holds the partition columns: they are immutable, so nothing changes but that Catalyst can push
    conditions on them below the ranking, down to partition pruning. Conditions on other columns stay above,
    as a mutable column's older values must not decide.
    """
    keys = list(dict.fromkeys([*schema.partitions, *schema.dedup_keys]))
    newest = latest_changes(versions, keys, schema.version, schema.tombstone) if schema.version else versions.dropDuplicates(keys)
    return current_rows(newest, schema.tombstone) if schema.tombstone else newest


def flush_dedup(rows: DataFrame, keys: list[str], version: str | None = None, arrival: str | None = None) -> DataFrame:
    """One row per key of a batch: greatest version, ties to the last by `arrival`; without a version the last."""
    order = ([c(version).desc_nulls_last()] if version else []) + ([c(arrival).desc()] if arrival else [])
    if not order:
        return rows.dropDuplicates(keys)
    (rank,) = fresh(rows, "rank")
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(*[c(k) for k in keys]).orderBy(*order))).where(F.col(rank) == 1).drop(rank)


def normalize(rows: DataFrame, schema: TableSchema) -> DataFrame:
    """Rows as the table stores them: all columns in order, absent ones null, date from the time, default project."""
    have = {x.lower(): x for x in rows.columns}
    cols = []
    for f in schema.spark().fields:
        if f.name == "project_id" and f.name in have:
            col = tenant(c(f.name))
        elif f.name == "project_id":
            col = F.lit("default")
        elif f.name == "date" and schema.time_column in have:
            col = F.to_date(c(schema.time_column).cast("timestamp"))
        elif f.name.lower() in have:
            x = c(have[f.name.lower()])
            text = dict(rows.dtypes)[have[f.name.lower()]] == "string"
            col = F.parse_json(x) if f.dataType.typeName() == "variant" and text else x
        else:
            col = F.lit(None)
        cols.append(col.cast(f.dataType).alias(f.name))
    return rows.select(*cols)


def admitted(rows: DataFrame, time_column: str, now_us: int) -> DataFrame:
    """Rows whose event time is not before 2000 nor more than 48 hours ahead; a null time passes."""
    t = F.unix_micros(c(time_column).cast("timestamp"))
    return rows.where(t.isNull() | t.between(EARLIEST_US, now_us + AHEAD_US))


#: A literal, which stays as it is, or a column of the target or the source in the SQL of an UPDATE ... FROM.
_REFERENCE = re.compile(r"'(?:[^'\\]|\\.)*'|\b([ts])\.`?(\w+)`?")


class VersionedTable:
    """Row versions in a store partitioned by project and date; every statement is one entry of its log."""

    def __init__(self, spark: SparkSession, path: str, schema: TableSchema, clock: Clock | None = None, on_write: Callable[[DataFrame], None] | None = None):
        self.spark, self.path, self.schema, self.clock, self.on_write = spark, path, schema, clock or Clock(), on_write
        bloom = {f"parquet.bloom.filter.enabled#{f.name}": "true" for f in schema.fields if f.bloom}
        self.store = PartitionStore(spark, path, schema.spark(), list(schema.partitions), options=bloom)

    @property
    def keys(self) -> list[str]:
        """The key of resolution: partition columns are immutable, so they can be part of it."""
        return list(dict.fromkeys([*self.schema.partitions, *self.schema.dedup_keys]))

    def _order(self) -> list[Column]:
        """Partition columns first, or the writer would sort by them once more and undo the rest."""
        return [c(x) for x in self._names()]

    def _names(self) -> list[str]:
        return list(dict.fromkeys([*self.schema.partitions, *(self.schema.sort or self.schema.dedup_keys)]))

    def versions(self) -> DataFrame:
        return self.store.read()

    def read(self) -> DataFrame:
        """Current rows. Partitions that the log certifies to hold one version of each key, as after `dedup_rewrite`, are
        not ranked again; any later write to a partition ends its certificate."""
        now = self.store.state()
        if not now.clean:
            return resolve(self.versions(), self.schema)
        certified = self.store.scan(self.store.paths({f: now.refs[f] for f in now.clean if f in now.refs}, now.written))
        certified = current_rows(certified, self.schema.tombstone) if self.schema.tombstone else certified
        rest = {f: r for f, r in now.refs.items() if f not in now.clean}
        return certified.unionByName(resolve(self.store.scan(self.store.paths(rest, now.written)), self.schema)) if rest else certified

    def logical_count(self) -> int:
        """How many rows `read` has: certified partitions by the counts in the log, only the others are resolved."""
        now = self.store.state()
        rest = {f: r for f, r in now.refs.items() if f not in now.clean}
        counted = sum(now.clean[f] for f in now.clean if f in now.refs)
        return counted + (resolve(self.store.scan(self.store.paths(rest, now.written)), self.schema).count() if rest else 0)

    def _append(self, rows: DataFrame, operation: str = "insert", times: str | None = None) -> int:
        """Write rows under one stamp, counting them on the way. Rows may be read from the table itself: what a plan
        reads is fixed when it is made, and files are only added. `times`: a column to add up instead of counting rows.
        Rebalancing by partition, not every task writing into every partition, keeps the files few and well-sized."""
        stamp = F.timestamp_micros(F.lit(self.clock.stamp()).cast("long"))
        seen = Observation()
        counted = rows.observe(seen, (F.sum(times) if times else F.count(F.lit(1))).alias("n"))
        stamped = counted.withColumn(self.schema.version, stamp) if self.schema.version else counted
        ready = stamped.select(*[c(f.name) for f in self.schema.fields])
        ready = ready.hint("rebalance", *[c(p) for p in self.schema.partitions]).sortWithinPartitions(*self._order())
        generation, folders = self.store.replace(ready, append=True, operation=operation)
        if not folders:  # nothing was written, and of an empty plan nothing was observed
            return 0
        if self.on_write:
            self.on_write(self.store.read_generation(generation))
        return seen.get["n"] or 0

    def insert(self, rows: DataFrame) -> int:
        """Append rows under one stamp; returns how many passed the admission bound."""
        return self._append(admitted(normalize(rows, self.schema), self.schema.time_column, self.clock.now()))

    def _guard(self, assigned: list[str], project: str | None) -> None:
        if project is None:
            raise DmlError("UPDATE and DELETE need a project")
        bad = [a for a in assigned if a not in self.schema.mutable()]
        if bad:
            raise DmlError(f"immutable columns: {', '.join(bad)}")

    def update(self, project: str, assignments: dict[str, Column], where: Column | None = None) -> int:
        """Append new versions of the current rows that match; returns how many."""
        self._guard(list(assignments), project)
        rows = self.read().where(c("project_id") == project)
        rows = rows.where(where) if where is not None else rows
        return self._append(rows.withColumns({k: v.cast(dict(rows.dtypes)[k]) if dict(rows.dtypes)[k] != "variant" else v for k, v in assignments.items()}), "update")

    def delete(self, project: str, where: Column | None = None) -> int:
        """Append tombstones of the current rows that match; returns how many."""
        self._guard([], project)
        rows = self.read().where(c("project_id") == project)
        rows = rows.where(where) if where is not None else rows
        return self._append(rows.withColumn(self.schema.tombstone, F.lit(True)), "delete")

    def update_from(self, project: str, source: DataFrame, on: dict[str, str], assignments: dict[str, str], where: str | None = None, order: str | None = None) -> int:
        """UPDATE ... FROM: join current rows with `source` on target column -> source column.

        `assignments` and `where` are SQL over t.* and s.*. Source rows with the same key count one after the other, in
        the order of `order` (else that of the source, which is fixed first), so that the last one wins and each sees what the one before
        left. Returns how many times a row was changed. Source rows with a null key match nothing.

        The table is read, joined and written once. Where neither assignments nor condition look at the target, the
        source is reduced to the last row of each key before the join, map-side; else the rows of a key are folded over the target
        row as an array of at most FOLD_ROWS, and a key with more takes a further pass.
        """
        self._guard(list(assignments), project)
        turn, times, fold = fresh(source, "turn", "times", "fold")
        at = source.where(F.expr(" AND ".join(f"`{x}` IS NOT NULL" for x in on.values())))
        first = [c(order)] if order else []
        rows = materialize(at.withColumn(turn, F.struct(*[x.alias(f"o{i}") for i, x in enumerate(first)], F.monotonically_increasing_id().alias("id"))))
        texts = [*assignments.values(), *([where] if where else [])]
        sees_target = any(m[1] == "t" for x in texts for m in _REFERENCE.finditer(x))
        columns = F.struct(*[c(x) for x in source.columns])
        keys = [c(x).alias(f"k{i}") for i, x in enumerate(on.values())]
        names = [f"k{i}" for i in range(len(on))]
        target = lambda: self.read().where(c("project_id") == project).alias("t")
        matches = F.expr(" AND ".join(f"t.`{a}` = m.k{i}" for i, a in enumerate(on)))
        if not sees_target:
            kept = rows.alias("s").where(F.expr(where)) if where else rows
            last = kept.select(*keys, columns.alias("s"), c(turn).alias(turn)).groupBy(*names).agg(F.max_by("s", turn).alias("s"), F.count("*").alias(times)).alias("m")
            joined = target().join(last, matches)
            kinds = dict(target().dtypes)
            new = [(F.expr(assignments[x]).cast(kinds[x]) if x in assignments else F.col(f"t.`{x}`")).alias(x) for x in kinds]
            return self._append(joined.select(*new, F.col(f"m.{times}").alias(times)), "update", times)
        ranked = rows.select(*keys, columns.alias("s"), c(turn).alias(turn))
        ranked = ranked.withColumn(fold, ((F.row_number().over(W.partitionBy(*names).orderBy(turn)) - 1) / FOLD_ROWS).cast("int"))
        ranked = materialize(ranked)
        changed = 0
        for k in range((ranked.agg(F.max(fold)).first()[0] or 0) + 1):
            arrays = ranked.where(F.col(fold) == k).groupBy(*names).agg(F.array_sort(F.collect_list(F.struct(turn, "s"))).alias("rows")).alias("m")
            read = target()
            kinds = dict(read.dtypes)
            inside = lambda x: _REFERENCE.sub(lambda m: f"acc.`{m[2]}`" if m[1] == "t" and m[2] in assignments else f"e.s.`{m[2]}`" if m[1] == "s" else m[0], x)
            start = ", ".join(f"'{x}', t.`{x}`" for x in assignments)
            step = ", ".join(f"'{x}', CAST({inside(v)} AS {kinds[x]})" for x, v in assignments.items())
            taken = f"named_struct({step}, '{times}', acc.`{times}` + 1L)"
            merge = f"CASE WHEN {inside(where)} THEN {taken} ELSE acc END" if where else taken
            folded = F.expr(f"aggregate(m.rows, named_struct({start}, '{times}', 0L), (acc, e) -> {merge})")
            joined = read.join(arrays, matches).withColumn(fold, folded).where(F.col(f"{fold}.{times}") > 0)
            new = [(F.col(f"{fold}.`{x}`") if x in assignments else F.col(f"t.`{x}`")).alias(x) for x in kinds]
            changed += self._append(joined.select(*new, F.col(f"{fold}.{times}").alias(times)), "update", times)
        return changed

    def compacted(self, target_path: str) -> VersionedTable:
        """A copy that keeps only the newest version of each key; tombstones stay, so late changes cannot revive."""
        newest = latest_changes(self.versions(), self.keys, self.schema.version, self.schema.tombstone)
        copy = VersionedTable(self.spark, target_path, self.schema, self.clock, self.on_write)
        copy.store.replace(newest.hint("rebalance", *[c(p) for p in self.schema.partitions]), operation="copy")
        return copy

    def dedup_rewrite(self) -> int:
        """Reduce the partitions that hold several versions of a key to the newest ones; returns rows removed.

        Only those partitions are read and written; one entry of the log replaces them and certifies them clean. A writer
        that changed one of them meanwhile makes it fail with nothing replaced.
        """
        parts = list(self.schema.partitions)
        touched = materialize(self.duplicates().groupBy(*[c(p) for p in parts]).agg(F.sum("surplus").alias("surplus")))
        removed = touched.agg(F.coalesce(F.sum("surplus"), F.lit(0))).first()[0]
        if not removed:
            return 0
        folders = partition_folders(touched, parts)
        self.certify(folders)
        return removed

    def certify(self, folders: set[str]) -> None:
        """Rewrite partitions with the newest version of each key and record in the log that they are clean, with their live rows."""
        store = self.store
        before = store.state()
        refs = {f: before.refs[f] for f in folders if f in before.refs}
        old = store.scan(store.paths(refs, before.written))
        newest = latest_changes(old, self.keys, self.schema.version, self.schema.tombstone)
        placed = newest.hint("rebalance", *[c(p) for p in self.schema.partitions]).sortWithinPartitions(*self._order())
        generation, written = store.write(placed)
        new = store.read_generation(generation)
        keys = old.select(*[c(k) for k in self.keys]).distinct().count()
        n = new.count()
        if n != keys:
            raise DmlError(f"the rewrite has {n} rows for {keys} keys; nothing was replaced")
        live = store.live_rows(current_rows(new, self.schema.tombstone) if self.schema.tombstone else new)
        store.commit("dedup", {f: (r, [generation] if f in written else []) for f, r in refs.items()}, generation, len(written), {f: live.get(f, 0) for f in refs}, n)

    def order_violations(self) -> DataFrame:
        """(file, violations) of files whose rows are not in the declared order: what a merge that trusted the order would get wrong."""
        file, row, before = "__file", "__row", "__before"
        order = F.struct(*[c(x) for x in self._names()])
        rows = self.versions().select("_metadata.file_path", "_metadata.row_index", order.alias(before)).toDF(file, row, before)
        last = F.lag(before).over(W.partitionBy(file).orderBy(row))
        return rows.withColumn("worse", F.coalesce(last > F.col(before), F.lit(False))).where("worse").groupBy(F.col(file).alias("file")).agg(F.count("*").alias("violations"))

    def duplicates(self) -> DataFrame:
        """Ten-minute bins that hold more than one version of a key: what a dedup rewrite has to touch."""
        t = F.unix_micros(c(self.schema.time_column).cast("timestamp"))
        bins = F.timestamp_micros(t - F.pmod(t, F.lit(600_000_000)))
        many = self.versions().groupBy(*[c(k) for k in self.keys]).count().where("count > 1")
        return many.groupBy(*[c(p) for p in self.schema.partitions], bins.alias("bin")).agg(F.count("*").alias("keys"), F.sum(F.col("count") - 1).alias("surplus"))
