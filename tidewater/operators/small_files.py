"""Far too many small files: find them in the log of file actions and rewrite them as few well-sized ones."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.ids import tenant
from tidewater.operators.changefeed import latest_changes
from tidewater.session import c, fresh, hashable, materialize
from tidewater.sources.store import PartitionStore, State

#: Files below this size are worth merging.
SMALL_BYTES = 32_768
#: Size that merged files should have.
TARGET_BYTES = 128 * 1024 * 1024
#: What opening a file costs, in bytes read; low, or the engine would not put many tiny files into a split.
OPEN_COST_BYTES = 4_096


def relative_path(path: Column) -> Column:
    """A path relative to the table, project_id=.../date=.../file.parquet, however it was logged; else null.

    Percent-escapes, ./ and / in front, and an absolute location of the table do not matter.
    """
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    found = F.regexp_extract(plain, "(project_id=[^/]*/date=[^/]*/[^/]+\\.parquet)\\s*$", 1)
    return F.when(found != "", found)


def live_files(actions: DataFrame) -> DataFrame:
    """Files whose last action by commit_version is add: path, project_id, date, size_bytes, num_records, stamp.

    Repeated actions count once; clocks are ignored; a removal without an add is no file; actions
    without a path or version are ignored. Among actions of one commit a removal wins.
    """
    known = actions.select(
        relative_path(c("path")).alias("path"), "commit_version", (c("action_type") == "remove").alias("removed"),
        tenant(c("project_id")).alias("project_id"), "date", "size_bytes", "num_records", "stamp",
    ).where(F.col("path").isNotNull() & F.col("commit_version").isNotNull() & c("action_type").isin("add", "remove"))
    counted = F.col("num_records").desc_nulls_last()  # of an action that is logged again, the row that knows its records
    return latest_changes(known, ["path"], "commit_version", "removed", (counted,)).where(~F.col("removed")).drop("removed", "commit_version")


def work_list(files: DataFrame, by: list[str], small_bytes: int = SMALL_BYTES, target_bytes: int = TARGET_BYTES, at_least: int = 2) -> DataFrame:
    """The files to merge, with the `split` of their partition (`by`) they are read in: files (path, size_bytes, ...) below
    `small_bytes` of partitions that have `at_least` of them. `compact` and the queries on the log both start from it.

    Splits are those of the engine's packing: files by falling size, each weighing its bytes and the cost of opening it,
    a split ending at `target_bytes`. Counts are aggregated before they shuffle and joined back; a task holds the names of
    one partition's small files, as a stream.
    """
    small = files.where(F.col("size_bytes") < small_bytes)
    several = small.groupBy(*by).count().where(F.col("count") >= at_least)
    on = reduce(lambda x, y: x & y, [small[k].eqNullSafe(several[k]) for k in by])
    (n,) = fresh(small, "bytes")
    order = W.partitionBy(*by).orderBy(F.col("size_bytes").desc(), "path").rowsBetween(W.unboundedPreceding, -1)
    ahead = small.join(several, on, "left_semi").withColumn(n, F.coalesce(F.sum(F.col("size_bytes") + OPEN_COST_BYTES).over(order), F.lit(0)))
    return ahead.withColumn("split", (c(n) / target_bytes).cast("int")).drop(n)


def small_live_files(actions: DataFrame, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """The work list of the live files of a log of file actions."""
    return work_list(live_files(actions), ["project_id", "date"], small_bytes)


def compaction_plan(actions: DataFrame, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """Per partition: small live files, their bytes and records, and the number of splits they are read and written in."""
    return small_live_files(actions, small_bytes).groupBy("project_id", "date").agg(
        F.count("*").alias("files_before"), F.sum("size_bytes").alias("bytes"),
        F.sum("num_records").alias("known_records"), F.count_if(F.col("num_records").isNull()).alias("files_without_count"),
        (F.max("split") + 1).cast("long").alias("files_after"),
    )


def counts_from_log(actions: DataFrame) -> DataFrame:
    """Rows per partition from the log alone, no file opened: null where a live file has no count, never a guess."""
    return live_files(actions).groupBy("project_id", "date").agg(
        F.when(F.count_if(F.col("num_records").isNull()) == 0, F.sum("num_records")).alias("n"), F.count("*").alias("files")
    )


@dataclass(frozen=True)
class Rewrite:
    folder: str
    files_before: int
    files_after: int
    rows: int


class VerificationFailed(RuntimeError):
    """The staged output does not hold exactly the rows of the input; nothing was replaced."""


def _comparable(value: str, kind: T.DataType, depth: int = 0) -> str:
    """The SQL of a value with maps as arrays of their entries and variants as type and JSON text, which can be hashed."""
    if hashable(kind):
        return value
    x = f"x{depth}"
    if isinstance(kind, T.MapType):
        key, held = _comparable(f"{x}.key", kind.keyType, depth + 1), _comparable(f"{x}.value", kind.valueType, depth + 1)
        return f"transform(map_entries({value}), {x} -> struct({key} AS key, {held} AS value))"
    if isinstance(kind, T.ArrayType):
        return f"transform({value}, {x} -> {_comparable(x, kind.elementType, depth + 1)})"
    if isinstance(kind, T.StructType):
        fields = ", ".join(_comparable(f"{value}.{_quoted(f.name)}", f.dataType, depth) + f" AS {_quoted(f.name)}" for f in kind.fields)
        return f"if({value} IS NULL, NULL, struct({fields}))"
    return f"if({value} IS NULL, NULL, struct(schema_of_variant({value}) AS type, to_json({value}) AS json))"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _digest(df: DataFrame) -> tuple[int, str]:
    """Rows, and an order-free digest of their contents: sums of two independent hashes of every column.

    In SQL text, as building hundreds of columns one by one takes longer than a small job.
    """
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    texts = [f"coalesce(cast({_comparable(_quoted(f.name), f.dataType)} AS string), char(0))" for f in fields]
    total = lambda x: f"cast(coalesce(sum(cast({x} AS decimal(38,0))), 0) AS string)"
    hashed = df.selectExpr(f"xxhash64({', '.join(texts)}) AS h" if texts else "0L AS h")
    n, a, b = hashed.selectExpr("count(*)", total("h"), total("xxhash64(h, 1)")).first()
    return n, f"{a}/{b}"


def packed(store: PartitionStore, session: SparkSession, paths: list[str], size: int, target_bytes: int, schema: T.StructType) -> DataFrame:
    """Files read as combined splits of about `target_bytes`: the engine's own packing, and no shuffle."""
    return store.scan(paths, session=session, schema=schema).coalesce(max(1, -(-size // target_bytes)))


def packing_session(spark: SparkSession, target_bytes: int) -> SparkSession:
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", str(target_bytes))
    own.conf.set("spark.sql.files.openCostInBytes", str(OPEN_COST_BYTES))
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    return own


def lay_out(rows: DataFrame, files: DataFrame, store: PartitionStore, key: list[str]) -> None:
    """Write `rows` to `store` (partitioned by project_id and date), each partition in as many files as `files` has rows of it.

    A partition without any gets one file. Rows go to a file by the hash of `key`. The n-th file of a partition is written
    by task n, shifted by the partition so that tasks get about as many files each; there are as many tasks as a partition has files at most.
    """
    counts = materialize(files.groupBy("project_id", "date").agg(F.count("*").alias("files")))
    most = counts.agg(F.coalesce(F.max("files"), F.lit(1))).first()[0]
    n, to = fresh(rows, "files", "task")
    wanted = counts.select(F.col("project_id").alias("p"), F.col("date").alias("d"), F.col("files").alias(n))
    spread = rows.join(wanted, rows["project_id"].eqNullSafe(wanted["p"]) & rows["date"].eqNullSafe(wanted["d"]), "left").drop("p", "d")
    at = F.pmod(F.xxhash64(*[c(x) for x in key]), F.coalesce(c(n), F.lit(1))) + F.pmod(F.xxhash64("project_id", "date"), F.lit(most))
    tasks = spread.withColumn(to, (at % most).cast("int")).repartitionById(most, c(to))
    store.replace(tasks.drop(n, to), operation="lay out")


#: Scans that are one job and committed together, and the files they have, at most (one partition's files stay together).
LEGS_PER_JOB, FILES_PER_JOB = 32, 20_000
#: Least bytes of a scan, so that a small table isn't one scan a partition.
LEG_BYTES = 1024 * 1024


def stored_files(store: PartitionStore, state: State) -> DataFrame:
    """(path, folder, generation, name, size_bytes) of the files a version refers to, listed by the engine, none opened."""
    paths = store.paths(state.refs, state.written)
    if not paths:
        return store.spark.createDataFrame([], "path string, folder string, generation string, name string, size_bytes long")
    listed = store.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(paths)
    part = lambda k: F.regexp_extract("path", "/data/main/gen=([^/]+)/(.*)/([^/]+)$", k)
    return listed.select("path", part(2).alias("folder"), part(1).alias("generation"), part(3).alias("name"), F.col("length").alias("size_bytes"))


def compact(store: PartitionStore, small_bytes: int = SMALL_BYTES, target_bytes: int = TARGET_BYTES, sort: list[str] = ()) -> list[Rewrite]:
    """Merge the small files of each partition of a stored table.

    Partitions are gathered into scans of at most `target_bytes`, so that the engine packs each scan's small files into one split,
    which is written, without a shuffle, as one file per partition; a partition beyond that is a scan of its own, in several splits. Up to
    LEGS_PER_JOB scans are one job and one new generation. That is held against the input by row count and content digest before one entry
    of the log replaces exactly the files that were read; readers see the old files or the new ones. Rows and files that others
    add meanwhile stay; if others replaced the same files, nothing is committed. Large files stay where they are.
    The new files have every column that any file has. The driver holds the file names of one job.
    """
    state = store.state()
    files = materialize(stored_files(store, state))
    todo = materialize(work_list(files, ["folder"], small_bytes, target_bytes).select("path", F.lit(True).alias("small"), "size_bytes"))
    total = todo.agg(F.coalesce(F.sum(F.col("size_bytes") + OPEN_COST_BYTES), F.lit(0))).first()[0]
    # enough scans to keep the cluster busy, none larger than a file should be
    leg = min(target_bytes, max(LEG_BYTES, total // (2 * store.spark.sparkContext.defaultParallelism)))
    both = files.join(todo.select("path", "small"), "path", "left").withColumn("some", F.max("small").over(W.partitionBy("folder")))
    rows = both.where("some").select("folder", "generation", "name", "size_bytes", F.coalesce("small", F.lit(False)).alias("small")).orderBy("folder", "name")
    done: list[Rewrite] = []
    for legs in _jobs(groupby(rows.toLocalIterator(), key=lambda r: r["folder"]), leg):
        done += _rewrite(store, state, legs, target_bytes, sort)
    return done


def _jobs(groups: Iterator, leg_bytes: int) -> Iterator[list[dict[str, list]]]:
    """Jobs, each a list of scans, each partition folder -> its files."""
    legs: list[dict[str, list]] = []
    size = held = 0
    for folder, found in groups:
        files = list(found)
        bytes_ = sum(f["size_bytes"] + OPEN_COST_BYTES for f in files if f["small"])
        if not legs or size + bytes_ > leg_bytes:
            if legs and (len(legs) == LEGS_PER_JOB or held >= FILES_PER_JOB):
                yield legs
                legs, held = [], 0
            legs.append({})
            size = 0
        legs[-1][folder] = files
        size += bytes_
        held += len(files)
    if legs:
        yield legs


def _rewrite(store: PartitionStore, state: State, legs: list[dict[str, list]], target_bytes: int, sort: list[str]) -> list[Rewrite]:
    schema, base = store.whole_schema(state), f"{store.root}/data/main"
    session = packing_session(store.spark, target_bytes)
    order = [c(x) for x in dict.fromkeys([*store.partition_by, *sort])]
    scans, change, inputs = [], {}, []
    for leg in legs:
        small = [(folder, f) for folder, files in leg.items() for f in files if f["small"]]
        paths = [f"{base}/gen={f['generation']}/{folder}/{f['name']}" for folder, f in small]
        inputs += paths
        scans.append(packed(store, session, paths, sum(f["size_bytes"] + OPEN_COST_BYTES for _, f in small), target_bytes, schema).sortWithinPartitions(*order))
    batch = {folder: files for leg in legs for folder, files in leg.items()}
    for folder, files in batch.items():
        by: dict[str, list] = defaultdict(list)
        for f in files:
            by[f["generation"]].append(f)
        old, new = [], []
        for ref in state.refs[folder]:
            generation, _, name = ref.partition("/")
            held = [f for f in by[generation] if not name or f["name"] == name]
            if any(f["small"] for f in held):
                old.append(ref)
                new += [f"{generation}/{f['name']}" for f in held if not f["small"]]
        change[folder] = (old, new)
    generation, written = store.write(reduce(DataFrame.unionByName, scans), schema=schema)
    before, after = _digest(store.scan(inputs, schema=schema)), _digest(store.scan([f"{base}/gen={generation}"], schema=schema))
    if before != after:
        raise VerificationFailed(f"{before} in, {after} out")
    outputs = stored_files(store, State(refs={f: [generation] for f in written}, written={generation: len(written)}))
    made = {r["folder"]: r["count"] for r in outputs.groupBy("folder").count().collect()}
    counts = store.live_rows(store.scan([f"{base}/gen={generation}"]))
    clean = {f: state.clean[f] for f in change if f in state.clean}
    store.commit("optimize", {f: (old, [*new, generation] if f in written else new) for f, (old, new) in change.items()}, generation, len(written), clean, after[0])
    return [Rewrite(f, sum(x["small"] for x in files), made.get(f, 0), counts.get(f, 0)) for f, files in batch.items()]
