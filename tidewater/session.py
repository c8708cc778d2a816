"""Session, shared folders and small DataFrame helpers used by every operator."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(name: str = "tidewater", cpus: int = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it.

    Enough where executors see the driver's folders; other clusters install the package or get it by --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Only where that setting is absent and the master is local (single-machine tests) a temporary folder is made
    and registered, so that checkpoint() works as well; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tidewater-")
        sc.setCheckpointDir(named)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return str(named).rstrip("/")


_MADE: list[tuple[SparkSession, str]] = []


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new, unique folder below the shared one; it is removed when the driver ends."""
    if not _MADE:
        atexit.register(_remove)
    path = f"{shared_dir(spark)}/tidewater-{purpose}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def _remove() -> None:
    for spark, path in _MADE:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone already, and with it the wish to tidy up
            return


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def c(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Helper column names that no column of df has, whatever its case."""
    taken = {x.lower() for x in df.columns}
    out = []
    for base in wanted:
        name, k = f"__{base}", 0
        while name.lower() in taken:
            k += 1
            name = f"__{base}_{k}"
        taken.add(name.lower())
        out.append(name)
    return out


def hashable(kind: T.DataType) -> bool:
    """Whether xxhash64 takes the type and gives equal values equal hashes."""
    if isinstance(kind, T.ArrayType):
        return hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def row_hash(df: DataFrame, leave_out: tuple[str, ...] = ()) -> Column:
    """A deterministic hash of a row's hashable columns, the last tie-breaker of every ranking."""
    names = sorted(f.name for f in df.schema.fields if f.name not in leave_out and hashable(f.dataType))
    return F.xxhash64(*[F.coalesce(c(n).cast("string"), F.lit("\0")) for n in names]) if names else F.lit(0).cast("long")


def utc_micros(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp"))
