"""Rollup tiers on disk: built once, kept up to date hour by hour, and found again by the next session.

Each tier is a partition store by date. Coverage, the ranges for which the tiers hold all raw rows and the hours that
writes have touched since, is a numbered document next to them. Data are committed before the coverage that promises
them, so after a crash an hour is at worst still marked dirty and rebuilt once more.
"""

from __future__ import annotations

import hashlib
import json
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.operators import rollup
from tidewater.schema import RollupSpec
from tidewater.sources.store import PartitionStore

HOUR = 3_600 * rollup.MICRO


def fingerprint(spark: SparkSession, path: str) -> str:
    """What tells whether the files below a path are still the same: their number, size and the time of the last change."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    s = fs.getContentSummary(p)
    return f"{s.getFileCount()}/{s.getLength()}/{fs.getFileStatus(p).getModificationTime()}"


class TierStore:
    """The tiers of one table: the finest spec first, others derived from it."""

    def __init__(self, spark: SparkSession, root: str, specs: tuple[RollupSpec, ...], raw: T.StructType):
        #: The declaration the tiers are built by; each has a folder of its own, those of earlier ones are trusted by nobody.
        self.generation = hashlib.sha256(json.dumps([s.__dict__ for s in specs], default=lambda x: x.__dict__, sort_keys=True).encode()).hexdigest()[:16]
        self.spark, self.root, self.specs = spark, f"{root.rstrip('/')}/{self.generation}", specs
        self.stores: dict[str, PartitionStore] = {}
        for s in specs:
            try:  # the log knows the columns
                self.stores[s.name] = PartitionStore.open(spark, f"{self.root}/{s.name}")
            except FileNotFoundError:
                made = rollup.build(spark.createDataFrame([], raw), specs[0])
                schema = self._dated(made if s is specs[0] else rollup.derive(made, s)).schema
                self.stores[s.name] = PartitionStore(spark, f"{self.root}/{s.name}", schema, ["date"])

    def _dated(self, tier: DataFrame) -> DataFrame:
        return tier.withColumn("date", F.to_date(F.timestamp_micros("bucket")))

    # --- coverage

    def _documents(self) -> list[str]:
        return [n for n in self.stores[self.specs[0].name]._names("_coverage") if n.endswith(".json")]

    def _document(self) -> dict:
        names = self._documents()
        found = self.stores[self.specs[0].name]._read_json("_coverage", names[-1]) if names else {}
        return found if found.get("generation") == self.generation else {"ranges": [], "dirty": [], "source": None}

    def _promise(self, document: dict) -> None:
        store = self.stores[self.specs[0].name]
        for _ in range(20):
            names = self._documents()
            number = int(names[-1].split(".")[0]) + 1 if names else 1
            if store._put_json({**document, "generation": self.generation}, "_coverage", f"{number:012d}.json"):
                return
        raise OSError("the coverage could not be written")

    def coverage(self) -> rollup.Coverage:
        d = self._document()
        return rollup.Coverage([tuple(r) for r in d["ranges"]], set(d["dirty"]))

    def source(self) -> str | None:
        return self._document()["source"]

    def tiers(self) -> list[rollup.Tier]:
        cover = self.coverage()
        return [rollup.Tier(s, self.stores[s.name].read(), cover) for s in self.specs if self.stores[s.name].version()]

    # --- changes

    def build(self, raw: DataFrame, source: str | None = None) -> None:
        """All of it anew, from raw rows with a timestamp."""
        fine = self.stores[self.specs[0].name]
        self._replace(fine, rollup.build(raw, self.specs[0]))
        for s in self.specs[1:]:
            self._replace(self.stores[s.name], rollup.derive(fine.read(), s))
        lo, hi = fine.read().agg(F.min("bucket"), F.max("bucket")).first()
        self._promise({"ranges": [] if lo is None else [[lo - lo % HOUR, hi - hi % HOUR + HOUR]], "dirty": [], "source": source})

    def _replace(self, store: PartitionStore, tier: DataFrame, folders: set[str] | None = None) -> None:
        drop = set(store.manifest()) if folders is None else folders
        store.replace(self._dated(tier).hint("rebalance", F.col("date")).sortWithinPartitions("date", "project_id", "bucket"), drop=drop, operation="tier")

    def invalidate(self, hours: set[int]) -> None:
        """Hours (micros) whose raw rows changed are answered from raw rows until the next refresh."""
        d = self._document()
        if hours - set(d["dirty"]):
            self._promise({**d, "dirty": sorted({*d["dirty"], *(h - h % HOUR for h in hours)})})

    def refresh(self, raw: DataFrame) -> int:
        """Rebuild the dirty hours from raw rows; only their dates are read and replaced. Returns how many."""
        d = self._document()
        hours = sorted(d["dirty"])
        if not hours:
            return 0
        days = sorted({h // (24 * HOUR) for h in hours})
        folders = {f"date={_day(x)}" for x in days}
        fine = self.stores[self.specs[0].name]
        hour = lambda col: col - F.pmod(col, F.lit(HOUR))
        kept = fine.read(folders).where(~hour(F.col("bucket")).isin(hours)).drop("date")
        ranges = [(h, h + HOUR) for h in hours]
        self._replace(fine, kept.unionByName(rollup.build(rollup.rows_within(raw, ranges), self.specs[0])), folders)
        for s in self.specs[1:]:
            self._replace(self.stores[s.name], rollup.derive(fine.read(folders).drop("date"), s), folders)
        left = self._document()
        self._promise({**left, "ranges": _joined([*map(tuple, left["ranges"]), *ranges]), "dirty": sorted(set(left["dirty"]) - set(hours))})
        return len(hours)


def _joined(ranges: list[tuple[int, int]]) -> list[list[int]]:
    """Ranges that touch or overlap as one. Those apart stay apart: nothing between them is promised."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _day(days: int) -> str:
    return (date(1970, 1, 1) + timedelta(days=days)).isoformat()
