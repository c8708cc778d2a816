"""Enrichment updates that arrive one by one, applied together.

An UPDATE ... FROM reads and writes a table once however many source rows it has, so queued updates of one shape (table,
project, keys, assignments, condition) are folded into one of all their rows, in the order they came. Updates of other
shapes on the same table are not overtaken. A fold that fails is tried again update by update, and what fails then is kept aside with its error.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.mor import VersionedTable
from tidewater.session import fresh


@dataclass
class Update:
    table: VersionedTable
    project: str
    source: DataFrame
    on: dict[str, str]
    assignments: dict[str, str]
    where: str | None = None

    def shape(self) -> tuple:
        return self.table.path, self.project, tuple(self.on.items()), tuple(self.assignments.items()), self.where, self.source.schema.json()

    def apply(self, source: DataFrame | None = None, order: str | None = None) -> int:
        return self.table.update_from(self.project, self.source if source is None else source, self.on, self.assignments, self.where, order)


@dataclass
class UpdateQueue:
    """`limit`: how many updates are held before they are applied by themselves."""

    limit: int = 1_000
    held: list[Update] = field(default_factory=list)
    quarantined: list[tuple[Update, str]] = field(default_factory=list)

    def add(self, update: Update) -> int:
        """Hold an update; returns how many rows were changed if that filled the queue, else 0."""
        self.held.append(update)
        return self.flush() if len(self.held) >= self.limit else 0

    def flush(self) -> int:
        """Apply what is held, one pass per run of a shape; returns how many times a row was changed."""
        runs: list[list[Update]] = []
        last: dict[str, list[Update]] = {}
        for u in self.held:
            run = last.get(u.table.path)
            if run is not None and run[0].shape() == u.shape():
                run.append(u)
            else:
                last[u.table.path] = run = [u]
                runs.append(run)
        self.held = []
        return sum(self._apply(run) for run in runs)

    def _apply(self, run: list[Update]) -> int:
        if len(run) > 1:
            (seq,) = fresh(run[0].source, "seq")
            legs = [u.source.withColumn(seq, F.struct(F.lit(i).alias("turn"), F.monotonically_increasing_id().alias("row"))) for i, u in enumerate(run)]
            try:
                return run[0].apply(reduce(DataFrame.unionByName, legs), seq)
            except Exception:  # noqa: BLE001 - whatever failed, the updates are told apart below
                pass
        changed = 0
        for u in run:
            try:
                changed += u.apply()
            except Exception as e:  # noqa: BLE001
                self.quarantined.append((u, f"{type(e).__name__}: {e}"))
        return changed
