"""python -m tidewater COMMAND PATH: upkeep of a stored table.

optimize merges small files, vacuum [--retain HOURS] removes files no version refers to, history and actions print the
log, count prints its rows, add-column NAME TYPE declares a column that old files do not have.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tidewater.operators import small_files
from tidewater.session import ship
from tidewater.sources.store import PartitionStore


def run(spark: SparkSession, arguments: list[str]) -> str:
    """What a command prints."""
    parser = argparse.ArgumentParser(prog="tidewater", description=__doc__)
    parser.add_argument("command", choices=["optimize", "vacuum", "history", "actions", "count", "add-column"])
    parser.add_argument("path")
    parser.add_argument("more", nargs="*")
    parser.add_argument("--retain", type=float, default=168.0, help="hours for which old versions stay readable")
    a = parser.parse_args(arguments)
    store = PartitionStore.open(spark, a.path)
    if a.command == "optimize":
        done = small_files.compact(store, small_bytes=small_files.TARGET_BYTES // 4)
        return f"{sum(x.files_before for x in done)} files became {sum(x.files_after for x in done)} in {len(done)} partitions"
    if a.command == "vacuum":
        return f"{len(store.vacuum(round(a.retain * 3_600_000_000)))} removed"
    if a.command == "count":
        return str(store.read().count())
    if a.command == "add-column":
        name, kind = a.more
        store.declare(name, kind)
        return f"{name} {kind} declared"
    rows = store.history() if a.command == "history" else store.actions()
    return "\n".join("\t".join(map(str, r)) for r in rows.orderBy("version").collect())


if __name__ == "__main__":
    import sys

    print(run(ship(SparkSession.builder.getOrCreate()), sys.argv[1:]))
