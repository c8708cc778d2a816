"""Change feeds: inserts, updates and deletes, repeated and out of order, become the current table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.session import c, fresh, row_hash


def latest_changes(
    changes: DataFrame, keys: list[str], version: str, tombstone: str | None = None, then: tuple[Column, ...] = ()
) -> DataFrame:
    """One row per key: the change with the greatest version.

    Window ranking with `rank = 1`: Catalyst puts a WindowGroupLimit on the map side, so of a key
    with very many versions each input partition ships one row, and no task ever holds a hot key.

    Defined results: a null version is older than every other; among equal versions a removal wins,
    then the order `then`, then the row with the greatest hash, so repeated rows collapse and the outcome never depends on
    their order; null keys are keys like any other; an empty feed gives an empty table; columns
    that are not named travel along.
    """
    rank, tie = fresh(changes, "rank", "tie")
    order: list[Column] = [c(version).desc_nulls_last()]
    if tombstone:
        order.append(F.coalesce(c(tombstone), F.lit(False)).desc())
    order += [*then, F.col(tie).desc()]
    ranked = changes.withColumn(tie, row_hash(changes)).withColumn(
        rank, F.row_number().over(W.partitionBy(*[c(k) for k in keys]).orderBy(*order))
    )
    return ranked.where(F.col(rank) == 1).drop(rank, tie)


def merge_changes(
    base: DataFrame | None, changes: DataFrame, keys: list[str], version: str, tombstone: str
) -> DataFrame:
    """The state of the table after the changes: one row per key, removals kept as tombstones.

    `base` is an earlier state with the same columns (None: no state yet). Tombstones stay in the
    state, or an old change that arrives after the removal would bring the record back;
    `current_rows` leaves them out. Merging feeds in any order or cut gives the same state.
    """
    new = latest_changes(changes, keys, version, tombstone)
    if base is None:
        return new
    new = new.select(*[c(x) for x in base.columns])
    tie, here = fresh(base, "tie", "here")

    def side(df: DataFrame) -> DataFrame:
        return df.select(
            F.struct(*[c(x) for x in base.columns]).alias("row"),
            F.struct(c(version).alias("v"), F.coalesce(c(tombstone), F.lit(False)).alias("d"), row_hash(df).alias("h")).alias(tie),
            *[c(k).alias(f"k{i}") for i, k in enumerate(keys)],
        )

    old, got = side(base).alias("b"), side(new).alias("n")
    on = [F.col(f"b.k{i}").eqNullSafe(F.col(f"n.k{i}")) for i in range(len(keys))]
    condition = on[0]
    for x in on[1:]:
        condition = condition & x
    joined = old.join(got, condition, "full_outer")
    newer = F.col(f"b.{tie}").isNull() | (F.col(f"n.{tie}") >= F.col(f"b.{tie}"))
    row = F.when(F.col("n.row").isNotNull() & newer, F.col("n.row")).otherwise(F.col("b.row"))
    return joined.select(row.alias(here)).select(f"{here}.*")


def current_rows(state: DataFrame, tombstone: str) -> DataFrame:
    """The records that exist: only a tombstone that is true removes one, null and false do not."""
    return state.where(~F.coalesce(c(tombstone), F.lit(False)))
