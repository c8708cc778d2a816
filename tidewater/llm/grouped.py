"""States per group: made in the tasks that hold the rows, shipped as bytes, joined as streams of sorted groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.session import c

#: Rows a task turns into states at once.
CHUNK = 500_000
#: States of one group that are held before they are joined, and bytes of a batch that is passed on.
HELD, BATCH_BYTES = 256, 16 << 20


def schema_of(keys: dict[str, str], *more: str) -> str:
    return ", ".join([*(f"{c_(k)} {t}" for k, t in keys.items()), *more])


def c_(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _codes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equal values, nulls included, as equal small integers."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _batches(keys: pa.RecordBatch, blobs: list[bytes], names: list[str], more: tuple[pa.Array, ...] = ()) -> Iterator[pa.RecordBatch]:
    """Rows of keys and states in batches of bounded bytes."""
    begin, size = 0, 0
    for i, x in enumerate(blobs):
        size += len(x)
        if size >= BATCH_BYTES or i + 1 == len(blobs):
            columns = [*keys.slice(begin, i + 1 - begin).columns, *[m.slice(begin, i + 1 - begin) for m in more], pa.array(blobs[begin : i + 1], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)
            begin, size = i + 1, 0


def make_states(rows: DataFrame, keys: dict[str, str], values: list[str], build: Callable[..., list[bytes]]) -> DataFrame:
    """(keys..., part, sketch): one state per group of every CHUNK rows of an input task; nothing shuffles.

    `build(group, arrays...)` gets the group number of each row (0, 1, ...) and the value columns, and returns the
    groups' states in that order. A null key is a group of its own.
    """
    names = list(keys)

    def emit(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        group = np.zeros(len(table), dtype=np.int64)
        for k in names:
            code = _codes(table.column(k))
            group = np.unique(group * (int(code.max()) + 1) + code, return_inverse=True)[1]
        first = np.full(int(group.max()) + 1, len(table), dtype=np.int64)
        np.minimum.at(first, group, np.arange(len(table)))
        blobs = build(group, *[table.column(v).to_numpy() for v in values])
        picked = table.select([*names, "part"]).take(pa.array(first)).combine_chunks().to_batches()[0]
        yield from _batches(picked, blobs, [*names, "part", "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if len(b):
                held.append(b)
                n += len(b)
            if n >= CHUNK:
                yield from emit(held)
                held, n = [], 0
        if n:
            yield from emit(held)

    ready = rows.select(*[c(k) for k in names], F.spark_partition_id().alias("part"), *[c(v) for v in values])
    return ready.mapInArrow(run, schema_of(keys, "part int", "sketch binary"))


def join_states(df: DataFrame, keys: dict[str, str], join: Callable[[list[bytes]], bytes], fan: int) -> DataFrame:
    """(keys..., sketch) from (keys..., part, sketch): hot groups are joined in `fan` parts first.

    A group has as many states as tasks made one, so the first step keeps each task's share of a group bounded and
    the second joins at most `fan` states a group.
    """
    salted = df.select(*[c(k) for k in keys], F.pmod("part", F.lit(fan)).cast("int").alias("part"), "sketch")
    once = _join_sorted(salted, {**keys, "part": "int"}, join)
    return _join_sorted(once.select(*[c(k) for k in keys], "sketch"), keys, join)


def _join_sorted(df: DataFrame, keys: dict[str, str], join: Callable[[list[bytes]], bytes]) -> DataFrame:
    """One row per group. Rows are shuffled and sorted by the keys and read as a stream: memory holds a batch and one group's states."""
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, states = None, []
        for batch in batches:
            if not len(batch):
                continue
            begins = np.zeros(len(batch), dtype=bool)
            begins[0] = True
            for name in names:
                code = _codes(batch.column(name))
                begins[1:] |= code[1:] != code[:-1]
            starts = np.flatnonzero(begins)
            blobs = batch.column("sketch").to_pylist()
            groups = [blobs[a:b] for a, b in zip(starts, [*starts[1:], len(blobs)])]
            at = batch.select(names)
            if key is not None:
                if at.slice(0, 1).to_pylist() == key.to_pylist():
                    groups[0] = states + groups[0]
                else:
                    yield from _batches(key, [join(states)], [*names, "sketch"])
            if len(groups) > 1:
                done = at.take(pa.array(starts[:-1]))
                yield from _batches(done, [join(g) for g in groups[:-1]], [*names, "sketch"])
            key, states = at.slice(int(starts[-1]), 1), groups[-1]
            if len(states) >= HELD:
                states = [join(states)]
        if key is not None:
            yield from _batches(key, [join(states)], [*names, "sketch"])

    by = [c(x) for x in names]
    return df.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema_of(keys, "sketch binary"))
