"""Filling fixed-capacity containers with texts: shortest pack first over the histogram of lengths.

Only the histogram reaches the driver: at most CAPACITY counts. Lengths are placed longest first; each item goes to
the shortest open pack, the one with most room, and packs are kept as patterns with counts, never one by one. Items that fit
no open pack open new ones, as many in each as it takes, or a corpus of equal lengths would fill a pack with one. The
patterns are then joined back to the texts by their rank among those of equal length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.session import c, materialize

CAPACITY = 2_048
#: Texts of equal length that are ranked by one task, about: the most frequent length is cut by hash into parts of that size.
RANKED_TOGETHER = 500_000


@dataclass
class Slots:
    """Per length, in order of rank: from rank `start`, `each` pieces a pack, of packs `first`, `first` + 1, ..."""

    start: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    at: list[int] = field(default_factory=list)


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(((length, times), ...), number of packs)]: a packing of `histogram`, length -> count."""
    open_: dict[int, dict[tuple[tuple[int, int], ...], int]] = {}  # room -> pattern -> packs
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        rooms = [-r for r in open_ if r >= length]  # a heap: the greatest room first
        heapify(rooms)
        while left and rooms:
            room = -heappop(rooms)
            shelf = open_.pop(room, {})
            while left and shelf:
                pattern, packs = shelf.popitem()
                used = min(packs, left)
                again = pattern and pattern[-1][0] == length
                wider = (*pattern[:-1], (length, pattern[-1][1] + 1)) if again else (*pattern, (length, 1))
                if room - length >= length and room - length not in open_:
                    heappush(rooms, length - room)
                _put(open_, wider, room - length, used)
                left -= used
                if packs > used:
                    shelf[pattern] = packs - used
            if shelf:
                open_[room] = shelf
        if left:
            fit = capacity // length
            if left // fit:
                _put(open_, ((length, fit),), capacity - fit * length, left // fit)
            if left % fit:
                _put(open_, ((length, left % fit),), capacity - left % fit * length, 1)
    return [(p, n) for room in sorted(open_) for p, n in sorted(open_[room].items())]


def _put(shelves: dict, pattern: tuple, room: int, packs: int) -> None:
    shelf = shelves.setdefault(room, {})
    shelf[pattern] = shelf.get(pattern, 0) + packs


def slots(packing: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, Slots]:
    """Where the pieces of each length go, by rank."""
    out: dict[int, Slots] = defaultdict(Slots)
    used: dict[int, int] = defaultdict(int)
    first = 0
    for pattern, packs in packing:
        at = 0
        for length, times in pattern:
            s = out[length]
            s.start.append(used[length])
            s.each.append(times)
            s.first.append(first)
            s.at.append(at)
            used[length] += packs * times
            at += times * length
        first += packs
    return out


def pack(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece int, container long, start int, n_tokens int): where each part of each item lies.

    An item above the capacity is split into full pieces and one rest; no other is split. Full pieces are
    containers of their own. An item of size 0 or null needs no room: one row, container null, n_tokens 0.
    Repeated keys are items of their own; a null key is kept; no items give an empty result.

    `sizes` is evaluated once and checkpointed: two numbers an item.
    """
    kind = dict(sizes.dtypes)[key]
    n = F.greatest(F.coalesce(c(size).cast("long"), F.lit(0)), F.lit(0))
    items = materialize(sizes.select(c(key).alias("k"), n.alias("n"), F.xxhash64(c(key).cast("string"), F.monotonically_increasing_id()).alias("h")))
    whole = (F.col("n") / capacity).cast("long")
    rest = F.col("n") - whole * capacity
    found = items.select(rest.cast("int").alias("rest"), (whole > 0).alias("split")).groupBy("rest").agg(F.count("*").alias("n"), F.count_if("split").alias("split")).collect()
    counted = {r["rest"]: r["n"] for r in found if r["rest"] > 0}
    parts = -(-max([1, *counted.values(), sum(r["split"] for r in found)]) // RANKED_TOGETHER)
    items = items.withColumn("part", F.pmod("h", F.lit(parts)).cast("int"))
    rests = items.select("k", whole.cast("int").alias("piece"), rest.cast("int").alias("n_tokens"), "part").where("n_tokens > 0")
    per_part = rests.groupBy("n_tokens", "part").count()
    packing = patterns(counted, capacity)
    place = {k: tuple(np.array(x, dtype=np.int64) for x in (s.start, s.each, s.first, s.at)) for k, s in slots(packing).items()}
    used = sum(packs for _, packs in packing)

    before = per_part.withColumn("offset", F.sum("count").over(W.partitionBy("n_tokens").orderBy("part")) - F.col("count")).drop("count")
    local = F.row_number().over(W.partitionBy("n_tokens", "part").orderBy("k")) - 1
    ranked = rests.withColumn("local", local).join(before, ["n_tokens", "part"]).select("k", "piece", "n_tokens", (F.col("local") + F.col("offset")).alias("rank"))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length, rank = b["n_tokens"].to_numpy(), b["rank"].to_numpy()
            container, start = np.empty(len(b), dtype=np.int64), np.empty(len(b), dtype=np.int32)
            for x in np.unique(length):
                rows = np.flatnonzero(length == x)
                begin, each, first, at = place[int(x)]
                r = np.searchsorted(begin, rank[rows], side="right") - 1
                inside = rank[rows] - begin[r]
                container[rows] = first[r] + inside // each[r]
                start[rows] = at[r] + inside % each[r] * x
            yield pd.DataFrame({"k": b["k"], "piece": b["piece"], "container": container, "start": start, "n_tokens": b["n_tokens"]})

    placed = ranked.mapInPandas(assign, f"k {kind}, piece int, container long, start int, n_tokens int")
    # full pieces: one container each, numbered per input part after those of the patterns
    whole_items = items.select("k", whole.alias("w"), "part").where("w > 0")
    totals = whole_items.groupBy("part").agg(F.sum("w").alias("t"))
    ahead = totals.withColumn("ahead", F.sum("t").over(W.orderBy("part")) - F.col("t")).drop("t")
    run = F.sum("w").over(W.partitionBy("part").orderBy("k", "w").rowsBetween(W.unboundedPreceding, 0)) - F.col("w")
    full = (
        whole_items.withColumn("run", run).join(ahead, "part")
        .select("k", F.posexplode(F.sequence(F.lit(1), F.col("w").cast("int"))).alias("piece", "x"), (F.col("run") + F.col("ahead") + F.lit(used)).alias("base"))
        .select("k", F.col("piece").cast("int").alias("piece"), (F.col("base") + F.col("piece")).alias("container"), F.lit(0).alias("start"), F.lit(capacity).alias("n_tokens"))
    )
    none = items.where("n = 0").select("k", F.lit(0).alias("piece"), F.lit(None).cast("long").alias("container"), F.lit(0).alias("start"), F.lit(0).alias("n_tokens"))
    return placed.unionByName(full).unionByName(none).withColumnRenamed("k", key)
