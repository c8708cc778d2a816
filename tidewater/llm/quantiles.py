"""Percentiles of very large numeric columns by dyadic Count-sketches.

Values are encoded into CODE_BITS-bit codes that keep their order: the sign, the exponent and the first MANTISSA bits of
the double, so a code stands for values within 2^-MANTISSA of each other, fractions included. A sketch keeps, for
each binary resolution of the codes, the number of values per dyadic interval: exact counts where there are
few intervals, a signed Count-sketch of DEPTH rows and WIDTH columns where there are many. Sketches are linear:
they merge by addition, and a deletion is a value of weight -1. A percentile descends the levels, taking the
left interval's estimate off the rank whenever it turns right.

Rank error. In one row of a level, a node's estimate is off by the nodes that share its column. Set the WIDTH / 32
heaviest of them aside: three of five rows meet one of these with a probability below 3e-4. The others hold at most
32 / WIDTH of the count n each, so they add a standard deviation of at most n * sqrt(32) / WIDTH to a row and about half
of that to the median of five, 0.15 % of n. A descent turns right at most once per sketched level, twelve times: 0.51 %
in the worst case of any distribution, and RANK_ERROR is twice that. Measured errors are in the README.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.grouped import join_states, make_states, schema_of
from tidewater.session import c

MANTISSA = 12
CODE_BITS = 12 + MANTISSA
DEPTH, WIDTH = 5, 2048
#: Levels below have a Count-sketch each; at this one and above the intervals are counted exactly.
EXACT_LEVEL = MANTISSA
#: Ranks are off by at most this share of the count: two standard deviations in the worst case, see above.
RANK_ERROR = 0.01
#: So many distinct codes are shipped as codes with weights, before the counters are filled: a matter of bytes only, as
#: percentiles are read from the counters' values in either form.
SHIPPED_CODES = 8_192
_CODED = np.dtype([("code", "<u4"), ("weight", "<i8")])
_EXACT = 1 << (CODE_BITS - EXACT_LEVEL)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def encode(values: np.ndarray) -> np.ndarray:
    """Codes of finite doubles, in their order; -0.0 counts as 0.0."""
    bits = (np.asarray(values, dtype=np.float64) + 0.0).view(np.int64)
    ordered = bits ^ ((bits >> 63) & 0x7FFFFFFFFFFFFFFF)
    return (ordered >> (64 - CODE_BITS)) + (1 << (CODE_BITS - 1))


def decode(codes: np.ndarray) -> np.ndarray:
    """The middle of the values a code stands for; 0 for the code that holds 0."""
    ordered = (np.asarray(codes, dtype=np.int64) - (1 << (CODE_BITS - 1))) << (64 - CODE_BITS)
    back = lambda x: (x ^ ((x >> 63) & 0x7FFFFFFFFFFFFFFF)).view(np.float64)
    low, high = back(ordered), back(ordered + ((1 << (64 - CODE_BITS)) - 1))
    return np.where((low == 0) | (high == 0), 0.0, np.where(np.isfinite(low) & np.isfinite(high), low / 2 + high / 2, low))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column and sign of each node in each row of a level's sketch."""
    h = _mix((nodes.astype(np.uint64)[None, :] + np.uint64(1 + (level << 32))) * _ODD[:, None])
    return (h & np.uint64(WIDTH - 1)).astype(np.int64), np.where((h >> np.uint64(40)) & np.uint64(1), 1, -1)


def _net(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, rising, with the sums of their weights; codes whose weights cancel out are gone."""
    distinct, where = np.unique(codes, return_inverse=True)
    sums = np.zeros(len(distinct), dtype=np.int64)
    np.add.at(sums, where, weights)
    return distinct[sums != 0], sums[sums != 0]


class Counters:
    """The counters of one sketch: exact counts per coarse interval and DEPTH x WIDTH signed ones per finer level."""

    def __init__(self, flat: np.ndarray | None = None) -> None:
        self.flat = np.zeros(_EXACT + EXACT_LEVEL * DEPTH * WIDTH, dtype=np.int64) if flat is None else flat
        self.exact, self.counts = self.flat[:_EXACT], self.flat[_EXACT:].reshape((EXACT_LEVEL, DEPTH, WIDTH))

    def add(self, codes: np.ndarray, weights: np.ndarray) -> Counters:
        codes, weights = np.asarray(codes, dtype=np.int64), np.asarray(weights, dtype=np.int64)
        np.add.at(self.exact, codes >> EXACT_LEVEL, weights)
        for level in range(EXACT_LEVEL):
            column, sign = _places(level, codes >> level)
            for row in range(DEPTH):
                np.add.at(self.counts[level, row], column[row], sign[row] * weights)
        return self

    def to_bytes(self) -> bytes:
        return b"d" + zlib.compress(self.flat.astype("<i8").tobytes(), 1)

    def quantiles(self, shares: list[float]) -> list[float | None]:
        """The values of rank ceil(share * n), at least the first; None of an empty sketch."""
        sums = np.cumsum(self.exact)
        n = int(sums[-1])
        if n <= 0:
            return [None] * len(shares)
        rank = np.array([max(1, int(np.ceil(q * n))) for q in shares], dtype=np.float64)
        node = np.minimum(np.searchsorted(sums, rank), len(sums) - 1).astype(np.int64)
        total = self.exact[node].astype(np.float64)
        rest = rank - (sums[node] - total)
        rows = np.arange(DEPTH)[:, None]
        for level in range(EXACT_LEVEL - 1, -1, -1):
            column, sign = _places(level, 2 * node)
            left = np.clip(np.median(self.counts[level, rows, column] * sign, axis=0), 0.0, total)
            node, rest, total = _turn(node, rest, total, left)
        return [float(x) for x in decode(node)]


def _turn(node: np.ndarray, rest: np.ndarray, total: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    right = rest > left
    return 2 * node + right, np.where(right, rest - left, rest), np.where(right, total - left, left)


def coded(codes: np.ndarray, weights: np.ndarray) -> bytes:
    """The state of netted codes."""
    if len(codes) > SHIPPED_CODES:
        return Counters().add(codes, weights).to_bytes()
    out = np.empty(len(codes), dtype=_CODED)
    out["code"], out["weight"] = codes, weights
    return b"c" + out.tobytes()


def _codes_of(state: bytes) -> tuple[np.ndarray, np.ndarray]:
    got = np.frombuffer(state, dtype=_CODED, offset=1)
    return got["code"].astype(np.int64), got["weight"]


def add_states(states: list[bytes]) -> bytes:
    """The state of all values of several."""
    if len(states) == 1:
        return states[0]
    got = np.frombuffer(b"".join(x[1:] for x in states if x[:1] == b"c"), dtype=_CODED)
    codes, weights = _net(got["code"].astype(np.int64), got["weight"])
    dense = [x for x in states if x[:1] == b"d"]
    if not dense:
        return coded(codes, weights)
    flat = sum(np.frombuffer(zlib.decompress(x[1:]), dtype="<i8") for x in dense)
    return Counters(flat.copy()).add(codes, weights).to_bytes()


def quantiles_of(states: list[bytes], shares: list[float]) -> tuple[list[int], list[list[float | None]]]:
    """Count and values of each state. Codes that were not put into counters yet give what the counters would."""
    n, values = [0] * len(states), [[None] * len(shares) for _ in states]
    small = [i for i, x in enumerate(states) if x[:1] == b"c"]
    for i in (i for i, x in enumerate(states) if x[:1] == b"d"):
        made = Counters(np.frombuffer(zlib.decompress(states[i][1:]), dtype="<i8"))
        n[i], values[i] = int(made.exact.sum()), made.quantiles(shares)
    if not small:
        return n, values
    sizes = np.array([(len(states[i]) - 1) // _CODED.itemsize for i in small])
    got = np.frombuffer(b"".join(states[i][1:] for i in small), dtype=_CODED)
    codes, weights = got["code"].astype(np.int64), got["weight"].astype(np.int64)
    owner = np.repeat(np.arange(len(small)), sizes)
    counts = np.bincount(owner, weights, len(small)).astype(np.int64)
    for i, k in zip(small, counts):
        n[i] = int(k)
    alive = np.flatnonzero(counts > 0)
    if not len(alive):
        return n, values
    # exact levels: running sums per coarse interval of each group
    place = owner * _EXACT + (codes >> EXACT_LEVEL)
    cuts = np.flatnonzero(np.diff(place, prepend=-1))
    interval, held = place[cuts], np.add.reduceat(weights, cuts)
    running = np.cumsum(held)
    before = np.concatenate(([0], np.cumsum(counts)))[:-1]
    found = []
    for q in shares:
        rank = np.maximum(1, np.ceil(q * counts[alive]))
        # a group's intervals are a stretch of rising sums
        at = np.searchsorted(running, rank + before[alive])
        found.append((interval[at] % _EXACT, rank + before[alive] - (running[at] - held[at]), held[at].astype(np.float64)))
    node, rest, total = (np.stack([f[k] for f in found]) for k in range(3))
    back = np.full(len(small), -1, dtype=np.int64)
    back[alive] = np.arange(len(alive))
    mine = back[owner]
    keep = mine >= 0
    codes, weights, mine = codes[keep], weights[keep], mine[keep]
    for level in range(EXACT_LEVEL - 1, -1, -1):
        column, sign = _places(level, codes >> level)
        signed = sign * weights
        left = np.empty(node.shape)
        for j in range(len(shares)):
            at, way = _places(level, 2 * node[j])
            rows = np.stack([np.bincount(mine, signed[r] * (column[r] == at[r][mine]), len(alive)) * way[r] for r in range(DEPTH)])
            left[j] = np.clip(np.median(rows, axis=0), 0.0, total[j])
        node, rest, total = _turn(node, rest, total, left)
    decoded = decode(node)
    for k, i in enumerate(alive):
        values[small[i]] = [float(x) for x in decoded[:, k]]
    return n, values


def _build(group: np.ndarray, value: np.ndarray, weight: np.ndarray) -> list[bytes]:
    codes = encode(value)
    order = np.lexsort((codes, group))
    group, codes, weight = group[order], codes[order], weight[order].astype(np.int64)
    new = np.ones(len(group), dtype=bool)
    new[1:] = (group[1:] != group[:-1]) | (codes[1:] != codes[:-1])
    cuts = np.flatnonzero(new)
    sums = np.add.reduceat(weight, cuts)
    owner, codes = group[cuts], codes[cuts]
    ends = np.searchsorted(owner, np.arange(int(group[-1]) + 2))
    out = np.empty(len(codes), dtype=_CODED)
    out["code"], out["weight"] = codes, sums
    kept = sums != 0
    if kept.all():
        return [b"c" + out[a:b].tobytes() if b - a <= SHIPPED_CODES else coded(codes[a:b], sums[a:b]) for a, b in zip(ends, ends[1:])]
    return [coded(codes[a:b][kept[a:b]], sums[a:b][kept[a:b]]) for a, b in zip(ends, ends[1:])]


def sketches(df: DataFrame, keys: dict[str, str], value: Column, weight: Column | None = None, fan: int = 16) -> DataFrame:
    """(keys..., sketch binary) per group; keys: output name -> type, columns of df; null values are ignored.

    Values of a group are summed up in the task that reads them, so a group sends one state per task however many
    values it holds, and hot groups need no special care. NaN and infinities are ignored like nulls. A null weight
    counts as 0; a null key is a group of its own. Integers beyond 2^53 are those of the nearest double.
    """
    w = F.lit(1).cast("long") if weight is None else F.coalesce(weight.cast("long"), F.lit(0))
    v = value.cast("double")
    rows = df.select(*[c(k) for k in keys], v.alias("__value"), w.alias("__weight"))
    x = F.col("__value")
    rows = rows.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return join_states(make_states(rows, keys, ["__value", "__weight"], _build), keys, add_states, fan)


def merge(df: DataFrame, keys: dict[str, str], fan: int = 16) -> DataFrame:
    """Sketches of a coarser grouping, by addition; a hot group is added up in `fan` parts first."""
    parts = df.select(*[c(k) for k in keys], F.pmod(F.xxhash64("sketch"), F.lit(1 << 20)).cast("int").alias("part"), "sketch")
    return join_states(parts, keys, add_states, fan)


def percentiles(df: DataFrame, keys: dict[str, str], points: dict[str, float]) -> DataFrame:
    """(keys..., n, one double per point) from sketches; points: column name -> share."""
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, values = quantiles_of(b.column("sketch").to_pylist(), list(points.values()))
            columns = [pa.array([v[j] for v in values], pa.float64()) for j in range(len(points))]
            yield pa.RecordBatch.from_arrays([*b.select(names).columns, pa.array(n, pa.int64()), *columns], [*names, "n", *points])

    return df.select(*[c(k) for k in keys], "sketch").mapInArrow(run, schema_of(keys, "n long", *(f"{p} double" for p in points)))
