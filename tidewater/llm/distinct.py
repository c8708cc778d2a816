"""Distinct counts over huge identifier sets by registers of minimum exponential hash values.

Every identifier gives each of the REGISTERS registers an exponential value of rate 1 drawn from its hash, and a register keeps
the minimum over all identifiers: an exponential of rate n. Sketches merge elementwise by minimum. The
registers' sum is gamma distributed with shape REGISTERS and rate n, which gives the unbiased count
(REGISTERS - 1) / sum and exact confidence intervals, alike for one identifier and for billions.

An identifier's values are drawn in rising order, as spacings of order statistics, and dealt to the registers by a
permutation made from its hash (a Feistel network over the register number). So it is done as soon as a value passes the
largest register, which after a few thousand identifiers is about the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.grouped import join_states, make_states, schema_of
from tidewater.session import c

REGISTER_BITS = 12
REGISTERS = 1 << REGISTER_BITS
#: Standard error of a count: 1 / sqrt(REGISTERS - 2).
RELATIVE_ERROR = 0.0157
#: So many identifiers are shipped as their hashes, which take no more room than the registers: a matter of bytes only,
#: as counts are always read from the registers the hashes give.
SHIPPED_HASHES = REGISTERS
#: Values drawn at once.
WAVE = 1 << 18
_Z95 = 1.959963984540054
_STEP = np.uint64(0x9E3779B97F4A7C15)
_HALF, _ROUNDS = REGISTER_BITS // 2, 4


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _registers_of(hashes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Where each identifier's values of the given ranks go: a permutation of the registers per identifier."""
    low = np.uint32((1 << _HALF) - 1)
    left = np.broadcast_to((ranks >> _HALF).astype(np.uint32), (len(hashes), len(ranks)))
    right = np.broadcast_to(ranks.astype(np.uint32) & low, (len(hashes), len(ranks)))
    for r in range(_ROUNDS):
        key = (_mix(hashes + _STEP * np.uint64(REGISTERS + 1 + r)) >> np.uint64(32)).astype(np.uint32)[:, None]
        x = (right + key) * np.uint32(0x9E3779B1)
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA77)
        left, right = right, left ^ (x >> np.uint32(32 - _HALF))
    return (left.astype(np.int64) << _HALF) | right


def _draw(registers: np.ndarray, hashes: np.ndarray, start: np.ndarray, first: int, last: int) -> np.ndarray:
    """Let the values of ranks first to last - 1 lower the registers; returns the last value of each identifier."""
    ranks = np.arange(first, last)
    a = _mix(hashes[:, None] + _STEP * (ranks.astype(np.uint64) + np.uint64(1)))
    spacing = -np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (REGISTERS - ranks)
    value = start[:, None] + np.cumsum(spacing, axis=1)
    useful = value <= registers.max()
    np.minimum.at(registers, _registers_of(hashes, ranks)[useful], value[useful])
    return value[:, -1]


def fill(registers: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Let identifiers (uint64) lower the registers. Neither order nor repeats matter."""
    hashes, at = hashes.astype(np.uint64), 0
    with np.errstate(over="ignore"):
        while at < len(hashes):
            top = registers.max()
            share = REGISTERS if np.isinf(top) else REGISTERS * -np.expm1(-top)  # ranks expected below the largest register
            draws = min(REGISTERS, int(share + 4 * share**0.5) + 4)
            left = hashes[at : at + (min(16, max(1, WAVE // draws)) if np.isinf(top) else max(1, WAVE // draws))]
            at += len(left)
            now, first = np.zeros(len(left)), 0
            while len(left) and first < REGISTERS:
                last = min(REGISTERS, first + draws)
                now = _draw(registers, left, now, first, last)
                first = last
                keep = now <= registers.max()
                left, now = left[keep], now[keep]
    return registers


def state_of(hashes: np.ndarray) -> bytes:
    """The state of distinct hashes."""
    if len(hashes) <= SHIPPED_HASHES:
        return b"s" + hashes.astype("<u8").tobytes()
    return b"d" + fill(np.full(REGISTERS, np.inf), hashes).astype("<f8").tobytes()


def registers_of(state: bytes) -> np.ndarray:
    if state[:1] == b"d":
        return np.frombuffer(state, dtype="<f8", offset=1)
    return fill(np.full(REGISTERS, np.inf), np.frombuffer(state, dtype="<u8", offset=1))


def join(states: list[bytes]) -> bytes:
    """The state of the union."""
    if len(states) == 1:
        return states[0]
    hashes = np.unique(np.frombuffer(b"".join(x[1:] for x in states if x[:1] == b"s"), dtype="<u8"))
    dense = [np.frombuffer(x, dtype="<f8", offset=1) for x in states if x[:1] == b"d"]
    if not dense:
        return state_of(hashes)
    return b"d" + fill(np.minimum.reduce(dense).copy() if len(dense) > 1 else dense[0].copy(), hashes).tobytes()


def estimate(registers: np.ndarray) -> tuple[float, float, float]:
    """Count and its 95 % confidence interval; 0 of no identifier."""
    total, m = float(registers.sum()), REGISTERS
    if np.isinf(total):
        return 0.0, 0.0, 0.0
    gamma = lambda z: m * (1 - 1 / (9 * m) + z / (3 * m**0.5)) ** 3
    return (m - 1) / total, gamma(-_Z95) / total, gamma(_Z95) / total


def _build(group: np.ndarray, h: np.ndarray) -> list[bytes]:
    h = h.view(np.uint64)
    order = np.lexsort((h, group))
    group, h = group[order], h[order]
    new = np.ones(len(group), dtype=bool)
    new[1:] = (group[1:] != group[:-1]) | (h[1:] != h[:-1])
    group, h = group[new], h[new]
    ends = np.searchsorted(group, np.arange(int(group[-1]) + 2))
    return [state_of(h[a:b]) for a, b in zip(ends, ends[1:])]


def partials(df: DataFrame, keys: dict[str, str], identifier: Column) -> DataFrame:
    """(keys..., part, sketch) per input task and group: nothing larger than a sketch leaves the task.

    Null identifiers are not counted; a null key is a group of its own.
    """
    rows = df.where(identifier.isNotNull()).select(*[c(k) for k in keys], F.xxhash64(identifier).alias("__hash"))
    return make_states(rows, keys, ["__hash"], _build)


def merge(df: DataFrame, keys: dict[str, str], fan: int = 64) -> DataFrame:
    """Sketches of a grouping from partial ones (keys..., part, sketch); hot groups in `fan` parts first."""
    return join_states(df, keys, join, fan)


def coarser(df: DataFrame, keys: dict[str, str], fan: int = 64) -> DataFrame:
    """Sketches of a coarser grouping from those of a finer one."""
    part = F.pmod(F.xxhash64("sketch"), F.lit(1 << 20)).cast("int").alias("part")
    return merge(df.select(*[c(k) for k in keys], part, "sketch"), keys, fan)


def cube(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Sketches of every combination of the keys, (level, keys..., sketch), from those of all keys together.

    `level` names the keys that a row groups by, joined by '+', or 'all'; the other keys are null.
    """
    names = list(keys)
    subsets = [[n for i, n in enumerate(names) if mask >> i & 1] for mask in range(2 ** len(names) - 1)]
    level = lambda s: "+".join(s) or "all"
    choice = F.array(*[F.struct(F.lit(level(s)).alias("level"), *[(F.col(n) if n in s else F.lit(None).cast(keys[n])).alias(n) for n in names]) for s in subsets])
    spread = df.select(F.explode(choice).alias("x"), "sketch").select("x.*", "sketch")
    return df.select(F.lit(level(names)).alias("level"), *names, "sketch").unionByName(coarser(spread, {"level": "string", **keys}))


def counts(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    """(keys..., n_distinct, low, high): unbiased count and 95 % interval."""
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [estimate(registers_of(x)) for x in b.column("sketch").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.select(names).columns, *[pa.array([x[k] for x in got], pa.float64()) for k in range(3)]], [*names, "n_distinct", "low", "high"])

    return df.select(*[c(k) for k in keys], "sketch").mapInArrow(run, schema_of(keys, "n_distinct double", "low double", "high double"))
