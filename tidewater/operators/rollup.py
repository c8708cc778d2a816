"""Continuous aggregates: mergeable states per time bucket and dimensions, and the routing of queries to them.

A query is answered from the coarsest tier that can answer it exactly. Its window is cut into ranges the tier
covers, aligned to its grain, and the rest, which is aggregated from raw rows to the same states; both are
merged. Whatever a tier cannot answer is aggregated from raw rows, with the reason stated.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import Enum
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import sketches
from tidewater.schema import Measure, RollupSpec
from tidewater.session import c

MICRO = 1_000_000


def bucket_us(ts: Column, seconds: int) -> Column:
    micros = F.unix_micros(ts.cast("timestamp"))
    return micros - F.pmod(micros, F.lit(seconds * MICRO))


def _state(m: Measure) -> Column:
    """A measure of raw rows. Its filter belongs to the aggregate, never to the rows."""
    when = (lambda x: F.when(F.expr(m.filter), x)) if m.filter else (lambda x: x)
    value = c(m.column) if m.column else F.lit(1)
    made = {
        "count": lambda: F.count(when(value)), "sum": lambda: F.sum(when(value)), "min": lambda: F.min(when(value)), "max": lambda: F.max(when(value)),
        "tdigest": lambda: sketches.digest_of(when(value)), "hll": lambda: sketches.distinct_sketch(when(value)),
    }[m.agg]()
    return made.alias(m.name)


def _merge(m: Measure) -> Column:
    """A measure of states; filters were applied when they were built."""
    made = {
        "count": lambda: F.coalesce(F.sum(c(m.name)), F.lit(0)).cast("long"), "sum": lambda: F.sum(c(m.name)), "min": lambda: F.min(c(m.name)),
        "max": lambda: F.max(c(m.name)), "tdigest": lambda: sketches.merge_digests(c(m.name)), "hll": lambda: sketches.merge_distinct(c(m.name)),
    }[m.agg]()
    return made.alias(m.name)


def _keys(spec: RollupSpec) -> list[str]:
    return ["project_id", "bucket", *spec.dimensions]


def build(raw: DataFrame, spec: RollupSpec) -> DataFrame:
    """(project_id, bucket, dimensions..., measures...) from raw rows; null dimensions are values of their own."""
    keyed = raw.withColumn("bucket", bucket_us(c("timestamp"), spec.seconds)).where(F.col("bucket").isNotNull())
    return keyed.groupBy(*[c(k) for k in _keys(spec)]).agg(*[_state(m) for m in spec.measures])


def derive(finer: DataFrame, spec: RollupSpec) -> DataFrame:
    """A coarser tier from a finer one."""
    w = F.lit(spec.seconds * MICRO)
    keyed = finer.withColumn("bucket", F.col("bucket") - F.pmod(F.col("bucket"), w))
    return keyed.groupBy(*[c(k) for k in _keys(spec)]).agg(*[_merge(m) for m in spec.measures])


def refresh(tier: DataFrame, raw: DataFrame, spec: RollupSpec, dirty_hours: DataFrame) -> DataFrame:
    """The tier with the dirty hours (project_id, hour: micros) rebuilt from raw rows and the rest carried over."""
    hour = lambda x: x - F.pmod(x, F.lit(3_600 * MICRO))
    marks = dirty_hours.select("project_id", "hour").distinct()
    kept = tier.withColumn("hour", hour(F.col("bucket"))).join(marks, ["project_id", "hour"], "left_anti").drop("hour")
    again = raw.withColumn("hour", hour(F.unix_micros(c("timestamp").cast("timestamp")))).join(marks, ["project_id", "hour"], "left_semi").drop("hour")
    return kept.unionByName(build(again, spec).select(*tier.columns))


def with_identity(tier: DataFrame, generation: str) -> DataFrame:
    """Columns a stored tier carries besides: timestamp, date, a stable id, its generation."""
    ts = F.timestamp_micros(F.col("bucket"))
    dims = [F.coalesce(c(x).cast("string"), F.lit("\0")) for x in tier.columns if x not in ("bucket",) and dict(tier.dtypes)[x] == "string"]
    return tier.select("*", ts.alias("timestamp"), F.to_date(ts).alias("date"), F.md5(F.concat_ws("\1", F.col("bucket").cast("string"), *dims)).alias("id"), F.lit(generation).alias("rollup_generation"))


class Decline(Enum):
    NO_TIER = "no_tier"
    UNBOUNDED_TIME = "unbounded_time"
    PROJECT_NOT_PINNED = "project_not_pinned"
    UNKNOWN_GROUP_BY = "unknown_group_by"
    UNKNOWN_FILTER = "unknown_filter"
    BUCKET_NOT_MULTIPLE = "bucket_not_multiple"
    MISSING_MEASURE = "missing_measure"
    DISTINCT = "distinct"
    TOO_FEW_BUCKETS = "too_few_buckets"
    NOT_COVERED = "not_covered"
    ROW_FILTER_WITHOUT_GUARD = "row_filter_without_guard"


@dataclass(frozen=True)
class Ask:
    """An output column: agg is count, sum, min, max, avg, percentile or distinct."""

    name: str
    agg: str
    column: str | None = None
    filter: str | None = None
    p: float | None = None


@dataclass(frozen=True)
class AggregateQuery:
    """start and end (micros) bound the half-open window; end None is open. `all_projects` says that no project is meant in particular. `where` is dimension -> values,
    `row_filter` a condition on raw rows, `coalesce` replaces nulls of grouped dimensions."""

    asks: tuple[Ask, ...]
    start: int | None
    end: int | None
    projects: tuple[str, ...] = ()
    by_project: bool = False
    all_projects: bool = False
    bucket: int | None = None
    group: tuple[str, ...] = ()
    where: dict[str, tuple] = field(default_factory=dict)
    row_filter: str | None = None
    coalesce: dict[str, str] = field(default_factory=dict)
    distinct: bool = False


@dataclass
class Coverage:
    """Ranges (micros, half-open) for which a tier holds all raw rows, and the hours that writes have touched since."""

    ranges: list[tuple[int, int]] = field(default_factory=list)
    dirty: set[int] = field(default_factory=set)

    def invalidate(self, micros: int) -> None:
        self.dirty.add(micros - micros % (3_600 * MICRO))

    def valid(self, grain: int) -> list[tuple[int, int]]:
        """Covered ranges without the dirty hours, cut to whole buckets."""
        out = []
        for lo, hi in self.ranges:
            now = lo
            for h in sorted(self.dirty):
                if now < h + 3_600 * MICRO and h < hi:
                    out.append((now, max(now, h)))
                    now = max(now, h + 3_600 * MICRO)
            out.append((now, hi))
        g = grain * MICRO
        cut = [(-(-a // g) * g, b // g * g) for a, b in out]
        return [(a, b) for a, b in cut if a < b]


@dataclass
class Tier:
    spec: RollupSpec
    data: DataFrame
    coverage: Coverage


@dataclass(frozen=True)
class Routed:
    """What was decided: the tier, or none and why; ranges from the tier and from raw rows."""

    tier: Tier | None
    from_tier: tuple[tuple[int, int], ...] = ()
    from_raw: tuple[tuple[int, int], ...] = ()
    declined: tuple[tuple[str, Decline], ...] = ()

    @property
    def kind(self) -> str:
        return "raw" if self.tier is None else "hybrid" if self.from_raw else "rollup"


#: A window served from a tier in fewer buckets than this is not worth two legs.
MIN_BUCKETS = 2
_OPEN_END = 2**62


def _norm(text: str | None) -> str | None:
    return " ".join(text.split()).lower() if text else None


def _needs(ask: Ask) -> list[tuple[str, str | None]]:
    return {"avg": [("sum", ask.column), ("count", ask.column)], "percentile": [("tdigest", ask.column)], "distinct": [("hll", ask.column)]}.get(ask.agg, [(ask.agg, ask.column)])


def _measure(spec: RollupSpec, agg: str, column: str | None, condition: str | None) -> Measure | None:
    return next((m for m in spec.measures if (m.agg, m.column, _norm(m.filter)) == (agg, column, _norm(condition))), None)


def _match(q: AggregateQuery, spec: RollupSpec) -> Decline | None:
    if q.start is None:
        return Decline.UNBOUNDED_TIME
    if not q.projects and not q.by_project and not q.all_projects:
        return Decline.PROJECT_NOT_PINNED
    if q.distinct:
        return Decline.DISTINCT
    if not set(q.group) <= set(spec.dimensions):
        return Decline.UNKNOWN_GROUP_BY
    if not set(q.where) <= set(spec.dimensions):
        return Decline.UNKNOWN_FILTER
    if q.bucket is not None and q.bucket % spec.seconds:
        return Decline.BUCKET_NOT_MULTIPLE
    for a in q.asks:
        if q.row_filter and a.filter:
            return Decline.UNKNOWN_FILTER
        for agg, column in _needs(a):
            if _measure(spec, agg, column, a.filter or q.row_filter) is None:
                return Decline.MISSING_MEASURE
    if q.row_filter and _measure(spec, "count", None, q.row_filter) is None:
        return Decline.ROW_FILTER_WITHOUT_GUARD
    return None


def split(start: int, end: int, valid: list[tuple[int, int]], grain: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The window as aligned ranges inside `valid` and the ranges between them: an exact partition."""
    g = grain * MICRO
    inside = []
    for lo, hi in sorted(valid):
        a, b = max(lo, -(-start // g) * g), min(hi, end // g * g if end < _OPEN_END else hi)
        if a < b:
            inside.append((a, b))
    outside, now = [], start
    for a, b in inside:
        if now < a:
            outside.append((now, a))
        now = b
    if now < end:
        outside.append((now, end))
    return inside, outside


def route(q: AggregateQuery, tiers: list[Tier]) -> Routed:
    """The coarsest tier with the fewest dimensions that matches and covers enough of the window."""
    declined = []
    for t in sorted(tiers, key=lambda t: (-t.spec.seconds, len(t.spec.dimensions))):
        reason = _match(q, t.spec)
        if reason is None:
            end = _OPEN_END if q.end is None else q.end
            inside, outside = split(q.start, end, t.coverage.valid(t.spec.seconds), t.spec.seconds)
            if inside and sum(b - a for a, b in inside) >= MIN_BUCKETS * t.spec.seconds * MICRO:
                return Routed(t, tuple(inside), tuple(outside), tuple(declined))
            reason = Decline.TOO_FEW_BUCKETS if inside else Decline.NOT_COVERED
        declined.append((t.spec.name, reason))
    return Routed(None, declined=tuple(declined) or (("", Decline.NO_TIER),))


def _within(micros: Column, ranges) -> Column:
    tests = [(micros >= a) & (micros < b) if b < _OPEN_END else micros >= a for a, b in ranges]
    return reduce(lambda x, y: x | y, tests) if tests else F.lit(False)


def rows_within(raw: DataFrame, ranges) -> DataFrame:
    """Raw rows of the ranges (micros), by conditions that reach the files: on the timestamp as it is, and on the date partition."""
    at = lambda us: F.timestamp_micros(F.lit(us))
    t = c("timestamp") if dict(raw.dtypes)["timestamp"] == "timestamp" else c("timestamp").cast("timestamp")

    def one(a: int, b: int) -> Column:
        dated = "date" in raw.columns
        test = t.isNotNull() if a <= -_OPEN_END else (t >= at(a)) & (c("date") >= F.to_date(at(a))) if dated else t >= at(a)
        if b < _OPEN_END:
            test = test & (t < at(b)) & (c("date") <= F.to_date(at(b - 1))) if dated else test & (t < at(b))
        return test

    return raw.where(reduce(lambda x, y: x | y, [one(a, b) for a, b in ranges]) if ranges else F.lit(False))


def _stored_within(tier: DataFrame, ranges) -> DataFrame:
    """Tier rows of the ranges; a stored tier is pruned by date too."""
    out = tier.where(_within(F.col("bucket"), ranges))
    if "date" in tier.columns and ranges:
        out = out.where(F.col("date") >= F.to_date(F.timestamp_micros(F.lit(ranges[0][0]))))
        out = out.where(F.col("date") <= F.to_date(F.timestamp_micros(F.lit(ranges[-1][1] - 1)))) if ranges[-1][1] < _OPEN_END else out
    return out


def _filtered(df: DataFrame, q: AggregateQuery) -> DataFrame:
    if q.projects:
        df = df.where(c("project_id").isin(*q.projects))
    for d, values in q.where.items():
        some = [v for v in values if v is not None]
        test = c(d).isin(*some) if some else F.lit(False)
        df = df.where(test | c(d).isNull() if None in values else test)
    return df


def _final(states: DataFrame, q: AggregateQuery, spec: RollupSpec) -> DataFrame:
    keys = (["project_id"] if q.by_project else []) + (["time"] if q.bucket else []) + list(q.group)
    if q.bucket:
        states = states.withColumn("time", F.col("bucket") - F.pmod(F.col("bucket"), F.lit(q.bucket * MICRO)))
    for d, text in q.coalesce.items():
        states = states.withColumn(d, F.coalesce(c(d), F.lit(text)))
    merged = states.groupBy(*[c(k) for k in keys]).agg(*[_merge(m) for m in spec.measures])
    if q.row_filter:  # groups none of whose rows match do not exist
        guard = _measure(spec, "count", None, q.row_filter)
        if keys:
            merged = merged.where(c(guard.name) > 0)
    out = []
    for a in q.asks:
        m = {agg: c(_measure(spec, agg, column, a.filter or q.row_filter).name) for agg, column in _needs(a)}
        if a.agg == "avg":
            col = F.when(m["count"] > 0, m["sum"].cast("double") / m["count"])
        elif a.agg == "percentile":
            col = sketches.tdigest_quantile(F.lit(float(a.p)), m["tdigest"])
        elif a.agg == "distinct":
            col = sketches.distinct_count(m["hll"])
        else:
            col = m[a.agg]
        out.append(col.alias(a.name))
    return merged.select(*[c(k) for k in keys], *out)


def _needed(spec: RollupSpec, q: AggregateQuery) -> tuple[Measure, ...]:
    """The measures of a tier that a query reads; the others are neither merged nor made from raw rows."""
    asked = [(agg, column, a.filter or q.row_filter) for a in q.asks for agg, column in _needs(a)] + ([("count", None, q.row_filter)] if q.row_filter else [])
    return tuple(dict.fromkeys(_measure(spec, *x) for x in asked))


def raw_spec(q: AggregateQuery) -> RollupSpec:
    """The states a query needs, at a grain of its bucket: how raw rows alone are aggregated."""
    seen: dict[tuple, Measure] = {}
    for a in q.asks:
        for agg, column in _needs(a):
            seen.setdefault((agg, column, a.filter or q.row_filter), Measure(f"m{len(seen)}", agg, column, a.filter or q.row_filter))
    if q.row_filter:
        seen.setdefault(("count", None, q.row_filter), Measure(f"m{len(seen)}", "count", None, q.row_filter))
    grain = next((g for g, s in reversed(list({"1s": 1, "1m": 60, "1h": 3600, "1d": 86400}.items())) if q.bucket and q.bucket % s == 0), "1h")
    return _RawSpec(grain, tuple(dict.fromkeys([*q.group, *q.where])), tuple(seen.values()))


class _RawSpec(RollupSpec):
    @property
    def seconds(self) -> int:
        return {"1s": 1, "1m": 60, "1h": 3600, "1d": 86400}[self.grain]


def answer(q: AggregateQuery, raw: DataFrame, tiers: list[Tier]) -> tuple[DataFrame, Routed]:
    """The query's rows and how they were come by. Routed and raw answers are equal, digests up to their error."""
    routed = route(q, tiers)
    if routed.tier is None:
        spec = raw_spec(q)
        window = [(q.start if q.start is not None else -_OPEN_END, q.end if q.end is not None else _OPEN_END)]
        rows = _filtered(rows_within(raw, window), q)
        return _final(build(rows, spec), q, spec), routed
    spec = replace(routed.tier.spec, measures=_needed(routed.tier.spec, q))
    states = _filtered(_stored_within(routed.tier.data, routed.from_tier), q)
    if routed.from_raw:
        edges = build(_filtered(rows_within(raw, routed.from_raw), q), spec)
        states = states.select(*[c(x) for x in edges.columns]).unionByName(edges)
    return _final(states, q, spec), routed
