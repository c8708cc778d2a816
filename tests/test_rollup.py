import random

import pytest
from pyspark.sql import functions as F

from tidewater.engine import Engine
from tidewater.operators import rollup as r
from tidewater.schema import Measure, RollupSpec, SchemaError

H, M, S = 3_600_000_000, 60_000_000, 1_000_000
ERR = "status = 'ERROR'"
MEASURES = (
    Measure("n", "count"), Measure("errors", "count", None, ERR), Measure("s", "sum", "v"), Measure("c", "count", "v"), Measure("lo", "min", "v"), Measure("hi", "max", "v"),
    Measure("d", "tdigest", "v"), Measure("u", "hll", "user"), Measure("es", "sum", "v", ERR), Measure("ec", "count", "v", ERR),
)
FINE = RollupSpec("1m", ("svc", "kind"), MEASURES, "fine")
COARSE = RollupSpec("1h", ("svc", "kind"), MEASURES, "coarse", "fine")


@pytest.fixture(scope="module")
def raw(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("pq"), rnd.randrange(0, 6 * H), rnd.choice(["a", "b", None]), rnd.choice(["x", "y"]), rnd.choice(["OK", "ERROR"]), rnd.choice([None, *range(50)]), rnd.randrange(30)) for _ in range(3_000)]
    return spark.createDataFrame(rows, "project_id string, us long, svc string, kind string, status string, v long, user int").withColumn("timestamp", F.timestamp_micros("us")).cache()


@pytest.fixture(scope="module")
def tiers(raw):
    fine = r.build(raw, FINE).cache()
    return fine, r.derive(fine, COARSE).cache()


ASKS = (r.Ask("n", "count"), r.Ask("errors", "count", None, ERR), r.Ask("s", "sum", "v"), r.Ask("a", "avg", "v"), r.Ask("lo", "min", "v"), r.Ask("hi", "max", "v"), r.Ask("p", "percentile", "v", p=0.5), r.Ask("u", "distinct", "user"))


def rows(df):
    return sorted((tuple(None if x is None else round(x, 6) if isinstance(x, float) else x for x in t) for t in df.collect()), key=str)


def test_derived_equals_built(raw, tiers):
    direct = r.build(raw, COARSE)
    names = ["project_id", "bucket", "svc", "kind", "n", "errors", "s", "c", "lo", "hi", "es", "ec"]
    assert rows(direct.select(*names)) == rows(tiers[1].select(*names))


@pytest.mark.parametrize("seed", range(8))
def test_routed_equals_raw(raw, tiers, seed):
    rnd = random.Random(seed)
    start, end = sorted(rnd.sample(range(0, 6 * H), 2))
    if seed % 3 == 0:
        start, end = start // H * H, None
    ranges = [(0, 2 * H), (2 * H + 30 * M, 5 * H)] if seed % 2 else [(0, 6 * H)]
    cover = r.Coverage(ranges)
    if seed == 5:
        cover.invalidate(H + 1)
    q = r.AggregateQuery(
        ASKS, start, end, projects=("p",) if seed % 2 else ("p", "q"), by_project=seed == 4, bucket=rnd.choice([None, 60, 300, 3600]), group=rnd.choice([(), ("svc",), ("svc", "kind")]),
        where={"kind": ("x",)} if seed == 6 else {"svc": ("a", None)} if seed == 7 else {}, coalesce={"svc": "none"} if seed == 3 else {},
    )
    if "svc" not in q.group:
        q.coalesce.clear()
    t = [r.Tier(FINE, tiers[0], cover), r.Tier(COARSE, tiers[1], cover)]
    got, routed = r.answer(q, raw, t)
    want, plain = r.answer(q, raw, [])
    assert plain.kind == "raw" and rows(got) == rows(want)
    if end is None or end - start > 3 * H:
        assert routed.kind != "raw"


def test_windows_are_partitioned_exactly():
    rnd = random.Random(3)
    for _ in range(300):
        start, end = sorted(rnd.sample(range(10**10), 2))
        cover = r.Coverage([(a, b) for a, b in zip(*[iter(sorted(rnd.sample(range(10**10), 4)))] * 2)])
        cover.invalidate(rnd.randrange(10**10))
        inside, outside = r.split(start, end, cover.valid(60), 60)
        every = sorted(inside + outside)
        assert every[0][0] == start and every[-1][1] == end and all(a[1] == b[0] for a, b in zip(every, every[1:]))
        assert all(a % (60 * S) == 0 and b % (60 * S) == 0 for a, b in inside)
        assert not any(a < d + H and d < b for a, b in inside for d in cover.dirty)


def test_coarsest_tier_first_and_row_filter(raw, tiers):
    t = [r.Tier(FINE, tiers[0], r.Coverage([(0, 6 * H)])), r.Tier(COARSE, tiers[1], r.Coverage([(0, 6 * H)]))]
    q = lambda **k: r.AggregateQuery(**{"asks": (r.Ask("n", "count"),), "start": 0, "end": 6 * H, "projects": ("p",), **k})
    assert r.route(q(bucket=3600), t).tier.spec is COARSE and r.route(q(bucket=300), t).tier.spec is FINE
    filtered = q(row_filter="STATUS =  'error'".replace("error", "ERROR").lower().replace("'error'", "'ERROR'"), group=("svc",), asks=(r.Ask("n", "count"), r.Ask("s", "sum", "v")))
    got, routed = r.answer(r.AggregateQuery(filtered.asks, 0, 6 * H, ("p",), group=("svc",), row_filter=ERR), raw, t)
    want = raw.where(f"project_id = 'p' and {ERR}").groupBy("svc").agg(F.count("*"), F.sum("v"))
    assert routed.kind == "rollup" and rows(got) == rows(want)


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({"start": None}, r.Decline.UNBOUNDED_TIME), ({"projects": ()}, r.Decline.PROJECT_NOT_PINNED), ({"group": ("user",)}, r.Decline.UNKNOWN_GROUP_BY), ({"where": {"status": ("OK",)}}, r.Decline.UNKNOWN_FILTER),
        ({"bucket": 90}, r.Decline.BUCKET_NOT_MULTIPLE), ({"asks": (r.Ask("m", "max", "user"),)}, r.Decline.MISSING_MEASURE), ({"distinct": True}, r.Decline.DISTINCT), ({"end": 60 * S}, r.Decline.TOO_FEW_BUCKETS),
        ({"start": 7 * H, "end": 9 * H}, r.Decline.NOT_COVERED), ({"row_filter": "kind = 'z'"}, r.Decline.MISSING_MEASURE),
    ],
)
def test_declines(tiers, change, reason):
    q = r.AggregateQuery(**{"asks": (r.Ask("n", "count"),), "start": 0, "end": 6 * H, "projects": ("p",), **change})
    got = r.route(q, [r.Tier(FINE, tiers[0], r.Coverage([(0, 6 * H)]))])
    assert got.tier is None and got.declined == (("fine", reason),)


def test_engine_counts_and_writes_invalidate(spark, raw, tiers):
    e = Engine(spark)
    e.register("metered", raw)
    e.tiers["metered"] = [r.Tier(FINE, tiers[0], r.Coverage([(0, 6 * H)]))]
    q = r.AggregateQuery((r.Ask("n", "count"),), 0, 6 * H, ("p", "q"))
    assert e.aggregate("metered", q).first().n == 3_000 and e.stats["rollup_rollup"] == 1
    e._invalidate("metered", raw.where(F.col("us") < 60 * S).limit(1))
    assert e.explain("metered", q).kind == "hybrid" and e.aggregate("metered", q).first().n == 3_000


def test_refresh_rebuilds_dirty_hours_only(spark, raw, tiers):
    extra = raw.limit(5).withColumn("us", F.lit(2 * H + 5)).withColumn("timestamp", F.timestamp_micros("us"))
    both = raw.unionByName(extra)
    dirty = extra.select("project_id", F.lit(2 * H).alias("hour"))
    names = ["project_id", "bucket", "svc", "kind", "n", "errors", "s"]
    assert rows(r.refresh(tiers[0], both, FINE, dirty).select(*names)) == rows(r.build(both, FINE).select(*names))
    assert rows(r.refresh(tiers[0], raw, FINE, dirty.limit(0)).select(*names)) == rows(tiers[0].select(*names))
    assert r.with_identity(tiers[0], "g1").select("id").distinct().count() == tiers[0].count()


def test_empty(spark, raw):
    assert r.build(raw.limit(0), FINE).count() == 0
    got, _ = r.answer(r.AggregateQuery(ASKS, 0, H, ("p",)), raw.limit(0), [])
    assert got.first().n == 0 and got.first().s is None and got.first().p is None


def test_specs():
    cols = {"svc", "kind", "v", "user", "status"}
    FINE.validate(cols)
    COARSE.validate(cols, {"fine": FINE})
    for bad in (
        RollupSpec("7m", ("svc",), MEASURES, "x"), RollupSpec("1m", ("nope",), MEASURES, "x"), RollupSpec("1m", ("svc", "svc"), MEASURES, "x"), RollupSpec("1m", ("svc",), (), "x"),
        RollupSpec("1m", ("svc",), (Measure("a b", "count"),), "x"), RollupSpec("1m", ("svc",), (Measure("a", "sum"),), "x"), RollupSpec("1m", ("svc",), (Measure("a", "mode", "v"),), "x"), RollupSpec("1h", ("svc",), MEASURES, "x", "coarse"),
    ):
        with pytest.raises(SchemaError):
            bad.validate(cols, {"coarse": COARSE})
