import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tidewater.dialect import lex, nest
from tidewater.engine import Engine
from tidewater.operators import rollup as r
from tidewater.operators import routing
from tidewater.operators.mor import Clock
from tidewater.operators.tiers import TierStore, _joined
from tidewater.schema import Field, Measure, RollupSpec, TableSchema

H, S = 3_600_000_000, 1_000_000
FIRST = 1_704_067_200_000_000  # 2024-01-01
ERR = "status = 'ERROR' OR coalesce(code, 0) >= 500"
MEASURES = (
    Measure("n", "count"), Measure("errors", "count", None, ERR), Measure("s", "sum", "v"), Measure("c", "count", "v"), Measure("lo", "min", "v"), Measure("hi", "max", "v"),
    Measure("d", "tdigest", "v"), Measure("u", "hll", "user"), Measure("es", "sum", "v", ERR),
)
SPECS = (RollupSpec("1m", ("svc", "kind"), MEASURES, "fine"), RollupSpec("1h", ("svc", "kind"), MEASURES, "coarse", "fine"))
SCHEMA = "project_id string, us long, svc string, kind string, status string, code int, v long, user int"


def made(spark, seed, n, lo=0, hi=60 * H):
    rnd = random.Random(seed)
    rows = [(rnd.choice("pq"), FIRST + rnd.randrange(lo, hi), rnd.choice(["a", "b", None]), rnd.choice(["x", "y"]), rnd.choice(["OK", "ERROR"]), rnd.choice([None, 200, 503]), rnd.choice([None, *range(50)]), rnd.randrange(30)) for _ in range(n)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("timestamp", F.timestamp_micros("us")).withColumn("date", F.to_date("timestamp"))


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("raw") / "t")
    made(spark, 1, 3_000).write.partitionBy("date").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def engines(spark, raw, tmp_path_factory):
    routed, plain = Engine(spark), Engine(spark)
    routed.register("metered", raw)
    plain.register("metered", raw)
    routed.rollups("metered", str(tmp_path_factory.mktemp("tiers")), SPECS)
    return routed, plain


W = "timestamp >= '2024-01-01T00:30:10Z' AND timestamp < '2024-01-02T20:00:00Z'"
ROUTED = [
    f"SELECT time_bucket('1 hour', timestamp) AS t, count(*) AS n FROM metered WHERE project_id = 'p' AND {W} GROUP BY 1",
    f"SELECT extract(epoch from time_bucket('5 minutes', timestamp))::bigint AS t, coalesce(svc, 'none') AS svc, count(*)::float AS n FROM metered WHERE project_id IN ('p', 'q') AND {W} GROUP BY time_bucket('5 minutes', timestamp), coalesce(svc, 'none')",
    f"SELECT svc, round(count(*) FILTER (WHERE {ERR})::float * 100.0 / count(*), 3) AS rate, avg(v) AS a, sum(v) AS s, min(v) AS lo, max(v) AS hi FROM public.metered WHERE project_id = 'q' AND {W} GROUP BY svc",
    f"SELECT project_id, kind, count(*) AS n FROM metered AS m WHERE {W} GROUP BY 1, 2 HAVING count(*) > 10 ORDER BY n DESC, project_id, kind LIMIT 3",
    f"SELECT count(*) AS n, sum(m.v) AS s FROM metered m WHERE m.project_id = 'p' AND m.kind = 'x' AND m.svc IS NULL AND {W}",
    f"SELECT svc, count(*) AS n, sum(v) AS s FROM metered WHERE project_id = 'p' AND (status = 'ERROR' OR COALESCE(code, 0) >= 500) AND {W} GROUP BY svc",
    f"SELECT date_trunc('day', timestamp) AS day, approx_percentile(0.5, percentile_agg(v)) AS p, hll_count(hll_agg(user)) AS u FROM metered WHERE project_id = 'q' AND {W} GROUP BY 1",
    "SELECT kind, count(*) / 7 AS n FROM metered WHERE project_id = 'p' AND timestamp BETWEEN '2024-01-01' AND TIMESTAMP '2024-01-02 05:00:00' + INTERVAL '1 hour' GROUP BY kind",
    "SELECT count(*) AS n FROM metered WHERE project_id = 'p' AND timestamp > '2024-01-01T03:00:00Z'",
]


def rows(df):
    return sorted((tuple(None if x is None else round(x, 6) if isinstance(x, float) else x for x in t) for t in df.collect()), key=str)


@pytest.mark.parametrize("text", ROUTED)
def test_plain_select_is_answered_from_a_tier(engines, text):
    routed, plain = engines
    before = routed.stats["rollup_rollup"] + routed.stats["rollup_hybrid"]
    got, want = routed.sql(text), plain.sql(text)
    assert routed.stats["rollup_rollup"] + routed.stats["rollup_hybrid"] == before + 1
    assert [f.name for f in got.schema.fields] == [f.name for f in want.schema.fields] and [f.dataType for f in got.schema.fields] == [f.dataType for f in want.schema.fields]
    assert rows(got) == rows(want)


LEFT_ALONE = [
    f"SELECT user, count(*) AS n FROM metered WHERE project_id = 'p' AND {W} GROUP BY user", f"SELECT count(DISTINCT svc) AS n FROM metered WHERE project_id = 'p' AND {W}",
    f"SELECT count(*) AS n FROM metered WHERE {W}", "SELECT count(*) AS n FROM metered WHERE project_id = 'p'", f"SELECT count(*) AS n FROM metered WHERE project_id = 'p' AND v > 3 AND {W}",
    f"SELECT count(*) AS n FROM metered WHERE (project_id = 'p' OR svc = 'a') AND {W}", f"SELECT svc FROM metered WHERE project_id = 'p' AND {W} LIMIT 1", f"SELECT max(us) AS m FROM metered WHERE project_id = 'p' AND {W}",
    f"SELECT time_bucket('90 seconds', timestamp) AS t, count(*) AS n FROM metered WHERE project_id = 'p' AND {W} GROUP BY 1", f"WITH x AS (SELECT 1 AS k) SELECT count(*) AS n FROM metered WHERE project_id = 'p' AND {W}",
    f"SELECT count(*) AS n FROM metered WHERE project_id <> 'p' AND {W}", f"SELECT count(*) AS n FROM metered JOIN (SELECT 'a' AS svc) AS s USING (svc) WHERE project_id = 'p' AND {W}",
    f"SELECT count(*) FILTER (WHERE kind = 'x') AS n FROM metered WHERE project_id = 'p' AND {W}", f"SELECT svc, count(*) OVER () AS n FROM metered WHERE project_id = 'p' AND {W} GROUP BY svc",
]


@pytest.mark.parametrize("text", LEFT_ALONE)
def test_other_statements_take_the_raw_path(engines, text):
    routed, plain = engines
    before = routed.stats["rollup_rollup"] + routed.stats["rollup_hybrid"]
    assert rows(routed.sql(text)) == rows(plain.sql(text))
    assert routed.stats["rollup_rollup"] + routed.stats["rollup_hybrid"] == before


def test_raw_leg_and_tier_are_pruned_by_date(engines):
    routed, _ = engines
    df = routed.sql("SELECT count(*) AS n FROM metered WHERE project_id = 'p' AND timestamp >= '2024-01-01T10:00:00Z' AND timestamp < '2024-01-02T00:00:20Z'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x]
    assert len(scans) == 2 and all("PartitionFilters: [" in x and "date" in x.split("PartitionFilters: [")[1].split("]")[0] for x in scans)
    assert "PushedFilters: [IsNotNull(timestamp)" in plan or "GreaterThanOrEqual(timestamp" in plan


def test_tiers_survive_a_restart_and_follow_writes(spark, tmp_path):
    fields = (Field("project_id", "Utf8"), Field("date", "Date32", False), Field("timestamp", 'Timestamp(Microsecond, Some("UTC"))', False), Field("id", "Utf8", False), Field("v", "Int64", mutable=True), Field("updated_at", 'Timestamp(Microsecond, Some("UTC"))'), Field("deleted", "Boolean"))
    schema = TableSchema("calls", fields, dedup_keys=("timestamp", "id"), version="updated_at", tombstone="deleted", version_append=True).validate()
    specs = (RollupSpec("1m", (), (Measure("n", "count"), Measure("s", "sum", "v")), "calls_1m"), RollupSpec("1h", (), (Measure("n", "count"), Measure("s", "sum", "v")), "calls_1h", "calls_1m"))
    e = Engine(spark, clock=Clock())
    e.create("calls", str(tmp_path / "t"), schema)
    put = lambda e, day, hour, n, v: e.execute(f"INSERT INTO calls (project_id, timestamp, id, v) SELECT 'p', TIMESTAMP '2024-01-0{day}T{hour:02d}:00:00Z', concat('{day}{hour}', x.i), {v} FROM unnest(ARRAY[{','.join(map(str, range(n)))}]) AS x(i)")
    put(e, 1, 3, 4, 1)
    put(e, 1, 9, 2, 10)
    put(e, 2, 5, 3, 100)
    e.rollups("calls", str(tmp_path / "r"), specs)
    ask = "SELECT count(*) AS n, sum(v) AS s FROM calls WHERE project_id = 'p' AND timestamp >= '2024-01-01T00:00:00Z' AND timestamp < '2024-01-03T00:00:00Z'"
    assert tuple(e.sql(ask).first()) == (9, 324) and e.stats["rollup_hybrid"] + e.stats["rollup_rollup"] == 1
    put(e, 1, 9, 3, 10)  # repeats two rows and adds one
    assert e.stored_tiers["calls"].coverage().dirty == {FIRST + 9 * H} and tuple(e.sql(ask).first()) == (10, 334)
    again = Engine(spark, clock=Clock())
    again.create("calls", str(tmp_path / "t"), schema)
    again.rollups("calls", str(tmp_path / "r"), specs)
    built = again.stored_tiers["calls"].stores["calls_1m"].version()
    assert built == 1 and again.stored_tiers["calls"].coverage().dirty == {FIRST + 9 * H} and tuple(again.sql(ask).first()) == (10, 334)
    assert again.refresh_rollups("calls") == 1 and again.stored_tiers["calls"].coverage().dirty == set() and again.refresh_rollups("calls") == 0
    assert tuple(again.sql(ask).first()) == (10, 334) and [tuple(t.data.agg(F.sum("n"), F.sum("s")).first()) for t in again.tiers["calls"]] == [(10, 334)] * 2
    again.execute("UPDATE calls SET v = 7 WHERE project_id = 'p' AND id = '130'")
    again.execute("DELETE FROM calls WHERE project_id = 'p' AND id = '250'")
    assert tuple(again.sql(ask).first()) == (9, 240)
    other = TierStore(spark, str(tmp_path / "r"), (RollupSpec("1m", (), (Measure("n", "count"),), "calls_1m"),), again.spark.table("calls").schema)
    assert other.coverage().ranges == []  # another declaration does not trust what this one left


def test_random_windows_equal_raw(engines):
    routed, plain = engines
    rnd = random.Random(4)
    at = lambda us: datetime.fromtimestamp((FIRST + us) / 1e6, UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    for _ in range(4):
        a, b = sorted(rnd.sample(range(-5 * H, 65 * H), 2))
        text = f"SELECT svc, time_bucket('{rnd.choice(['1 minute', '1 hour', '1 day'])}', timestamp) AS t, count(*) AS n, sum(v) AS s FROM metered WHERE project_id = 'p' AND timestamp >= '{at(a)}' AND timestamp <= '{at(b)}' GROUP BY 1, 2"
        assert rows(routed.sql(text)) == rows(plain.sql(text))


def test_empty_table(spark, raw, tmp_path):
    e = Engine(spark)
    e.register("nothing", raw.limit(0))
    e.rollups("nothing", str(tmp_path / "r"), SPECS)
    assert e.sql(f"SELECT count(*) AS n FROM nothing WHERE project_id = 'p' AND {W}").first().n == 0
    store = TierStore(spark, str(tmp_path / "r"), SPECS, raw.schema)  # opened from a log without a partition
    assert store.stores["fine"].partition_by == ["date"]
    store.build(raw)
    assert [t.data.agg(F.sum("n")).first()[0] for t in store.tiers()] == [3_000, 3_000]


def test_spellings():
    one = lambda text: routing.canon(nest(lex(text)))
    assert one("(a.Status = 'ERROR' OR COALESCE(code,0)>=500)") == one("status='ERROR' or coalesce( x.code , 0 ) >= 500")
    assert one("a = 'X'") != one("a = 'x'")
    assert _joined([(0, 5), (5, 9), (20, 30), (25, 27)]) == [[0, 9], [20, 30]]
    assert routing.target(nest(lex("SELECT 1 FROM public.t WHERE a = 1"))) == "t" and routing.target(nest(lex("SELECT 1 FROM (SELECT 2) AS x"))) is None
