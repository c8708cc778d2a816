import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import quantiles as q

KEYS = {"service": "string", "date": "date"}


def close(got, values, p, rank=q.RANK_ERROR):
    """Within the rank error, and within the width of a code of some value there."""
    v = np.sort(np.asarray(values, dtype=float))
    slack = abs(got) * 2.0**-q.MANTISSA
    lo, hi = np.searchsorted(v, got - slack, "left"), np.searchsorted(v, got + slack, "right")
    target = max(1, int(np.ceil(p * len(v))))
    return lo + 1 - rank * len(v) <= target <= hi + rank * len(v)


def state(values, weight=1):
    codes, weights = q._net(q.encode(values), np.full(len(values), weight, dtype=np.int64))
    return q.coded(codes, weights)


def test_codes_keep_order_and_are_close():
    rnd = np.random.default_rng(1)
    edge = [0.0, 1.0, -1.0, 0.25, 0.1, -0.1, 1e-300, 1e-320, 1e308, -1e308, 2.0**53, 0.5, 0.49, 99.99]
    values = np.sort(np.concatenate((edge, rnd.uniform(-1, 1, 300), np.exp(rnd.uniform(-600, 600, 300)), -np.exp(rnd.uniform(-600, 600, 300)))))
    codes = q.encode(values)
    assert (np.diff(codes) >= 0).all() and codes[0] >= 0 and codes[-1] < 1 << q.CODE_BITS
    assert (np.abs(q.decode(codes) - values) <= np.abs(values) * 2.0**-q.MANTISSA + 1e-300).all()
    assert q.encode(np.array([-0.0]))[0] == q.encode(np.array([0.0]))[0] and q.decode(q.encode(np.array([0.0])))[0] == 0


def made(kind, n=200_000):
    rnd = np.random.default_rng(3)
    return {
        "lognormal": lambda: np.exp(rnd.normal(15, 3, n)), "uniform": lambda: rnd.uniform(-1e9, 1e9, n), "fractions": lambda: rnd.uniform(0, 1, n), "ties": lambda: rnd.choice([5.0, 77.0, 1e6], n),
        "two": lambda: np.concatenate((np.full(n // 2, 7.0), rnd.uniform(0, 1e12, n // 2))), "even": lambda: rnd.integers(1, 40, n) * 2.5, "pareto": lambda: rnd.pareto(0.7, n), "close": lambda: 1 + rnd.uniform(0, 1, n),
    }[kind]()


@pytest.mark.parametrize("kind", ["lognormal", "uniform", "fractions", "ties", "two", "even", "pareto", "close"])
def test_rank_error(kind):
    v = made(kind)
    points = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 0.999, 1.0]
    codes, weights = q._net(q.encode(v), np.ones(len(v), dtype=np.int64))
    whole = q.Counters().add(codes, weights)
    for p, got in zip(points, whole.quantiles(points)):
        assert close(got, v, p)
    merged = q.add_states([state(x) for x in np.array_split(v, 7)])
    assert q.quantiles_of([merged], points) == ([len(v)], [whole.quantiles(points)])


def test_codes_that_were_not_put_into_counters_give_the_same():
    """Whether a state is shipped as codes or as counters changes nothing, at any size."""
    rnd = np.random.default_rng(4)
    points = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]
    for n in (1, 2, 5, 50, 3_000, q.SHIPPED_CODES):
        v = np.exp(rnd.normal(3, 4, n))
        codes, weights = q._net(q.encode(v), np.ones(n, dtype=np.int64))
        few = state(v)
        assert few[:1] == b"c" and q.Counters().add(codes, weights).to_bytes()[:1] == b"d"
        assert q.quantiles_of([few], points) == q.quantiles_of([q.Counters().add(codes, weights).to_bytes()], points)
    several = [state(np.exp(rnd.normal(3, 4, n))) for n in (1, 7, 0, 90)]
    assert q.quantiles_of(several, points) == tuple(map(list, zip(*[(a[0], b[0]) for a, b in (q.quantiles_of([x], points) for x in several)])))


def test_deletions_undo_insertions():
    rnd = np.random.default_rng(5)
    v = np.exp(rnd.normal(10, 2, 50_000))
    left = q.add_states([state(v), state(v[:20_000], -1)])
    assert q.quantiles_of([left], [0.5, 0.9]) == q.quantiles_of([state(v[20_000:])], [0.5, 0.9])
    assert q.quantiles_of([q.add_states([state(v[:9]), state(v[:9], -1)])], [0.5]) == ([0], [[None]])


def test_groups_nulls_merges_and_clashing_names(spark):
    rnd = np.random.default_rng(7)
    rows = [(s, None, float(v), 1, "x") for s in ("a", None) for v in np.exp(rnd.normal(1, 2, 3_000))] + [("b", None, None, 1, "y"), ("c", None, 0.75, 1, ""), ("", None, 2.0, 1, "")]
    df = spark.createDataFrame(rows, "service string, date date, v double, part int, weight string").repartition(5)
    sketched = q.sketches(df, KEYS, F.col("v"))
    got = {r.service: r for r in q.percentiles(sketched, KEYS, {"p50": 0.5, "p99": 0.99}).collect()}
    assert set(got) == {"a", None, "c", ""} and abs(got["c"].p50 - 0.75) < 0.001 and got["a"].n == 3_000
    for s in ("a", None):
        v = [r[2] for r in rows if r[0] == s]
        assert close(got[s].p50, v, 0.5) and close(got[s].p99, v, 0.99)
    total = q.percentiles(q.merge(sketched, {"date": "date"}), {"date": "date"}, {"p50": 0.5}).collect()
    every = [r[2] for r in rows if r[2] is not None]
    assert len(total) == 1 and total[0].n == len(every) and close(total[0].p50, every, 0.5)


def test_weights_and_empty(spark):
    df = spark.createDataFrame([("a", None, v, w) for v, w in ((1, 1), (2, 1), (3, 1), (2, -1), (9, None))], "service string, date date, v long, w int")
    got = q.percentiles(q.sketches(df, KEYS, F.col("v"), F.col("w")), KEYS, {"p50": 0.5, "p100": 1.0}).collect()
    assert [(r.n, round(r.p50, 2), round(r.p100, 2)) for r in got] == [(2, 1.0, 3.0)]
    none = q.sketches(df.where("false"), KEYS, F.col("v"))
    assert q.percentiles(q.merge(none, KEYS), KEYS, {"p50": 0.5}).count() == 0
    assert q.quantiles_of([b"c"], [0.5]) == ([0], [[None]])


def test_doubles_without_a_value_are_ignored(spark):
    df = spark.createDataFrame([("a", None, x) for x in (1.5, float("nan"), float("inf"), -float("inf"), 1e300, None, -3.5)], "service string, date date, v double")
    got = q.percentiles(q.sketches(df, KEYS, F.col("v")), KEYS, {"p0": 0.0, "p50": 0.5, "p100": 1.0}).collect()
    assert [(r.n, round(r.p0, 2), round(r.p50, 2)) for r in got] == [(3, -3.5, 1.5)] and abs(got[0].p100 / 1e300 - 1) < 0.001


def test_a_hot_group_sends_one_state_per_task(spark):
    df = spark.range(100_000, numPartitions=4).selectExpr("'hot' service", "cast(null as date) date", "id % 30000 v")
    plan = q.sketches(df, KEYS, F.col("v"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.rindex("Exchange") < text.rindex("MapInArrow")
    got = q.percentiles(plan, KEYS, {"p50": 0.5}).first()
    assert got.n == 100_000 and close(got.p50, [i % 30_000 for i in range(100_000)], 0.5)
