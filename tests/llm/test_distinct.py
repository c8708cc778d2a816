import numpy as np
from pyspark.sql import functions as F

from tidewater.llm import distinct as d

KEYS = {"project_id": "string", "date": "date"}


def hashes(n, seed):
    return np.unique(np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64))


def empty():
    return np.full(d.REGISTERS, np.inf)


def test_each_identifier_gives_every_register_a_value():
    h = hashes(50, 1)
    with np.errstate(over="ignore"):
        places = d._registers_of(h, np.arange(d.REGISTERS))
    assert all(len(set(p)) == d.REGISTERS for p in places)
    one = d.fill(empty(), h[:1])
    assert np.isfinite(one).all() and abs(one.mean() - 1) < 0.1 and abs(one.std() - 1) < 0.1
    assert abs(np.corrcoef(one, d.fill(empty(), h[1:2]))[0, 1]) < 0.06 and abs(np.corrcoef(one[:-1], one[1:])[0, 1]) < 0.06


def test_merging_in_any_way_gives_the_same_registers():
    h = hashes(30_000, 2)
    whole = d.fill(empty(), h)
    cuts = [h[:100], h[50:5_000], h[4_000:4_100], h[4_500:], h[:0], h[:1]]
    assert {x[:1] for x in map(d.state_of, cuts)} == {b"s", b"d"}
    for order in (cuts, cuts[::-1]):
        assert (d.registers_of(d.join([d.state_of(x) for x in order])) == whole).all()
        state = d.state_of(order[0])
        for x in order[1:]:
            state = d.join([state, d.state_of(x)])
        assert (d.registers_of(state) == whole).all()
    assert (d.fill(whole.copy(), h[::-1]) == whole).all()


def test_unbiased_and_within_the_interval_at_every_size():
    sizes, inside, errors = [1, 2, 7, 60, 700, 3_000, 20_000, 150_000], 0, []
    for seed in range(160):
        h = hashes(sizes[seed % len(sizes)], 100 + seed)
        est, lo, hi = d.estimate(d.registers_of(d.state_of(h)))
        errors.append(est / len(h) - 1)
        inside += lo <= len(h) <= hi
    assert abs(np.mean(errors)) < 3 * d.RELATIVE_ERROR / len(errors) ** 0.5
    assert 0.85 < np.std(errors) / d.RELATIVE_ERROR < 1.2 and inside >= 144
    assert d.estimate(empty()) == (0.0, 0.0, 0.0)


def test_groups_and_cube(spark):
    rnd = np.random.default_rng(3)
    rows = [(p, None, f"t{rnd.integers(0, 8_000)}", "clash", 1) for p in ("a", "b", None) for _ in range(9_000)] + [("e", None, None, "", 0), ("f", None, "", "", 0)]
    df = spark.createDataFrame(rows, "project_id string, date date, id string, part string, h int").repartition(5)
    daily = d.merge(d.partials(df, KEYS, F.col("id")), KEYS)
    got = {(r.level, r.project_id): r for r in d.counts(d.cube(daily, KEYS), {"level": "string", **KEYS}).collect()}
    assert len(got) == 4 + 4 + 1 + 1 and ("project_id+date", "e") not in got
    for p in ("a", "b", None, "f"):
        n = len({r[2] for r in rows if r[0] == p and r[2] is not None})
        assert abs(got["project_id+date", p].n_distinct / n - 1) < 4 * d.RELATIVE_ERROR
    n = len({r[2] for r in rows if r[2] is not None})
    assert abs(got["all", None].n_distinct / n - 1) < 4 * d.RELATIVE_ERROR
    assert got["all", None].low < got["all", None].n_distinct < got["all", None].high


def test_empty(spark):
    df = spark.createDataFrame([], "project_id string, date date, id string")
    assert d.counts(d.cube(d.merge(d.partials(df, KEYS, F.col("id")), KEYS), KEYS), {"level": "string", **KEYS}).count() == 0
