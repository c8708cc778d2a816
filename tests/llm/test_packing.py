import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import packing as p


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=30))
def test_patterns_place_everything_once(histogram):
    got = Counter()
    for pattern, packs in p.patterns(histogram, 64):
        assert packs > 0 and sum(n * times for n, times in pattern) <= 64
        for n, times in pattern:
            got[n] += times * packs
    assert got == Counter(histogram)


def test_little_room_is_left_over():
    rnd = random.Random(1)
    sizes = Counter(min(2_048, max(1, int(rnd.lognormvariate(5, 1)))) for _ in range(50_000))
    packs = sum(n for _, n in p.patterns(sizes))
    least = -(-sum(k * n for k, n in sizes.items()) // 2_048)
    assert packs <= least * 1.01 + 1
    assert len(p.patterns({k: v * 1_000_000 for k, v in sizes.items()})) < 20_000  # patterns grow with lengths, not items


@pytest.mark.parametrize("seed", range(3))
def test_items(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice([None, 0, 1, 7, 7, 7, 7, rnd.randrange(1, 100), 100, 101, 250, 1_000]), "x", 1) for i in range(400)] + [(5, 7, "again", 1), (None, 3, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, n int, container string, part int").repartition(4)
    got = p.pack(df, "doc_id", "n", capacity=100).collect()
    whole = Counter()
    fill = defaultdict(list)
    for r in got:
        whole[r.doc_id] += r.n_tokens
        if r.n_tokens == 0:
            assert r.container is None
        else:
            fill[r.container].append((r.start, r.n_tokens))
    want = Counter()
    for i, n, *_ in rows:
        want[i] += n or 0
    assert whole == want and {r.doc_id for r in got} == {r[0] for r in rows}
    for parts in fill.values():
        end = 0
        for start, n in sorted(parts):
            assert start == end
            end += n
        assert end <= 100
    pieces = Counter(r.doc_id for r in got)
    for i, n, *_ in rows[:400]:
        if i != 5:
            assert pieces[i] == max(1, -(-(n or 0) // 100))
    assert sorted(fill) == list(range(len(fill)))
    total = sum(n or 0 for _, n, *_ in rows)
    assert len(fill) <= -(-total // 100) * 1.02 + 1


def test_hot_length_and_empty(spark):
    df = spark.range(30_000).selectExpr("id k", "if(id % 3 = 0, 60, cast(id % 40 + 1 as int)) n")
    got = p.pack(df, "k", "n", capacity=100)
    sums = got.groupBy("container").sum("n_tokens").collect()
    assert max(r[1] for r in sums) <= 100 and got.count() == 30_000
    assert p.pack(df.where("false"), "k", "n").count() == 0
