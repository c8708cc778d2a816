import random
import re

import pytest
from pyspark.sql import functions as F

from tidewater.operators import text_index as ti
from tidewater.operators.small_files import compact
from tidewater.sources.store import PartitionStore

WORDS = "Journal compactor INDEX shard gateway archive platform bundle metric server cluster größe".split()
SCHEMA = "id int, text string, other string, p int"


def rows(seed, n, first=0):
    rnd = random.Random(seed)
    return [(first + i, None if rnd.random() < 0.1 else " ".join(rnd.sample(WORDS, 3)) + f" needle{first + i:04d}", "x", i % 3) for i in range(n)] + [(9_000 + first, "", "needle", 0), (9_001 + first, "ab", "y", 1)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    store = PartitionStore(spark, str(tmp_path_factory.mktemp("t")), spark.createDataFrame([], SCHEMA).schema, ["p"])
    made = ti.TextIndex(store, ["text", "other"])
    store.replace(spark.createDataFrame(rows(1, 60), SCHEMA).repartition(4, "id"))
    assert made.update() == 1 and made.update() == 0
    store.replace(spark.createDataFrame(rows(2, 30, 100), SCHEMA).coalesce(1), append=True)  # not indexed yet
    return made


QUERIES = ["needle0007", "NEEDLE0007 shard", "jour* index", "größe", "nothing here", "", "ab", "needle0105"]


@pytest.mark.parametrize("query", QUERIES)
def test_searches_equal_a_scan(index, query):
    low = [w.strip("*?") for w in query.lower().split()]
    want = {r.id for r in index.store.read().collect() if r.text is not None and all(w in r.text.lower() for w in low)}
    assert {r.id for r in index.match("text", query).collect()} == want


@pytest.mark.parametrize("pattern", ["%needle00%", "J%r needle%1", "%größe%", "%_needle%", "", "%\\%%", "Jour%"])
def test_like(index, pattern):
    want = {r.id for r in index.store.read().where(F.col("text").like(pattern)).collect()}
    assert {r.id for r in index.like("text", pattern).collect()} == want
    assert {r.id for r in index.store.read().where(F.col("text").ilike(pattern)).collect()} == {r.id for r in index.like("text", pattern, True).collect()}


@pytest.mark.parametrize("pattern", ["needle00[01]\\d", "^Jour.*shard", "(needle)?0012", "needle(0012|0013)", "shards?", "ga{1,2}teway", "x|y", "needle001+"])
def test_regex(index, pattern):
    want = {r.id for r in index.store.read().collect() if r.text is not None and re.search(pattern, r.text)}
    assert {r.id for r in index.regex("text", pattern).collect()} == want


def test_few_files_are_opened_and_replaced_files_are_not(spark, index):
    assert index.share_read("text", ["needle0007"]) < 0.4 and index.share_read("text", ["ab"]) == 1.0 and index.share_read("text", ["zzz"]) == 0
    compact(index.store, small_bytes=1 << 20)
    assert index.update() == 1
    for q in QUERIES:
        low = [w.strip("*?") for w in q.lower().split()]
        assert index.match("text", q).count() == sum(r.text is not None and all(w in r.text.lower() for w in low) for r in index.store.read().collect())


def test_parts():
    assert ti.like_parts("%ab\\%c_d%") == ["ab%c", "d"] and ti.regex_parts("ab?cd(ef)gh[ij]kl\\.m") == ["a", "cd", "gh", "kl.m"] and ti.regex_parts("a|b") == []
