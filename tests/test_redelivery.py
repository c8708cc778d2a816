import random
from datetime import UTC, datetime, timedelta

import pytest

from tidewater.operators.redelivery import MessageStore, deliver_once
from tidewater.sources.store import Conflict, PartitionStore

SCHEMA = "id string, timestamp timestamp, project_id string, updated_at timestamp, body string, slot int"
T = datetime(2023, 1, 2, 23, 59, 59, 999_000)
U = "6e1be85e-580e-45f8-9e8a-3bfd6202164"


def spellings(k):
    u = f"{U}{k:x}"
    return [u, u.upper(), f"{{{u}}}", f"urn:uuid:{u}", u.replace("-", ""), f" {u} "]


def make(seed, n):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        k = rnd.randrange(16)
        stamp = T + timedelta(seconds=i) if rnd.random() > 0.1 else None
        out.append((rnd.choice(spellings(k)), T + timedelta(days=k % 3, microseconds=rnd.randrange(900)), rnd.choice(["p", None, "q"]), stamp, f"b{i}", i))
    return [*out, (None, T, "p", T, "no id", 0), (" ", T, "p", T, "blank", 0), (f"{U}0", None, "p", T, "no time", 0)]


def brute(rows):
    best, n = {}, {}
    for id_, ts, _, stamp, body, _ in rows:
        if id_ is None or not id_.strip() or ts is None:
            continue
        u = id_.strip().lower().removeprefix("urn:uuid:").strip("{}").replace("-", "")
        k = (u, ts.replace(microsecond=ts.microsecond // 1000 * 1000))
        n[k] = n.get(k, 0) + 1
        if stamp is not None and (k not in best or stamp > best[k][0]):
            best[k] = (stamp, body)
    return {k: (n[k], best[k][1] if k in best else None) for k in n}


def as_dict(df):
    out = {}
    for r in df.collect():
        k = (r.msg_id.replace("-", ""), datetime.fromtimestamp(r.ts_ms / 1000, UTC).replace(tzinfo=None))
        assert k not in out
        out[k] = (r.deliveries, r.body)
    return out


def same(got, want):
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(v[1] is None or got[k][1] == v[1] for k, v in want.items())


def test_once(spark):
    rows = make(1, 200)
    same(as_dict(deliver_once(spark.createDataFrame(rows, SCHEMA))), brute(rows))


def test_once_with_too_many_keys_to_broadcast(spark):
    rows = make(9, 150)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        same(as_dict(deliver_once(spark.createDataFrame(rows, SCHEMA))), brute(rows))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_store_batch_by_batch(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    store = MessageStore(spark, str(tmp_path), df.schema)
    rows = []
    for seed in range(4):
        batch = make(seed, 30)
        rows += batch
        store.apply(spark.createDataFrame(batch, SCHEMA))
        same(as_dict(store.read()), brute(rows))
    assert store.index().count() == store.read().count()
    store.apply(df)
    same(as_dict(store.read()), brute(rows))
    store.store.vacuum()
    same(as_dict(store.read()), brute(rows))


def test_only_affected_partitions_are_overwritten(spark, tmp_path):
    store = MessageStore(spark, str(tmp_path), spark.createDataFrame([], SCHEMA).schema)
    row = lambda k, day, p: (f"{U}{k}", T + timedelta(days=day), p, T, "x", 0)
    store.apply(spark.createDataFrame([row(1, 0, "p"), row(2, 1, "p"), row(3, 1, "q")], SCHEMA))
    before = store.store.manifest()
    store.apply(spark.createDataFrame([row(1, 0, "other")], SCHEMA))
    after = store.store.manifest()
    kept = {k for k in before if after.get(k) == before[k]}
    assert {k for k in before if k not in kept} == {k for k in before if k.startswith("msg_date=2023-01-02")}
    assert store.read().where("deliveries = 2").count() == 1 and store.read().count() == 3


def test_messages_and_index_are_one_commit(spark, tmp_path, monkeypatch):
    store = MessageStore(spark, str(tmp_path), spark.createDataFrame([], SCHEMA).schema)
    store.apply(spark.createDataFrame(make(1, 20), SCHEMA))
    before, version = as_dict(store.read()), store.store.version()
    monkeypatch.setattr(store.store, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        store.apply(spark.createDataFrame(make(2, 20), SCHEMA))
    monkeypatch.undo()
    assert as_dict(store.read()) == before and store.store.version() == version and store.index().count() == len(before)
    store.apply(spark.createDataFrame(make(2, 20), SCHEMA))
    same(as_dict(store.read()), brute(make(1, 20) + make(2, 20)))


def test_a_version_is_taken_once(spark, tmp_path):
    store = PartitionStore(spark, str(tmp_path), spark.range(0).selectExpr("id", "id p").schema, ["p"])
    store.replace(spark.range(3).selectExpr("id", "id p"))
    assert not store._put_json({}, "_log", f"{1:012d}.entry.json")
    with pytest.raises(Conflict):
        store.commit("write", {"p=0": (["gone"], [])})
    assert store.read().count() == 3 and store.read(version=0).count() == 0


def test_many_versions_are_read_from_the_last_state(spark, tmp_path):
    store = PartitionStore(spark, str(tmp_path), spark.range(0).selectExpr("id", "id p").schema, ["p"])
    for i in range(18):
        store.replace(spark.range(1).selectExpr(f"{i}L id", f"{i % 2}L p"), append=True)
    assert store.version() == 18 and store.read().count() == 18 and store.read({"p=0"}).count() == 9
    assert store.read(version=3).count() == 3
    store.replace(spark.range(1).selectExpr("99L id", "0L p"))
    assert store.read().count() == 10 and len(store.vacuum()) == 9 and store.read().count() == 10


def test_empty(spark):
    assert deliver_once(spark.createDataFrame([], SCHEMA)).count() == 0
