from datetime import date

import pytest

from tidewater.operators import small_files as sf
from tidewater.sources.store import Conflict, PartitionStore, SchemaConflict

SCHEMA = "action_id long, commit_version long, action_type string, path string, project_id string, date date, size_bytes long, num_records long, stamp timestamp, note string"
D = date(2023, 1, 2)


def act(i, v, kind, name, size=10, project="p", prefix="", path=...):
    full = f"{prefix}project_id={project or 'default'}/date={D}/{name}.parquet" if path is ... else path
    return (i, v, kind, full, project, D, size, None if i % 2 else 1, None, "")


def test_live_small_files(spark):
    escaped = f"project_id%3Dp/date%3D{D}/b.parquet"
    rows = [
        act(1, 1, "add", "a"), act(2, 2, "add", "b", path=escaped), act(3, 9, "remove", "c"), act(4, 3, "add", "c"),
        act(5, 4, "add", "d", prefix="lake://x/t/"), act(6, 5, "remove", "d", prefix="./"), act(7, 6, "add", "d", prefix="/"), act(7, 6, "add", "d"),
        act(8, 1, "add", "large", size=32_768), act(9, 1, "add", "edge", size=32_767), act(10, 1, "add", "lonely", project="q"),
        act(11, 1, "add", "n1", project=None), act(12, 1, "add", "n2", project=None), act(13, 1, "add", "x", path=None), act(14, None, "add", "y"),
        act(15, 7, "remove", "tie"), act(16, 7, "add", "tie"), act(17, 1, "add", "odd", path="elsewhere/file.txt"),
    ]
    got = {r.path.rsplit("/", 1)[1] for r in sf.small_live_files(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"a.parquet", "b.parquet", "d.parquet", "edge.parquet", "n1.parquet", "n2.parquet"}
    plan = {r.project_id: (r.files_before, r.files_after) for r in sf.compaction_plan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert plan == {"p": (4, 1), "default": (2, 1)}


def test_no_actions(spark):
    assert sf.small_live_files(spark.createDataFrame([], SCHEMA)).count() == 0


def stored(spark, root, df, partition_by, files):
    store = PartitionStore(spark, str(root), df.schema, partition_by)
    store.replace(df.repartition(files))
    return store


def contents(store):
    return sorted(map(str, store.read().collect()))


def test_compaction_keeps_every_row(spark, tmp_path):
    data = spark.range(2_000).selectExpr("id", "if(id % 7 = 0, null, repeat('x', cast(id % 50 as int))) text", "array(id, null) many", "id % 3 p", "if(id % 2 = 0, null, 'a/b=c') q")
    store = stored(spark, tmp_path, data, ["p", "q"], 40)
    before, old = contents(store), store.version()
    done = sf.compact(store, small_bytes=1 << 20, sort=["id"])
    assert len(done) == 6 and all(r.files_before > 1 and r.files_after == 1 for r in done)
    assert contents(store) == before and sum(r.rows for r in done) == 2_000
    assert sf.compact(store, small_bytes=1 << 20) == [] and store.version() == old + 1
    assert store.read(version=old).count() == 2_000  # the version before is still whole
    assert sorted(r.operation for r in store.history().collect()) == ["optimize", "write"]
    assert store.vacuum(3_600_000_000) == [] and len(store.vacuum()) == 1 and contents(store) == before
    assert store.actions().where("action = 'add'").count() == 6


def test_large_files_stay(spark, tmp_path):
    store = stored(spark, tmp_path, spark.range(100).selectExpr("id", "'' text", "1 p"), ["p"], 3)
    store.replace(spark.range(1).selectExpr("id", "concat_ws('', transform(sequence(1, 20000), x -> md5(cast(x as string)))) text", "1 p"), append=True)
    big = next(f.generation for f in sf.stored_files(store, store.state()).collect() if f.size_bytes > 50_000)
    done = sf.compact(store, small_bytes=50_000)
    assert [(r.files_before, r.files_after, r.rows) for r in done] == [(3, 1, 100)]
    assert store.read().count() == 101 and any(x.startswith(big) for x in store.manifest()["p=1"])
    gone = store.vacuum()
    assert len(gone) == 1 and store.read().count() == 101
    sf.compact(store, small_bytes=10**9)
    assert store.read().count() == 101 and len(store.manifest()["p=1"]) == 1


def test_failed_verification_replaces_nothing(spark, tmp_path, monkeypatch):
    store = stored(spark, tmp_path, spark.range(100).selectExpr("id", "1 p"), ["p"], 5)
    before, version = contents(store), store.version()
    whole = sf.packed
    monkeypatch.setattr(sf, "packed", lambda *a: whole(*a).limit(50))
    with pytest.raises(sf.VerificationFailed):
        sf.compact(store, small_bytes=1 << 20)
    assert contents(store) == before and store.version() == version


def test_rows_appended_meanwhile_stay_and_a_second_rewrite_is_refused(spark, tmp_path, monkeypatch):
    store = stored(spark, tmp_path, spark.range(100).selectExpr("id", "1 p"), ["p"], 5)
    commit = store.commit

    def late(operation, *rest):
        monkeypatch.setattr(store, "commit", commit)
        store.replace(spark.range(7).selectExpr("id", "1 p"), append=True)
        return commit(operation, *rest)

    monkeypatch.setattr(store, "commit", late)
    sf.compact(store, small_bytes=1 << 20)
    assert store.read().count() == 107

    def first(operation, *rest):
        monkeypatch.setattr(store, "commit", commit)
        sf.compact(store, small_bytes=1 << 20)
        return commit(operation, *rest)

    monkeypatch.setattr(store, "commit", first)
    with pytest.raises(Conflict):
        sf.compact(store, small_bytes=1 << 20)
    assert store.read().count() == 107


def test_splits_are_packed_without_a_shuffle(spark, tmp_path):
    store = stored(spark, tmp_path, spark.range(1_000).selectExpr("id", "1 p"), ["p"], 30)
    df = sf.packed(store, sf.packing_session(spark, 1 << 20), store.paths(store.manifest(), {}), 10_000, 1 << 20, store.schema)
    assert df.rdd.getNumPartitions() == 1 and "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_files_with_more_columns_keep_all_values(spark, tmp_path):
    old = stored(spark, tmp_path, spark.range(50).selectExpr("id", "1 p"), ["p"], 2)
    PartitionStore(spark, str(tmp_path), spark.range(0).selectExpr("id", "'' added", "1 p").schema, ["p"]).replace(spark.range(50).selectExpr("id", "'kept' added", "1 p"), append=True)
    assert [r.rows for r in sf.compact(old, small_bytes=1 << 20)] == [100]  # by a writer that does not know the new column
    wide = PartitionStore(spark, str(tmp_path), spark.range(0).selectExpr("id", "'' added", "1 p").schema, ["p"])
    assert wide.read().where("added = 'kept'").count() == 50 and wide.read().count() == 100


def test_types_that_conflict_are_refused(spark, tmp_path):
    stored(spark, tmp_path, spark.range(50).selectExpr("id", "1 p"), ["p"], 2)
    other = spark.range(5).selectExpr("cast(id as string) id", "1 p")
    with pytest.raises(SchemaConflict):
        PartitionStore(spark, str(tmp_path), other.schema, ["p"]).replace(other, append=True)


@pytest.mark.parametrize("column", ["map('k', {0})", "array(map({0}, 'v'))", "parse_json('{{\"a\":{0}}}')", "named_struct('v', parse_json('{0}'), 'm', map(1, {0}))"])
def test_digest_sees_maps_and_variants(spark, column):
    one, other, again = (sf._digest(spark.range(3).selectExpr("id", column.format(x) + " x")) for x in (1, 2, 1))
    assert one == again != other
