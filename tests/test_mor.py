from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidewater.engine import Engine
from tidewater.operators import mor, small_files
from tidewater.operators.mor import Clock, DmlError, VersionedTable, admitted, flush_dedup
from tidewater.operators.update_queue import Update, UpdateQueue
from tidewater.schema import Field, TableSchema, change_feed_schema

T = datetime(2023, 1, 5, 10)


@pytest.fixture
def table(spark, tmp_path):
    clock = Clock()
    clock.set(1_700_000_000_000_000)
    return VersionedTable(spark, str(tmp_path / "t"), change_feed_schema(), clock)


def put(spark, table, *rows):
    return table.insert(spark.createDataFrame([(i, T, n, p) for i, n, p in rows], "id string, timestamp timestamp, name string, project_id string"))


def names(table):
    return sorted((r.project_id, r.id, r.name) for r in table.read().collect())


def test_insert_update_delete_resurrect(spark, table):
    assert table.read().count() == 0
    assert put(spark, table, ("a", "x", "p"), ("b", None, "p"), ("a", "q", None)) == 3
    assert names(table) == [("default", "a", "q"), ("p", "a", "x"), ("p", "b", None)]
    assert table.read().first().date == date(2023, 1, 5)
    assert table.update("p", {"name": F.concat(F.coalesce("name", F.lit("?")), F.lit("!"))}) == 2
    assert table.update("p", {"name": F.lit("no")}, F.col("id") == "zz") == 0
    assert names(table) == [("default", "a", "q"), ("p", "a", "x!"), ("p", "b", "?!")]
    assert table.delete("p", F.col("name") == "x!") == 1
    assert names(table) == [("default", "a", "q"), ("p", "b", "?!")]
    put(spark, table, ("a", "again", "p"))
    assert ("p", "a", "again") in names(table)
    assert table.versions().count() == 7


def test_refusals(spark, table):
    with pytest.raises(DmlError):
        table.update("p", {"id": F.lit("x")})
    with pytest.raises(DmlError):
        table.delete(None)


def test_update_from_applies_repeated_keys_in_order(spark, table):
    put(spark, table, ("a", "1", "p"), ("b", "2", "p"), ("a", "other", "q"))
    source = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 3), ("c", "w", 4), (None, "n", 5)], "key string, v string, seq int")
    assert table.update_from("p", source, {"id": "key"}, {"name": "concat(t.name, s.v)"}, order="seq") == 3
    assert names(table) == [("p", "a", "1xy"), ("p", "b", "2z"), ("q", "a", "other")]
    assert table.update_from("p", source, {"id": "key"}, {"name": "s.v"}, where="s.seq = 3 AND t.name = '2z'") == 1
    assert table.update_from("p", source.where("false"), {"id": "key"}, {"name": "s.v"}) == 0


def test_admission_and_stamps(spark, table):
    clock = Clock()
    clock.set(5)
    assert [clock.stamp() for _ in range(3)] == [5, 6, 7]
    df = spark.createDataFrame([(datetime(1999, 12, 31), 1), (datetime(2000, 1, 1), 2), (None, 3), (datetime(2023, 11, 16, 22, 13), 4), (datetime(2023, 11, 16, 22, 14), 5)], "timestamp timestamp, k int")
    assert {r.k for r in admitted(df, "timestamp", 1_700_000_000_000_000).collect()} == {2, 3, 4}


def test_compaction_keeps_the_state_and_the_tombstones(spark, table, tmp_path):
    put(spark, table, ("a", "x", "p"), ("b", "y", "p"))
    put(spark, table, ("a", "x2", "p"))
    table.delete("p", F.col("id") == "b")
    assert table.duplicates().agg(F.sum("surplus")).first()[0] == 2
    small = table.compacted(str(tmp_path / "c"))
    assert small.versions().count() == 2 and names(small) == names(table)


def test_dedup_rewrite_in_place(spark, table):
    put(spark, table, ("a", "x", "p"), ("b", "y", "p"), ("c", "only", "q"))
    put(spark, table, ("a", "x2", "p"))
    table.delete("p", F.col("id") == "b")
    state, files = names(table), {r.f for r in table.versions().where("project_id = 'q'").select(F.input_file_name().alias("f")).collect()}
    assert table.dedup_rewrite() == 2 and table.versions().count() == 3 and names(table) == state
    assert {r.f for r in table.versions().where("project_id = 'q'").select(F.input_file_name().alias("f")).collect()} == files
    assert table.dedup_rewrite() == 0


def test_certified_partitions_are_not_ranked_again(spark, table):
    put(spark, table, ("a", "x", "p"), ("b", "y", "q"), ("c", "z", "q"))
    put(spark, table, ("b", "y2", "q"))
    table.delete("q", F.col("id") == "c")
    want = names(table)
    assert table.logical_count() == 2 and table.dedup_rewrite() == 2
    state = table.store.state()
    assert state.clean == {f: n for f, n in state.clean.items() if f.startswith("project_id=q")} and list(state.clean.values()) == [1]
    assert names(table) == want and table.logical_count() == 2
    plan = table.read().where("project_id = 'q'")._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan
    again = VersionedTable(spark, table.path, table.schema, table.clock)  # the certificate is in the log
    assert again.store.state().clean == state.clean and names(again) == want
    small_files.compact(table.store, small_bytes=1 << 20)
    assert table.store.state().clean == state.clean
    put(spark, table, ("b", "y3", "q"))
    assert table.store.state().clean == {} and ("q", "b", "y3") in names(table) and table.logical_count() == 2


def test_update_from_with_words_and_ranges_in_its_condition(spark, tmp_path):
    e = Engine(spark, clock=Clock())
    e.create("feed", str(tmp_path / "f"), change_feed_schema())
    e.execute("INSERT INTO feed (project_id, timestamp, id, name) VALUES ('p', TIMESTAMP '2024-01-15T14:30:45Z', 'a', 'x and y'), ('p', TIMESTAMP '2024-01-15T14:30:45Z', 'b', 'or t.x'), ('p', TIMESTAMP '2024-01-15T14:30:45Z', 'c', 'plain')")
    now = lambda: {r.id: r.name for r in e.sql("SELECT id, name FROM feed").collect()}
    source = "FROM (VALUES ('a', 'it''s and t.id', 1), ('b', 'B', 5), ('c', 'C', 9)) AS src(k, v, n)"
    assert e.execute(f"UPDATE feed AS m SET name = src.v {source} WHERE m.id = src.k AND m.name = 'x and y' AND project_id = 'p'") == 1
    assert now() == {"a": "it's and t.id", "b": "or t.x", "c": "plain"}
    assert e.execute(f"UPDATE feed SET name = feed.name || '/' || v {source} WHERE k = id AND n BETWEEN 2 AND 9 AND (v = 'B' OR v = 'C') AND project_id = 'p' AND timestamp >= '2024-01-01'") == 2
    assert now() == {"a": "it's and t.id", "b": "or t.x/B", "c": "plain/C"}
    repeated = "FROM (VALUES ('c', '1'), ('c', '2'), ('c', '3')) AS s(k, v)"
    assert e.execute(f"UPDATE feed SET name = concat(name, s.v) {repeated} WHERE feed.id = s.k AND feed.name <> 'plain/C12' AND project_id = 'p'") == 2
    assert now()["c"] == "plain/C12"
    assert e.execute(f"UPDATE feed SET name = s.v {repeated} WHERE feed.id = s.k AND project_id = $1", "p") == 3 and now()["c"] == "3"
    assert e.execute("UPDATE feed SET name = $1 WHERE id = $2 AND project_id = $3", "$2 :p1 'q'", "c", "p") == 1 and now()["c"] == "$2 :p1 'q'"
    assert e.execute("DELETE FROM feed WHERE project_id = 'p' AND timestamp < $1 AND id = 'c'", datetime(2024, 2, 1)) == 1 and "c" not in now()
    with pytest.raises(DmlError):
        e.execute(f"UPDATE feed SET name = v {source} WHERE feed.id > src.k AND project_id = 'p'")
    e.execute("BEGIN")
    e.execute("DELETE FROM feed WHERE project_id = 'p' AND id = 'b'")
    with pytest.raises(DmlError):
        e.execute("ROLLBACK")
    e.execute("COMMIT")
    assert e.execute("ROLLBACK") == 0
    assert [r.operation for r in e.execute("DESCRIBE HISTORY feed").orderBy("version").collect()][:2] == ["insert", "update"]


def test_queued_updates_are_folded_and_failing_ones_kept_aside(spark, table):
    put(spark, table, ("a", "", "p"), ("b", "", "p"))
    source = lambda *kv: spark.createDataFrame(list(kv), "key string, v string")
    queue = UpdateQueue(limit=50)
    grow, fixed = {"name": "concat(t.name, s.v)"}, {"name": "s.v"}
    for u in (Update(table, "p", source(("a", "1"), ("b", "x")), {"id": "key"}, grow), Update(table, "p", source(("a", "2")), {"id": "key"}, grow), Update(table, "p", source(("b", "B")), {"id": "key"}, fixed), Update(table, "p", source(("b", "!")), {"id": "key"}, grow)):
        assert queue.add(u) == 0
    before = table.store.version()
    assert queue.flush() == 5 and names(table) == [("p", "a", "12"), ("p", "b", "B!")] and table.store.version() == before + 3
    bad = Update(table, "p", source(("a", "z")), {"id": "key"}, {"id": "s.v"})
    queue.add(bad)
    queue.add(Update(table, "p", source(("a", "3")), {"id": "key"}, grow))
    assert queue.flush() == 1 and names(table)[0] == ("p", "a", "123") and [x[0] for x in queue.quarantined] == [bad] and "immutable" in queue.quarantined[0][1]
    assert queue.flush() == 0


def test_files_are_in_the_declared_order(spark, table):
    put(spark, table, *[(f"{i % 7}", "x", "pq"[i % 2]) for i in range(40)])
    assert table.order_violations().count() == 0
    table.store.replace(table.versions().coalesce(1).sortWithinPartitions("project_id", "date", F.col("id").desc()), operation="unsorted")
    assert table.order_violations().agg(F.sum("violations")).first()[0] > 0


def test_commands(spark, table):
    from tidewater.__main__ import run

    put(spark, table, ("a", "x", "p"))
    put(spark, table, ("b", "y", "p"))
    assert run(spark, ["count", table.path]) == "2" and run(spark, ["optimize", table.path]) == "2 files became 1 in 1 partitions"
    assert run(spark, ["vacuum", table.path]) == "0 removed" and run(spark, ["vacuum", table.path, "--retain", "0"]) == "2 removed"
    assert "optimize" in run(spark, ["history", table.path]) and run(spark, ["add-column", table.path, "extra", "int"]) and run(spark, ["count", table.path]) == "2"
    assert names(table) == [("p", "a", "x"), ("p", "b", "y")]
    with pytest.raises(FileNotFoundError):
        run(spark, ["count", table.path + "-none"])


def test_keys_with_more_rows_than_one_fold(spark, table, monkeypatch):
    monkeypatch.setattr(mor, "FOLD_ROWS", 3)
    put(spark, table, ("a", "", "p"), ("b", "", "p"))
    source = spark.createDataFrame([("a", str(i), i) for i in range(8)] + [("b", "x", 0)], "key string, v string, seq int")
    assert table.update_from("p", source, {"id": "key"}, {"name": "concat(t.name, s.v)"}, order="seq") == 9
    assert names(table) == [("p", "a", "01234567"), ("p", "b", "x")]


def test_routed_table(spark, tmp_path):
    from tidewater.sources.tables import routed_table

    df = spark.createDataFrame([("p", 1), ("q", 2), (None, 3)], "project_id string, v int")
    for name, rows in (("shared", df), ("own", df.where("project_id = 'q'").withColumn("v", F.lit(20))), ("staged", df.limit(1))):
        rows.write.parquet(str(tmp_path / name))
    t = routed_table(spark, df.schema, str(tmp_path / "shared"), {"q": str(tmp_path / "own")}, [str(tmp_path / "staged")])
    assert sorted(((r.project_id, r.v) for r in t.collect()), key=str) == [("p", 1), ("p", 1), ("q", 20), (None, 3)]
    plan = t.where("project_id = 'p'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2


def test_filters_reach_the_partitions_below_the_ranking(spark, table):
    put(spark, table, ("a", "x", "p"), ("b", "y", "q"))
    plan = table.read().where("project_id = 'p' and date = date'2023-01-05' and name = 'x'")._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("PartitionFilters") :]
    assert "project_id" in scan[: scan.index("]")] and "date" in scan[: scan.index("]")]
    assert "name" not in scan[scan.index("PushedFilters") :].split("\n")[0].split("ReadSchema")[0]


def test_flush_dedup(spark):
    df = spark.createDataFrame([(1, 5, 0, "a"), (1, 7, 1, "b"), (1, 7, 2, "c"), (1, None, 3, "d"), (None, 1, 0, "e")], "k int, v int, n int, x string")
    assert sorted(r.x for r in flush_dedup(df, ["k"], "v", "n").collect()) == ["c", "e"]
    assert sorted(r.x for r in flush_dedup(df, ["k"], None, "n").collect()) == ["d", "e"]
    assert flush_dedup(df, ["k"]).count() == 2


def test_statements(spark, tmp_path):
    e = Engine(spark, clock=Clock())
    schema = TableSchema(
        "notes", (Field("project_id", "Utf8"), Field("date", "Date32", False), Field("timestamp", 'Timestamp(Microsecond, Some("UTC"))', False), Field("id", "Utf8", False), Field("body", "Variant", mutable=True), Field("n", "Int64", mutable=True), Field("tags", "List(Utf8)", mutable=True), Field("updated_at", 'Timestamp(Microsecond, Some("UTC"))'), Field("deleted", "Boolean")),
        dedup_keys=("timestamp", "id"), version="updated_at", tombstone="deleted", version_append=True,
    ).validate()
    e.create("notes", str(tmp_path / "n"), schema)
    assert e.execute("INSERT INTO notes (project_id, timestamp, id, body, n, tags) VALUES ('p', TIMESTAMP '2024-01-15T14:30:45Z', 'a', '{\"m\": \"x\"}', 1, ARRAY['t']), ('p', TIMESTAMP '2024-01-15T14:30:46Z', 'b', NULL, 2, NULL)") == 2
    assert e.execute("INSERT INTO notes (project_id, timestamp, id, n) SELECT 'q', TIMESTAMP '2024-01-16T00:00:00Z', x.v, 5 FROM unnest(ARRAY['a','c']) AS x(v)") == 2
    assert e.sql("SELECT id FROM notes WHERE body->>'m' = 'x'").first().id == "a"
    assert e.execute("UPDATE notes SET n = n + 10, tags = ARRAY['u','v'] WHERE project_id = 'p' AND id = 'a'") == 1
    assert e.execute("UPDATE notes SET n = s.v FROM (VALUES ('a', 7), ('c', 8)) AS s(k, v) WHERE notes.id = s.k AND project_id = 'q'") == 2
    assert e.execute("DELETE FROM notes WHERE project_id = $1 AND id = $2", "p", "b") == 1
    got = {(r.project_id, r.id): (r.n, r.tags) for r in e.execute("SELECT * FROM notes").collect()}
    assert got == {("p", "a"): (11, ["u", "v"]), ("q", "a"): (7, None), ("q", "c"): (8, None)}
    for bad in ("DELETE FROM notes WHERE id = 'a'", "DELETE FROM notes WHERE project_id = 'p' OR id = 'a'", "UPDATE notes SET id = 'z' WHERE project_id = 'p'", "UPDATE elsewhere SET n = 1 WHERE project_id = 'p'"):
        with pytest.raises(DmlError):
            e.execute(bad)
    assert e.execute("OPTIMIZE notes") >= 0 and e.sql("SELECT count(*) AS n FROM notes").first().n == 3
    e.execute("CREATE TABLE tmp_scores (k INTEGER, v DOUBLE PRECISION)")
    assert e.execute("INSERT INTO tmp_scores VALUES (1, 2.5), (2, NULL)") == 2
    assert e.sql("SELECT sum(v) AS s FROM tmp_scores").first().s == 2.5
    assert e.execute("DROP TABLE tmp_scores") == 0 and e.execute("ABORT") == 0
    assert "Scan" in " ".join(r.plan for r in e.execute("EXPLAIN SELECT * FROM notes").collect())
    assert e.execute("SHOW timezone").first()[0] == "UTC"


def test_catalogue(spark, tmp_path):
    from tidewater.sources import catalog

    e = Engine(spark)
    e.register("cat_t", spark.range(1).selectExpr("id", "cast(null as array<string>) tags"))
    e.sql("SELECT 1").collect()
    catalog.install(e)
    assert [(r.column_name, r.data_type) for r in e.sql("SELECT column_name, data_type FROM information_schema.columns WHERE table_name = 'cat_t' ORDER BY ordinal_position").collect()] == [("id", "bigint"), ("tags", "text[]")]
    assert e.sql("SELECT count(*) AS n FROM pg_catalog.pg_stat_activity").first().n == 0
    assert e.sql("SELECT value FROM engine_stats WHERE key = 'queries'").first().value >= 1
