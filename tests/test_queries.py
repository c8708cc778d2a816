"""Every query of the catalogue against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tidewater.plans import pipeline_queries, pipeline_sql, reference_queries
from tools.compare import canon

FOLDER = "/root/testdata/sf0.001"
QUERIES = {**pipeline_queries.QUERIES, **reference_queries.QUERIES}
SQL = {**pipeline_sql.SQL, **reference_queries.SQL}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, con, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in SQL:
        want = con.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canon(got) == canon(want)


def test_hourly_aggregates_hold_every_message(spark, con):
    """p4_hourly leaves out messages without an arrival time, as its SQL does; p4_hourly_whole has them."""
    got = QUERIES["p4_hourly_whole"](spark, FOLDER).toPandas()
    want = con.execute(pipeline_sql._FATES + """
SELECT count(*) AS n, sum(duration) AS total, count(*) FILTER (fate = 'unknown') AS unknown_n, sum(duration) FILTER (fate = 'unknown') AS unknown_sum FROM fates""").df().iloc[0]
    assert want.unknown_n > 0 and got.unknown_n.sum() == want.unknown_n and got.unknown_sum.sum() == want.unknown_sum
    assert got[["final_n", "diverted_n", "unknown_n"]].to_numpy().sum() == want.n
    assert got[["final_sum", "diverted_sum", "unknown_sum"]].fillna(0).to_numpy().sum() == want.total
    known = QUERIES["p4_hourly"](spark, FOLDER).toPandas()
    assert canon(got[got.final_n + got.diverted_n > 0][known.columns]) == canon(known)


def test_compaction_runs_on_the_files_of_the_log(spark, con):
    got = QUERIES["p7_compacted"](spark, FOLDER).toPandas().set_index(["project_id", "date"])
    rows = con.execute("SELECT coalesce(project_id, 'default') AS project_id, date, count(*) AS n FROM otel_logs_and_spans GROUP BY ALL").df()
    assert sum(got.rows_after) == sum(rows.n) and len(got) == len(rows) and (got.rows_before == got.rows_after).all()
    assert (got.files_after == 1).all()
    plan = con.execute(SQL["p7_plan"]).df()
    few = got[got.files_before > 1].files_before
    assert 0 < len(few) <= len(plan) and 0.9 * plan.files_before.sum() < few.sum() <= plan.files_before.sum()


def test_every_statement_has_sql():
    """Or is one of the sketches, which queries of their own hold against exact results."""
    without = {name for name, (_, other) in reference_queries.STATEMENTS.items() if other == reference_queries.NO_SQL}
    assert without == {"pctl_bucket", "pctl_array_unnest", "dcount_sketch"}
    assert set(reference_queries.STATEMENTS) - without <= set(SQL) and set(SQL) <= set(QUERIES)
