from datetime import timedelta

from tidewater.operators import late_events as le

H, M = 3_600_000_000, 60_000_000
SCHEMA = "source string, event_us long, arrival_us long, v long, n int"


def events(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)


def fates(spark, rows, marks, rule):
    df = events(spark, rows)
    out = le.classify(df, le.closing_times(df, marks(df, rule), rule), rule)
    return {r.v: r.fate for r in out.collect()}


def test_scheduled_limits_belong_to_the_earlier_class(spark):
    rule = le.Lateness()
    end = 11 * H
    rows = [
        ("a", 10 * H, end, 1), ("a", 10 * H, end + 15 * M, 2), ("a", 10 * H, end + 15 * M + 1, 3), ("a", end - 1, end + 24 * H, 4),
        ("a", 10 * H, end + 24 * H + 1, 5), ("a", 10 * H, None, 6), ("a", None, 5, 7), (None, 10 * H, end + 20 * M, 8), ("a", -1, 0, 9),
    ]
    assert fates(spark, rows, le.scheduled_punctuations, rule) == {
        1: "on_time", 2: "on_time", 3: "correction", 4: "correction", 5: "diverted", 6: "unknown", 7: "unknown", 8: "correction", 9: "on_time",
    }


def test_slowest_source_holds_a_period_open(spark):
    rule = le.Lateness(delay=timedelta(0))
    rows = [("a", 10 * H, 100, 1), ("b", 10 * H, 101, 2), ("a", 11 * H, 200, 3), ("a", 10 * H + 5, 250, 4), ("b", 11 * H, 300, 5), ("a", 10 * H + 6, 400, 6)]
    got = fates(spark, rows, le.observed_punctuations, rule)
    assert got[4] == "on_time" and got[6] == "correction" and got[5] == "on_time"


def test_idle_source_is_ignored_after_its_timeout(spark):
    rows = [("a", 10 * H, 100, 1), ("b", 10 * H, 100, 2), ("a", 11 * H, 200, 3), ("a", 10 * H, 10 * M, 4), ("a", 10 * H, 10 * M + 200, 5)]
    got = fates(spark, rows, le.observed_punctuations, le.Lateness(delay=timedelta(0), idle=timedelta(minutes=10)))
    assert got[4] == "on_time" and got[5] == "correction"
    assert fates(spark, rows, le.observed_punctuations, le.Lateness(delay=timedelta(0)))[5] == "on_time"


def test_aggregates_are_corrected(spark):
    rule = le.Lateness()
    rows = [("a", 10 * H, 10 * H, 1), ("a", 10 * H, 12 * H, 2), ("a", 10 * H, 90 * H, 4), ("a", 10 * H, None, 8)]
    df = events(spark, rows)
    out = le.corrected_aggregates(le.classify(df, le.closing_times(df, le.scheduled_punctuations(df, rule), rule), rule), "v").collect()
    assert [tuple(r) for r in out] == [(10 * H, 1, 1, 1, 2, 3, 1)]


def test_whole_aggregates_hold_every_event(spark):
    rule = le.Lateness()
    rows = [("a", 10 * H, 10 * H, 1), ("a", 10 * H, 12 * H, 2), ("a", 10 * H, 90 * H, 4), ("a", 10 * H, None, 8), ("a", 20 * H, None, 16), ("a", None, 5, 32)]
    df = events(spark, rows)
    fates = le.classify(df, le.closing_times(df, le.scheduled_punctuations(df, rule), rule), rule)
    out = {r.period_us: tuple(r)[1:] for r in le.corrected_aggregates(fates, "v", whole=True).collect()}
    assert out == {
        10 * H: (1, 1, 1, 2, 3, 1, 4, 1, 8), 20 * H: (0, None, 0, 0, None, 0, None, 1, 16), None: (0, None, 0, 0, None, 0, None, 1, 32),
    }


def test_columns_of_the_helpers_names_survive(spark):
    rule = le.Lateness()
    df = events(spark, [("a", 10 * H, 11 * H, 1)]).selectExpr("*", "'mine' bound", "'too' closed_at", "7 fate")
    out = le.classify(df, le.closing_times(df, le.scheduled_punctuations(df, rule), rule), rule).first()
    assert (out.bound, out.closed_at, out.fate) == ("mine", "too", "on_time")


def test_empty(spark):
    rule = le.Lateness()
    df = events(spark, [])
    assert le.classify(df, le.closing_times(df, le.observed_punctuations(df, rule), rule), rule).count() == 0
