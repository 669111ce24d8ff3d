import datetime as dt

import pytest
from pyspark.sql import functions as F

from antecede.operators import precedence as P

COLUMNS = ("GlobalEventID long, day int, EventRootCode string, Actor1CountryCode string, "
           "Actor2CountryCode string, ActionGeo_CountryCode string")


def events(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def skewed(spark):
    """One pair key holds well over a third of the rows, most of them on one day."""
    rows = [(i, 20240110, "14", "A", "B", "X") for i in range(60)]
    rows += [(100 + i, 20240101 + i % 28, "14", "B", "A", "X") for i in range(40)]
    rows += [(200 + i, 20240101 + (i * 7) % 29, "18", f"C{i % 9}", "", "Y") for i in range(90)]
    return rows


def brute(rows, window=7):
    def key(r):
        a, b = r[3] or r[5] or "XX", r[4] or r[5] or "XX"
        return (min(a, b), max(a, b), r[2] or "00")

    day = lambda r: dt.datetime.strptime(str(r[1]), "%Y%m%d").date()
    out = {}
    for r in rows:
        before = [p[0] for p in rows if key(p) == key(r) and 1 <= (day(r) - day(p)).days <= window]
        out[r[0]] = sorted(before)
    return out


def test_in_degree_matches_brute_force_on_a_hot_key(spark):
    rows = skewed(spark)
    got = {r.GlobalEventID: r.causal_in_degree for r in P.trailing_in_degree(events(spark, rows)).collect()}
    assert got == {k: len(v) for k, v in brute(rows).items()}


@pytest.mark.parametrize("most", [2, 4])
def test_precursors_are_complete_up_to_the_limit(spark, most):
    rows = skewed(spark)
    served = P.low_in_degree(events(spark, rows), max_in_degree=most)
    got = {r.GlobalEventID: list(r.precursors) for r in served.collect()}
    assert got == {k: v for k, v in brute(rows).items() if len(v) <= most}


def test_window_uses_dates_across_a_month_end(spark):
    rows = [(1, 20240228, "14", "A", "B", "X"), (2, 20240303, "14", "A", "B", "X")]
    got = {r.GlobalEventID: r.causal_in_degree for r in P.trailing_in_degree(events(spark, rows)).collect()}
    assert got == {1: 0, 2: 1}  # integer arithmetic on yyyymmdd would miss it


def test_window_partition_holds_days_not_events(spark):
    plan = P.pair_days(P.with_pair_key(events(spark, skewed(spark))))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Aggregate")


def test_histogram_adds_up(spark):
    rows = P.degree_histogram(events(spark, skewed(spark))).agg(F.sum("cnt"), F.sum("pct")).first()
    assert rows[0] == 190 and abs(rows[1] - 100) < 1e-9
