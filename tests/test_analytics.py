"""Edges of funnels, retention, users and metrics."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions import clock
from eventloom.operators import analytics, rollups

SCHEMA = "project_id STRING, user_id STRING, event STRING, ts TIMESTAMP_NTZ"
DAY = dt.datetime(2024, 1, 1)


def at(seconds):
    return DAY + dt.timedelta(seconds=seconds)


def events(spark, rows):
    return spark.createDataFrame([(p, u, e, at(s)) for p, u, e, s in rows], SCHEMA)


def users_of(frame):
    return [r.users for r in frame.orderBy("pair").collect()]


@pytest.mark.parametrize(
    ("rows", "wanted"),
    [
        ([("A", 0), ("B", 0)], 1),  # same instant
        ([("A", 0), ("B", 3600)], 1),  # exactly at the end of the window
        ([("A", 0), ("B", 3600.000001)], 0),
        ([("A", 10), ("B", 9)], 0),  # before
        ([("A", 3599), ("B", 3601)], 1),  # neighbouring slots
        ([("A", 0), ("A", 3599), ("B", 7198)], 1),
        ([("B", 5)], 0),
        ([], 0),
    ],
)
def test_funnel_pair(spark, rows, wanted):
    frame = events(spark, [("p", "u", e, s) for e, s in rows])
    assert users_of(analytics.funnel(frame, ["A", "B"], "1h", project="p")) == [wanted]


def test_funnel_projects_and_empty_user(spark):
    frame = events(
        spark,
        [("p", "u", "A", 0), ("q", "u", "B", 5), ("p", "", "A", 0), ("p", "", "B", 1),
         ("q", "w", "A", 0), ("q", "w", "B", 1)],
    )
    rows = analytics.funnel(frame, ["A", "B"], "1h").collect()
    assert {(r.project_id, r.users) for r in rows} == {("p", 1), ("q", 1)}


def test_funnel_bounds_apply_to_the_first_event(spark):
    frame = events(spark, [("p", "u", "A", 50), ("p", "u", "B", 200), ("p", "v", "A", 101),
                           ("p", "v", "B", 102)])
    got = analytics.funnel(frame, ["A", "B"], "1h", project="p", start=at(0), end=at(100))
    assert users_of(got) == [1]


def test_funnel_event_followed_by_itself(spark):
    frame = events(spark, [("p", "u", "A", 0)])
    assert users_of(analytics.funnel(frame, ["A", "A"], "1h", project="p")) == [1]


def test_funnel_needs_two_steps(spark):
    with pytest.raises(ValueError, match="2 steps"):
        analytics.funnel(events(spark, []), ["A"])


@pytest.mark.parametrize("window", ["7s", "60s", "15m"])
def test_funnel_same_as_pairs(spark, window):
    """Random events, compared with every pair of events."""
    rng = np.random.default_rng(3)
    rows = [
        ("p", f"u{rng.integers(25)}", "ABC"[rng.integers(3)], float(rng.integers(0, 3000)) / 2)
        for _ in range(260)
    ]
    steps = ["A", "B", "A", "C", "C"]
    limit = clock.parse_window(window)
    wanted = []
    for a, b in zip(steps, steps[1:], strict=False):
        wanted.append(
            len({u for _, u, e, s in rows for _, v, f, t in rows
                 if u == v and e == a and f == b and s <= t <= s + limit})
        )
    assert users_of(analytics.funnel(events(spark, rows), steps, window, project="p")) == wanted


def test_funnel_plan_has_no_join_or_window(spark, folder):
    from eventloom.sources import given

    frame = analytics.funnel(given.analytics_events(spark, folder), ["view", "click"], "1h")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "Python" not in plan
    assert "In(event_type, [click,view])" in plan or "PushedFilters: [Or" in plan


def test_funnel_with_an_endless_window(spark):
    frame = events(spark, [("p", "u", "A", 0), ("p", "u", "B", 3e9), ("p", "v", "B", 0),
                           ("p", "v", "A", 1)])
    assert users_of(analytics.funnel(frame, ["A", "B"], "999999999d", project="p")) == [1]


def test_retention_weeks(spark):
    week = 7 * 86400
    frame = events(
        spark,
        [
            ("p", "u", "S", 6 * 86400 + 86399), ("p", "u", "R", 7 * 86400),  # Sunday, then Monday
            ("p", "v", "S", 0), ("p", "v", "S", 2 * week), ("p", "v", "R", 2 * week + 5),
            ("p", "w", "S", 3 * week),  # never returns
            ("p", "x", "S", 4 * week), ("p", "x", "R", 0),  # return before the cohort
        ],
    )
    rows = analytics.retention(frame, "S", "R", 4, project="p", with_size=True).collect()
    got = {
        (r.cohort - DAY.date()).days // 7: (r.total, r.period_0, r.period_1, r.period_2, r.cohort_size)
        for r in rows
    }
    assert got == {0: (0, 0, 1, 1, 2), 2: (1, 1, 0, 0, 1)}


def test_retention_across_years(spark):
    frame = spark.createDataFrame(
        [("p", "u", "S", dt.datetime(2024, 12, 30)), ("p", "u", "R", dt.datetime(2025, 1, 8))], SCHEMA
    )
    row = analytics.retention(frame, "S", "R", 2, project="p").first()
    assert (str(row.cohort), row.period_0, row.period_1) == ("2024-12-30", 0, 1)


def test_users_page_and_filter(spark):
    rows = [("p", f"u{i}", "A", i, "X" if i % 2 else "Y", "c", "b", "o", "d") for i in range(9)]
    rows.append(("p", "", "A", 99, "X", "c", "b", "o", "d"))
    frame = spark.createDataFrame(
        [(p, u, e, at(s), *rest) for p, u, e, s, *rest in rows],
        SCHEMA + ", country STRING, city STRING, browser STRING, os STRING, device_type STRING",
    )
    page = analytics.users(frame, "p", limit=3, offset=1).collect()
    assert [r.user_id for r in page] == ["u7", "u6", "u5"]
    only = analytics.users(frame, "p", "country:X").collect()
    assert {r.user_id for r in only} == {"u1", "u3", "u5", "u7"}
    assert analytics.users(frame, "p", "country:").count() == 9
    assert analytics.users(frame, "p", "no colon").count() == 9
    assert analytics.users(frame, "p", "user_id:a:b").count() == 0
    for limit, offset in ((0, 0), (1001, 0), (5, -1)):
        with pytest.raises(ValueError):
            analytics.users(frame, "p", limit=limit, offset=offset)
    with pytest.raises(ValueError, match="unknown column"):
        analytics.users_filter(frame, "1=1;secret:x")


@pytest.mark.parametrize(
    ("text", "seconds"),
    [("7d", 604800), ("1h", 3600), ("30m", 1800), ("5s", 5), ("0d", 604800), ("d", 604800),
     ("7w", 604800), ("", 604800), (None, 604800), ("1h\n", 604800), (" 1h", 604800),
     ("999999999999d", clock.LONGEST_WINDOW_SECONDS)],
)
def test_window_texts(spark, text, seconds):
    assert clock.parse_window(text) == seconds
    column = spark.createDataFrame([(text,)], "w STRING").select(
        clock.parse_window_column(F.col("w")).alias("s")
    )
    assert column.first().s == seconds


def test_metrics_default_to_hours_and_closed_ranges(spark):
    frame = spark.createDataFrame(
        [("p", "A", at(s), 2, 1) for s in (0, 60, 3600, 7200)],
        "project_id STRING, event STRING, bucket TIMESTAMP_NTZ, count BIGINT, unique_users BIGINT",
    )
    got = analytics.metrics(frame, "p", "A", at(60), at(7200), "fortnight").collect()
    assert [(r.bucket, r["count"]) for r in got] == [(at(0), 2), (at(3600), 2), (at(7200), 2)]
    assert got[0].asDict().keys() == {"bucket", "count", "unique_users"}


def test_sketches_agree_with_exact_counts(spark, folder):
    from eventloom.sources import given

    frame = given.analytics_events(spark, folder)
    exact = {
        (r.project_id, r.event, r.bucket): r.unique_users
        for r in analytics.metrics_unique_exact(frame, granularity="day").collect()
    }
    merged = analytics.metrics_unique(rollups.sketch_rollups(frame), granularity="day").collect()
    assert {(r.project_id, r.event, r.bucket): r.unique_users for r in merged} == exact


def test_live_counts_of_one_minute(spark):
    frame = events(spark, [("p", "u", "A", 59), ("p", "u", "A", 60), ("p", "u", "B", 119),
                           ("q", "u", "A", 61), ("p", "u", "A", 120)])
    got = rollups.live_counts(frame, at(75), "p").collect()
    assert {(r.event, r["count"]) for r in got} == {("A", 1), ("B", 1)}
