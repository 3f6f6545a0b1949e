"""What the plans must look like: pruned scans, one scan, one way to a place."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from eventloom.operators import analytics, enrich, rollups
from eventloom.session import materialise, remove_folder, scratch_path
from eventloom.sources import given, sinks

FROM, TO = "2024-01-10 00:00:00", "2024-01-12 00:00:00"


@pytest.fixture(scope="module")
def stored(spark, folder):
    path = scratch_path(spark)
    sinks.layout_events(given.analytics_events(spark, folder), path)
    return spark.read.parquet(path)


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def filters_of(frame) -> str:
    return " ".join(
        line for line in plan_of(frame).splitlines() if "PartitionFilters" in line
    )


def test_funnel_reads_the_days_of_its_range(stored):
    found = filters_of(analytics.funnel(stored, ["view", "click"], "1d", start=FROM, end=TO))
    assert "event_date" in found and ">= 2024-01-10" in found and "<= 2024-01-13" in found


def test_retention_begins_with_the_week_of_its_range(stored):
    found = filters_of(analytics.retention(stored, "signup", "view", start=FROM, end=TO))
    assert ">= 2024-01-08" in found


def test_retention_keeps_returns_inside_the_first_week(spark, stored):
    """A return before the cohort event, in the same week, counts."""
    rows = [("p", "a", "view", "2024-01-08 01:00:00"), ("p", "a", "signup", "2024-01-10 01:00:00")]
    frame = spark.createDataFrame(rows, "project_id STRING, user_id STRING, event STRING, t STRING")
    frame = frame.withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = analytics.retention(frame, "signup", "view", 2, start=FROM, end=TO).collect()
    assert [(r.total, r.period_0, r.period_1) for r in got] == [(1, 1, 0)]


def test_live_counts_read_one_day(stored):
    assert "event_date" in filters_of(rollups.live_counts(stored, now="2024-01-12 10:00:00"))
    assert "event_date" in filters_of(rollups.live_counts(stored))


def test_rollups_scan_events_once(spark, stored):
    from pyspark.sql import DataFrame

    frame: DataFrame = rollups.build_rollups(stored)
    frame.collect()
    final = plan_of(frame).split("Initial Plan")[0]
    assert final.count("FileScan") == 1


def test_stored_rollups_read_the_days_asked_for(spark, folder):
    path = scratch_path(spark)
    sinks.write_rollups(rollups.sketch_rollups(given.analytics_events(spark, folder)), 0, path)
    assert "bucket_date" in filters_of(sinks.read_rollups(spark, path, FROM, TO))


def test_open_bounds_drop_nothing(spark):
    rows = [("p", "a", "x", "1970-01-01 00:00:00"), ("p", "a", "y", "1970-01-01 00:00:01"),
            ("p", "b", "x", "2200-01-01 00:00:00"), ("p", "b", "y", "2200-01-01 00:00:01")]
    frame = spark.createDataFrame(rows, "project_id STRING, user_id STRING, event STRING, t STRING")
    frame = frame.withColumn("ts", F.col("t").cast("timestamp_ntz"))
    assert analytics.funnel(frame, ["x", "y"], "1h").first().users == 2
    assert analytics.retention(frame, "x", "y", 1).count() == 2


def test_overlapping_ranges_agree_on_both_ways(spark):
    base = 10 << 24
    ranges = spark.createDataFrame(
        [(base, base + 999, "O", "o"), (base + 100, base + 199, "I", "i"), (base + 150, base + 159, "J", "j"),
         (base + 100, base + 199, "I", "k"), (base + 500, base + 1200, "P", "p"), (base + 70_000, base + 70_001, "Q", "q")],
        "start_ip BIGINT, end_ip BIGINT, country STRING, city STRING",
    )
    places = {0: "O", 99: "O", 100: "I", 149: "I", 155: "J", 160: "I", 200: "O", 499: "O", 500: "P", 1200: "P", 1201: None, 70_000: "Q", 70_002: None}
    rows = [(n, ".".join(str((base + n) >> s & 255) for s in (24, 16, 8, 0))) for n in places]
    events = spark.createDataFrame(rows, "n BIGINT, address STRING")
    for small in (100, 0):
        got = {r.n: r.country for r in enrich.geo_enrich(events, ranges, small_ranges=small).collect()}
        assert got == places


def test_many_ranges_read_an_address_once_a_scan(spark):
    """In all its spellings; events without an address keep their row."""
    texts = ["10.0.1.7", "010.0.1.7", "::ffff:10.0.1.7", "::FFFF:0a00:0107", "10.0.99.1", "no", None, "10.0.1.7"]
    rows = [(i, text) for i, text in enumerate(texts)]
    events = spark.createDataFrame(rows, "event_id int, address string")
    start = 10 << 24
    ranges = spark.createDataFrame(
        [(start, start + 1023, "A", "a")], "start_ip long, end_ip long, country string, city string"
    )
    located = enrich.geo_enrich(events, ranges, small_ranges=0)
    reading = [line for line in plan_of(located).splitlines() if "split(" in line]
    # Once to find the distinct ones, once to join them back; no filter reads them again.
    assert len(reading) == 2 and not any("Filter" in line for line in reading)
    assert located.columns == ["event_id", "address", "country", "city"]
    places = [(r.country, r.city) for r in located.orderBy("event_id").collect()]
    assert places == [("A", "a")] * 4 + [(None, None)] * 3 + [("A", "a")]


def test_retention_of_kept_days_reads_no_events(spark, folder):
    events = given.analytics_events(spark, folder)
    path = scratch_path(spark)
    for batch in range(2):
        sinks.write_batch(analytics.user_days(events.where(F.col("event_id") % 2 == batch)), batch, path)
    days = spark.read.parquet(path)
    for first, last in ((None, None), ("2024-01-10", "2024-01-17"), ("2024-01-08", None), (None, "2024-01-20")):
        found = analytics.retention_from_days(days, "view", "view", 5, first_day=first, last_day=last, with_size=True)
        assert all(path.rsplit("/", 1)[1] in name for name in found.inputFiles())
        end = last and f"{last} 23:59:59.999999"
        assert found.collect() == analytics.retention(events, "view", "view", 5, None, first, end, True).collect()


RANGES = [
    ("2024-01-05 07:13:20", "2024-01-25 18:42:59"),
    ("2024-01-05 00:00:00", "2024-01-25 23:59:59"),
    ("2024-01-05 07:00:00", "2024-01-05 07:59:00"),
    ("2024-01-05 07:10:00", "2024-01-05 07:20:00"),
    ("2024-01-05 23:30:00", "2024-01-06 00:30:00"),
    ("2024-01-05 22:30:00", "2024-01-07 00:00:00"),
    (None, "2024-01-09 10:10:10"),
    ("2024-01-20 10:10:10.000001", None),
    (None, None),
    ("2024-01-09", "2024-01-08"),
]


def test_metrics_of_grains_read_the_ends_only(spark, folder):
    minutes = materialise(rollups.build_rollups(given.analytics_events(spark, folder)))
    path = scratch_path(spark)
    sinks.write_grains(minutes, path)
    whole = sinks.read_grains(spark, path)
    for grain in ("minute", "hour", "day"):
        for start, end in RANGES:
            wanted = analytics.metrics(minutes, None, None, start, end, grain).collect()
            assert analytics.metrics_from_grains(whole, None, None, start, end, grain).collect() == wanted
    # Days inside are gone from the finer tables: nothing misses them.
    for day in range(6, 25):
        for grain in ("minute", "hour"):
            remove_folder(spark, f"{path}/{grain}/bucket_date=2024-01-{day:02}")
    some = sinks.read_grains(spark, path)
    start, end = RANGES[0]
    wanted = analytics.metrics(minutes, "proj_1", "view", start, end, "day").collect()
    assert wanted and analytics.metrics_from_grains(some, "proj_1", "view", start, end, "day").collect() == wanted


def users_of(spark, rows):
    frame = spark.createDataFrame(rows, "user_id string, t string, a string")
    return frame.select(
        F.lit("p").alias("project_id"), F.lit("e").alias("event"), "user_id",
        F.col("t").cast("timestamp_ntz").alias("ts"), F.col("a").cast("timestamp").alias("arrival_ts"),
    )


def test_kept_users_go_a_week_after_their_last_update(spark):
    batches = [
        [("u1", "2024-01-01 05:00:00", "2024-01-01 05:00:00"), ("", "2024-01-01 05:00:00", "2024-01-09 05:00:00")],
        [("u2", "2024-01-01 06:00:00", "2024-01-08 04:59:59.999999"), ("u3", "2024-01-02 00:00:00", "2024-01-02 00:00:00")],
        [("u4", "2024-01-02 01:00:00", "2024-01-09 00:00:00"), ("u5", "2024-01-01 01:00:00", "2024-01-07 00:00:00")],
    ]
    parts = [rollups.unique_updates(users_of(spark, rows)) for rows in batches]

    def alive(state, now):
        found = rollups.merge_uniques(rollups.live_uniques(state, now), ["day"])
        return {str(r["day"]): r["unique_users"] for r in found.collect()}

    state = parts[2].unionByName(parts[0]).unionByName(parts[1])
    # u1, u5 and u2 keep the first day alive; u3 was forgotten at the instant u4 came.
    assert alive(state, "2024-01-09 00:00:00") == {"2024-01-01": 3, "2024-01-02": 1}
    assert alive(state, "2024-01-15 04:59:59.999999") == {"2024-01-02": 1}
    assert alive(state, "2024-01-16 00:00:00") == {}
    small = rollups.live_uniques(parts[0].unionByName(parts[2]), "2024-01-09 00:00:00")
    assert alive(small.unionByName(parts[1]), "2024-01-09 00:00:00") == {"2024-01-01": 3, "2024-01-02": 1}


def test_kept_users_are_counted_exactly(spark):
    def part(low, high, at):
        return rollups.user_updates(
            users_of(spark, [("x", "2024-01-01 05:00:00", at)]).drop("user_id").crossJoin(
                spark.range(low, high).select(F.col("id").cast("string").alias("user_id"))
            )
        )

    old, new, more = (part(9000, 9100, "2024-01-01 05:00:00"), part(0, 4000, "2024-01-09 05:10:00"),
                      part(3000, 5000, "2024-01-09 05:50:00"))
    small = rollups.live_uniques(old.unionByName(new), "2024-01-09 06:00:00")
    live = rollups.live_uniques(small.unionByName(more), "2024-01-09 06:00:00")
    # Users of the first week are forgotten; the others count once.
    assert [r["unique_users"] for r in rollups.merge_uniques(live, ["day"]).collect()] == [5000]


def test_days_before_the_first_monday(spark):
    rows = [("p", "x", "u", "1969-12-31 12:00:00"), ("p", "y", "u", "1970-01-04 12:00:00"), ("p", "y", "u", "1970-01-05 00:00:00")]
    events = spark.createDataFrame(rows, "project_id string, event string, user_id string, t string")
    events = events.withColumn("ts", F.col("t").cast("timestamp_ntz"))
    found = analytics.retention_from_days(analytics.user_days(events), "x", "y", 2)
    assert found.collect() == analytics.retention(events, "x", "y", 2).collect()


def test_users_page_by_page(spark, folder):
    events = given.analytics_events(spark, folder, with_location=True)
    whole = analytics.users(events, limit=40).collect()
    keys = [c for c in whole[0].asDict() if c not in ("first_seen", "last_seen")]
    found, last = [], None
    while len(found) < 40:
        part = analytics.users_after(events, last, limit=10).collect()
        found += part
        last = [part[-1].last_seen, *(part[-1][k] for k in keys)]
    assert found == whole


def test_days_are_moved_once_and_merged(spark, folder, tmp_path):
    events = given.analytics_events(spark, folder)
    source, target = f"{tmp_path}/batches", f"{tmp_path}/events"
    for batch, part in enumerate([F.col("event_id") % 3 > 0, F.col("event_id") % 3 == 0]):
        sinks.write_events(events.where(part), batch, source)
        sinks.compact_days(spark, source, target, "2024-01-20")
    moved, left = spark.read.parquet(target), spark.read.parquet(source)
    assert moved.count() == events.where("ts < '2024-01-20'").count()
    assert left.count() == events.where("ts >= '2024-01-20'").count()
    assert moved.select("event_id").distinct().count() == moved.count()
