"""Locations, agents, stored layout, dead letters, health."""

from __future__ import annotations

import datetime as dt
import ipaddress
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions import address, agents
from eventloom.operators import deadletter, enrich, health, rollups
from eventloom.plans.catalogue import REGISTERED
from eventloom.sources import sinks, tables, topics


def test_addresses(spark):
    texts = ["0.0.0.0", "10.1.2.3", "255.255.255.255", "256.1.1.1", "1.2.3", "1.2.3.4.5", "a.b.c.d",
             "", None, " 1.2.3.4", "::1", "1.2.3.-4"]
    frame = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = [r.n for r in frame.select(address.ipv4_number(F.col("t")).alias("n")).collect()]
    assert got == [int(ipaddress.IPv4Address(t)) for t in texts[:3]] + [None] * 9


@pytest.mark.parametrize("small", [100_000, 0])
def test_locations_same_as_search(spark, small):
    rng = np.random.default_rng(5)
    edges = np.sort(rng.choice(2**32, 120, replace=False))
    ranges = [(int(a), int(b) - 1, f"c{i}", f"t{i}")
              for i, (a, b) in enumerate(zip(edges[::2], edges[1::2], strict=True))]
    ranges += [(5, 5, "one", "one")]
    ranges = [r for r in ranges if r[0] <= r[1]]
    points = [*rng.integers(0, 2**32, 400).tolist(), 4, 5, 6, *[r[0] for r in ranges],
              *[r[1] for r in ranges]]
    frame = spark.createDataFrame(
        [(i, str(ipaddress.IPv4Address(int(p)))) for i, p in enumerate(points)] + [(-1, None)],
        "id BIGINT, address STRING",
    )
    table = spark.createDataFrame(
        ranges, "start_ip BIGINT, end_ip BIGINT, country STRING, city STRING"
    )
    got = {r.id: r.country for r in enrich.geo_enrich(frame, table, small_ranges=small).collect()}
    assert len(got) == len(points) + 1 and got[-1] is None
    for i, p in enumerate(points):
        assert got[i] == next((c for a, b, c, _ in ranges if a <= p <= b), None)


@pytest.mark.parametrize(
    ("agent", "wanted"),
    [
        (None, ("unknown", "unknown", "unknown")),
        ("", ("unknown", "unknown", "unknown")),
        ("curl/8.0", ("unknown", "unknown", "desktop")),
        ("Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36 Edg/120.0",
         ("Edge", "Windows", "desktop")),
        ("Mozilla/5.0 (iPad; CPU OS 16_6 like Mac OS X) Version/16.6 Mobile/15E Safari/604.1",
         ("Mobile Safari", "iOS", "tablet")),
        ("Mozilla/5.0 (X11; CrOS x86_64 14541.0.0) Chrome/120.0 Safari/537.36",
         ("Chrome", "Chrome OS", "desktop")),
    ],
)
def test_agents(spark, agent, wanted):
    frame = spark.createDataFrame([(agent,)], "a STRING")
    row = frame.select(
        agents.browser(F.col("a")), agents.system(F.col("a")), agents.device_type(F.col("a"))
    ).first()
    assert tuple(row) == wanted


def test_agents_and_context_stay_in_generated_code(spark):
    frame = enrich.ua_enrich(spark.range(5).selectExpr("cast(id AS string) AS agent"))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


EVENT_SCHEMA = "project_id STRING, event STRING, user_id STRING, ts TIMESTAMP_NTZ"


def some_events(spark, days):
    return spark.createDataFrame(
        [(f"p{d % 3}", "e", "u", dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=5))
         for d in days], EVENT_SCHEMA
    )


def test_replayed_batch_replaces_itself(spark, tmp_path):
    path = f"{tmp_path}/events"
    sinks.write_events(some_events(spark, range(4)), 1, path)
    sinks.write_events(some_events(spark, range(4)), 2, path)
    sinks.write_events(some_events(spark, range(4)), 1, path)
    assert tables.read_events(spark, path).count() == 8


def test_layout_expiry_and_pruning(spark, tmp_path):
    first, second = (f"{tmp_path}/{n}" for n in "ab")
    sinks.write_events(some_events(spark, range(100)), 1, first)
    sinks.compact_events(spark, first, second)
    scan = tables.scan_events(
        tables.read_events(spark, second), "p1", ["e"], "2024-02-01", "2024-02-03"
    )
    plan = scan._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: ")[1].split("]")[0]
    assert "event_date" in filters and ">=" in filters and "<=" in filters
    assert "EqualTo(project_id,p1)" in plan and "EqualTo(event,e)" in plan
    assert scan.count() == 1
    for path in (first, second):
        sinks.expire_events(spark, path, "2024-04-09 05:00:00")
        kept = tables.read_events(spark, path)
        # 2024-01-10 05:00 is exactly 90 days old and stays.
        assert kept.count() == 91
        assert kept.agg(F.min("ts")).first()[0] == dt.datetime(2024, 1, 10, 5)
        sinks.expire_events(spark, path, "2024-04-09 05:00:01")
        assert tables.read_events(spark, path).count() == 90


def test_expiry_keeps_the_rest_of_the_border_day(spark, tmp_path):
    path = f"{tmp_path}/events"
    events = some_events(spark, range(3)).unionByName(
        some_events(spark, range(3)).withColumn("ts", F.col("ts") + F.expr("interval 10 hours"))
    )
    sinks.write_events(events.where("hour(ts) = 5"), 0, path)
    sinks.write_events(events.where("hour(ts) = 15"), 1, path)
    sinks.expire_events(spark, path, "2024-04-01 12:00:00")
    kept = tables.read_events(spark, path).select("ts").orderBy("ts").collect()
    assert [(r.ts.day, r.ts.hour) for r in kept] == [(2, 15), (3, 5), (3, 15)]


def test_dead_letter_transitions(spark):
    letters = spark.createDataFrame(
        [(i, "raw-events", 0, str(i), "k", "v", {"a": "1", "b": None}, "r: x") for i in range(5)],
        "id BIGINT, original_topic STRING, original_partition INT, original_offset STRING, "
        "original_key STRING, original_value STRING, original_headers MAP<STRING,STRING>, "
        "reason STRING",
    ).withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    now = F.lit("2024-01-02").cast("timestamp_ntz")
    log = deadletter.initial_status(letters)
    log = log.unionByName(deadletter.dlq_discard(log, letters.where("id = 0"), now))
    # A letter that is not pending can be neither discarded nor retried.
    assert deadletter.dlq_discard(log, letters.where("id = 0"), now).count() == 0
    sent = deadletter.dlq_retry(letters, log, letters.where("id < 3"))
    assert {r.id for r in sent.collect()} == {1, 2}
    assert sent.first().headers == {"a": "1"}
    failed = F.when(F.col("id") == 2, F.lit("down"))
    log = log.unionByName(deadletter.retry_entries(sent, now, failed))
    state = {r.id: (r.status, r.retry_count, r.last_error) for r in deadletter.dlq_current(log).collect()}
    assert state == {
        0: ("discarded", 0, None), 1: ("retried", 1, None), 2: ("pending", 0, "down"),
        3: ("pending", 0, None), 4: ("pending", 0, None),
    }
    table = deadletter.dlq_table(letters, log)
    assert [r.id for r in deadletter.dlq_list(table, limit=2).collect()] == [4, 3]
    assert deadletter.dlq_total(table).first().total == 3


def test_long_reason_is_cut_in_the_header_only(spark):
    frame = spark.sql(
        "SELECT 't' AS topic, 0 AS partition, '7' AS offset, 'k' AS key, 'v' AS value, "
        "map('a', 'x', 'b', NULL) AS headers, repeat('r', 900) AS reason"
    )
    row = deadletter.dlq_envelope(frame, F.timestamp_millis(F.lit(5))).first()
    assert len(row.header_reason) == 500
    assert ("r" * 900) in row.value and '"timestamp":5' in row.value and '"b"' not in row.value


@pytest.mark.parametrize(
    ("lags", "wanted"),
    [([5.0] * 100, 9.9), ([60.0] * 99 + [6000.0], 100.0), ([9000.0], 5000.0)],
)
def test_quantile_from_histogram(spark, lags, wanted):
    base = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame(
        [(base, base + dt.timedelta(milliseconds=lag)) for lag in lags],
        "a TIMESTAMP_NTZ, b TIMESTAMP_NTZ",
    )
    histogram = health.lag_histogram(rows, "a", "b", health.LAG_BOUNDS["process"])
    value = health.lag_quantile(histogram, 0.99).first().value
    assert value == pytest.approx(wanted)


def test_rollup_deltas_merge_and_compact(spark, tmp_path):
    """Two batches share a minute and a user; compaction changes nothing."""
    at = F.lit("2024-01-01 00:00:10").cast("timestamp_ntz")
    rows = [("u1",), ("u2",), ("",)]
    frame = spark.createDataFrame(rows, "user_id STRING").select(
        F.lit("p").alias("project_id"), F.lit("e").alias("event"), "user_id", at.alias("ts")
    )
    first, second = f"{tmp_path}/a", f"{tmp_path}/b"
    sinks.write_rollups(rollups.sketch_rollups(frame), 0, first)
    sinks.write_rollups(rollups.sketch_rollups(frame.where("user_id <> 'u2'")), 1, first)
    late = frame.limit(1).withColumn("ts", at - F.expr("interval 5 seconds"))
    later = frame.limit(1).withColumn("ts", at + F.expr("interval 1 hour"))
    sinks.write_rollups(rollups.sketch_rollups(late.unionByName(later)), 2, first)
    sinks.compact_rollups(spark, first, second)
    for path in (first, second):
        rows = sinks.read_rollups(spark, path).orderBy("bucket").collect()
        assert [(r.bucket.hour, r["count"], r.unique_users) for r in rows] == [(0, 6, 2), (1, 1, 2)]


def test_registry_and_ranges_are_read(spark, tmp_path):
    rules = spark.createDataFrame([("p", "e", "{}", 3)], "project_id STRING, event STRING, schema STRING, version INT")
    rules.write.parquet(f"{tmp_path}/rules")
    assert tables.read_schema_registry(spark, f"{tmp_path}/rules").columns == ["project_id", "event", "schema"]
    ranges = spark.createDataFrame([(1, 9, "A", "a")], "start_ip BIGINT, end_ip BIGINT, country STRING, city STRING")
    ranges.write.parquet(f"{tmp_path}/ranges")
    ranges.coalesce(1).write.csv(f"{tmp_path}/ranges.csv", header=True)
    for name in ("ranges", "ranges.csv"):
        assert tables.read_geo_ranges(spark, f"{tmp_path}/{name}").collect() == ranges.collect()


def test_message_headers(spark):
    frame = spark.sql(
        "SELECT transform(array(array('a', '1'), array('b', NULL), array('a', '2')), "
        "p -> named_struct('key', p[0], 'value', CAST(p[1] AS BINARY))) AS h"
    )
    assert frame.select(topics.header_texts(F.col("h"))).first()[0] == {"a": "2", "b": None}


def test_ipv6_spellings(spark):
    good = ["::", "::1", "1::", "2001:DB8::a:0", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "1:2:3:4:5:6:255.0.0.1", "1::2:3:4:5:6:7", "0:0:0:0:0:0:0:0", "fe80::0001"]
    bad = ["", ":", ":::", "1", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", "12345::", "g::", "::1.2.3", "::256.1.1.1", "1.2.3.4", "1:2:3:4:5:6:7::8:9", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "::1%eth0", "1::2:3:4:5:6:7:8 ", "1.2.3.4::"]
    frame = spark.createDataFrame([(t,) for t in [*good, *bad, None]], "t string")
    got = {r["t"]: r["x"] for r in frame.select("t", address.ipv6_hex(F.col("t")).alias("x")).collect()}
    for text in [*good, *bad]:
        try:
            want = f"{int(ipaddress.IPv6Address(text)):032x}"
        except ValueError:
            want = None
        # A zone belongs to a machine, not to an address.
        assert got[text] == (None if "%" in text else want), text
    assert got[None] is None


def test_ipv6_ranges_of_any_ends(spark):
    """Ranges that are no prefixes, nested and overlapping, against looking at each of them."""
    rng = random.Random(4)
    text = lambda n: str(ipaddress.IPv6Address(n))
    base = int(ipaddress.IPv6Address("2001:db8::"))
    ranges = []
    for i in range(60):
        low = base + rng.randrange(400)
        ranges.append((low, low + rng.choice([0, 1, 5, 37, 200]), f"C{i}"))
    ranges += [(0, 2**128 - 1, "ALL")]
    asked = [base + n for n in range(-3, 420)] + [0, 2**128 - 1]
    events = spark.createDataFrame([(text(n),) for n in asked] + [(None,)], "address string")
    table = spark.createDataFrame([(text(a), text(b), c, c) for a, b, c in ranges], "start_ip string, end_ip string, country string, city string")
    v4 = spark.createDataFrame([], "start_ip long, end_ip long, country string, city string")
    got = {r["address"]: r["country"] for r in enrich.geo_enrich(events, v4, ranges6=table).collect()}
    for n in asked:
        hits = [(b - a, -a, c) for a, b, c in ranges if a <= n <= b]
        assert got[text(n)] == min(hits)[2], text(n)
    assert got[None] is None
    none = enrich.geo_enrich(events, v4, ranges6=table.where("false"))
    assert none.where("country is not null").count() == 0 and none.count() == len(asked) + 1


def test_ipv6_lookup_keeps_its_plan_small(spark, folder):
    """Parsing reads its own steps many times; none of them is copied into the plan."""
    found = REGISTERED["geo_enrich_ipv6"](spark, folder)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 200_000
