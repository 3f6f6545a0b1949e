"""The registered queries: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import clock, identity
from eventloom.functions import json_values as jv
from eventloom.operators import analytics, deadletter, enrich, health, ingest, rollups, validate
from eventloom.operators.anchors import attach_anchors
from eventloom.session import configure, materialise, scratch_path, scratch_scope
from eventloom.sources import given, sinks, topics
from eventloom.sources.tables import read_events, scan_events, scan_rollups
from eventloom.sources.tables import read_geo_ranges as read_ranges
from eventloom.sources.tables import read_schema_registry as read_registry
from eventloom.streaming import stages
from eventloom.streaming.state import MESSAGE_ID, once, with_anchors, with_quota

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the registered queries.
FROM, TO = "2024-01-08 00:00:00", "2024-01-21 23:59:59"
RAGGED_FROM, RAGGED_TO = "2024-01-05 07:13:20", "2024-01-25 18:42:59"
NOW = "2024-01-15 12:00:30"
UNIQUES_NOW = "2024-02-02 00:00:00"
STEPS = ("view", "click", "purchase")
EXPIRY_NOW = "2024-04-15 07:30:00"
LAYOUT_BEFORE = "2024-03-01"
SCHEMA_SINCE = "2024-01-16"

REGISTERED: dict[str, Query] = {}


def register(query: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(configure(spark), folder)

    REGISTERED[query.__name__] = run
    return query


def _dates_as_text(df: DataFrame) -> DataFrame:
    """Dates as texts: clients of the two engines return them as different types."""
    return df.select(
        *[
            F.col(name).cast("string") if kind == "date" else F.col(name)
            for name, kind in df.dtypes
        ]
    )


# --- scans -------------------------------------------------------------------


@register
def scan_events_range(spark, folder):
    events = given.analytics_events(spark, folder)
    return scan_events(events, names=["view", "click"], start=FROM, end=TO).select(
        "event_id", "project_id", "event", "user_id", "ts"
    )


@register
def scan_rollups_range(spark, folder):
    table = rollups.build_rollups(given.analytics_events(spark, folder))
    return scan_rollups(table, event="view", start=FROM, end=TO).select(
        "project_id", "event", "bucket", "count"
    )


@register
def write_events(spark, folder):
    """Two batches, one of them written twice, read back."""
    path = scratch_path(spark)
    events = given.analytics_events(spark, folder)
    late = F.col("event_id") % 2 == 0
    sinks.write_events(events.where(~late), 0, path)
    sinks.write_events(events.where(late), 1, path)
    sinks.write_events(events.where(late), 1, path)
    return read_events(spark, path).select("event_id", "project_id", "event", "user_id", "ts")


@register
def layout_events(spark, folder):
    """Events per day and project after the batches were rewritten, twice.

    The second batch has events of days that were moved before.
    """
    path = scratch_path(spark)
    events = given.analytics_events(spark, folder)
    late = F.col("event_id") % 4 == 0
    for batch, part in enumerate([events.where(~late), events.where(late)]):
        sinks.write_events(part, batch, f"{path}/batches")
        sinks.compact_days(spark, f"{path}/batches", f"{path}/events", LAYOUT_BEFORE)
    days = scan_events(read_events(spark, f"{path}/events"), start=FROM, end=TO)
    return days.groupBy("project_id", F.col("event_date").cast("string").alias("day")).agg(
        F.count("*").alias("events")
    )


@register
def expire_events(spark, folder):
    path = scratch_path(spark)
    sinks.write_events(given.analytics_events(spark, folder), 0, path)
    sinks.expire_events(spark, path, EXPIRY_NOW)
    return read_events(spark, path).select("event_id", "ts")


@register
def write_topic(spark, folder):
    """Events as messages of a topic, read back field by field."""
    path = scratch_path(spark)
    rows = sinks.message_rows(given.analytics_events(spark, folder), "project_id")
    topics.to_files(path)(rows.withColumn("headers", F.create_map().cast(stages.HEADERS)), 0)
    messages = spark.read.schema(topics.FILE_SCHEMA).parquet(f"{path}/batch=0")
    part = lambda name: F.get_json_object("value", f"$.{name}").alias(name)
    return messages.select(
        "key", part("event_id"), part("event"), part("user_id"), part("properties")
    )


# --- rollups -----------------------------------------------------------------


@register
def rolling_counts(spark, folder):
    return rollups.rolling_counts(given.analytics_events(spark, folder))


@register
def daily_uniques(spark, folder):
    return _dates_as_text(rollups.daily_uniques(given.analytics_events(spark, folder)))


@register
def build_rollups(spark, folder):
    return rollups.build_rollups(given.analytics_events(spark, folder))


@register
def upsert_rollups(spark, folder):
    """Rollups of three batches that share buckets, merged on read."""
    events = given.analytics_events(spark, folder)
    deltas = [
        rollups.build_rollups(events.where(F.col("device_type") == device)).drop(
            "unique_users_bucket"
        )
        for device in ("desktop", "mobile", "tablet")
    ]
    merged = deltas[0]
    for delta in deltas[1:]:
        merged = merged.unionByName(delta)
    return rollups.merge_rollups(merged)


@register
def publish_live(spark, folder):
    messages = rollups.live_messages(rollups.build_rollups(given.analytics_events(spark, folder)))
    body = F.from_json(
        "value",
        "type STRING, projectId STRING, event STRING, count_1m BIGINT, active_users BIGINT, "
        "timestamp BIGINT",
    )
    return messages.select("project_id", body.alias("m")).select(
        "project_id", "m.type", F.col("m.projectId").alias("message_project"), "m.event",
        "m.count_1m", "m.active_users", F.col("m.timestamp").alias("bucket_ms"),
    )


@register
def live_counts(spark, folder):
    """Counts of the last clock minute that holds an event."""
    return rollups.live_counts(given.analytics_events(spark, folder))


@register
def hll_uniques(spark, folder):
    """Users per project, and whether sketches merged over days and events come near them."""
    return _close(given.analytics_events(spark, folder), ["project_id"])


@register
def hll_uniques_error(spark, folder):
    """Users per project and event, and whether sketches merged over days come near them."""
    return _close(given.analytics_events(spark, folder), ["project_id", "event"])


def _close(events: DataFrame, keys: list[str]) -> DataFrame:
    """Exact users, and whether the merged sketches come within 5 % of them."""
    named = events.where(F.col("user_id") != "")
    exact = named.groupBy(*keys).agg(F.count_distinct("user_id").alias("users"))
    merged = rollups.merge_uniques(rollups.daily_sketches(events), keys)
    gap = F.abs(F.col("unique_users") - F.col("users"))
    return exact.join(merged, keys).select(*keys, "users", (gap <= F.col("users") / 20).alias("close"))


# --- analytical queries ------------------------------------------------------


def _metrics(spark, folder, granularity):
    table = rollups.build_rollups(given.analytics_events(spark, folder))
    return analytics.metrics(table, granularity=granularity)


@register
def metrics_minute(spark, folder):
    return _metrics(spark, folder, "minute")


@register
def metrics_hour(spark, folder):
    return _metrics(spark, folder, "hour")


@register
def metrics_day(spark, folder):
    return _metrics(spark, folder, "day")


@register
def metrics_grains(spark, folder):
    """`metrics` of a ragged range from stored grains; some days were written twice."""
    path = scratch_path(spark)
    table = rollups.build_rollups(given.analytics_events(spark, folder))
    sinks.write_grains(table.where(F.dayofmonth("bucket") > 8), path)
    sinks.write_grains(table.where(F.dayofmonth("bucket") <= 12), path)
    grains = sinks.read_grains(spark, path)
    return analytics.metrics_from_grains(grains, start=RAGGED_FROM, end=RAGGED_TO, granularity="day")


@register
def metrics_project_event(spark, folder):
    table = rollups.build_rollups(given.analytics_events(spark, folder))
    return analytics.metrics(table, "proj_1", "view", FROM, TO, "hour")


@register
def metrics_unique_exact(spark, folder):
    return analytics.metrics_unique_exact(
        given.analytics_events(spark, folder), granularity="day"
    )


@register
def metrics_unique(spark, folder):
    """Exact users per day, and whether merged rollup sketches come within 5 % of them."""
    events = given.analytics_events(spark, folder)
    merged = analytics.metrics_unique(rollups.sketch_rollups(events), granularity="day")
    exact = analytics.metrics_unique_exact(events, granularity="day")
    keys = ["project_id", "event", "bucket", "count"]
    gap = F.abs(F.col("unique_users") - F.col("users"))
    return exact.withColumnRenamed("unique_users", "users").join(merged, keys).select(
        *keys, "users", (gap <= F.col("users") / 20).alias("close")
    )


@register
def funnel_1h(spark, folder):
    return analytics.funnel(given.analytics_events(spark, folder), STEPS, "1h")


@register
def funnel_1d(spark, folder):
    return analytics.funnel(given.analytics_events(spark, folder), STEPS, "1d")


@register
def funnel_same_event(spark, folder):
    steps = ("view", "view", "signup", "view")
    return analytics.funnel(given.analytics_events(spark, folder), steps, "7d")


@register
def funnel_from_to(spark, folder):
    events = given.analytics_events(spark, folder)
    return analytics.funnel(events, STEPS, "2h", start=FROM, end=TO)


@register
def funnel_project(spark, folder):
    events = given.analytics_events(spark, folder)
    return analytics.funnel(events, STEPS, "30m", project="proj_2")


@register
def retention(spark, folder):
    events = given.analytics_events(spark, folder)
    return _dates_as_text(analytics.retention(events, "signup", "purchase", 8))


@register
def retention_with_size(spark, folder):
    events = given.analytics_events(spark, folder)
    return _dates_as_text(
        analytics.retention(
            events, "signup", "purchase", 4, start=FROM, end=TO, with_size=True
        )
    )


def _user_days(spark, folder):
    """Days of users, kept by three batches of which one comes twice."""
    path = scratch_path(spark)
    events = given.analytics_events(spark, folder)
    for batch in (0, 1, 2, 1):
        part = events.where(F.col("event_id") % 3 == batch)
        sinks.write_batch(analytics.user_days(part), batch, path)
    return spark.read.parquet(path)


@register
def retention_bitmaps(spark, folder):
    """The same as `retention`, from the days kept per user."""
    return _dates_as_text(analytics.retention_from_days(_user_days(spark, folder), "signup", "purchase", 8))


@register
def retention_bitmaps_range(spark, folder):
    """The same as `retention_with_size`, from the days kept per user."""
    days = _user_days(spark, folder)
    return _dates_as_text(
        analytics.retention_from_days(
            days, "signup", "purchase", 4, first_day=FROM[:10], last_day=TO[:10], with_size=True
        )
    )


@register
def retention_long(spark, folder):
    events = given.analytics_events(spark, folder)
    return _dates_as_text(analytics.retention_long(events, "view", "view"))


@register
def user_profiles(spark, folder):
    return analytics.user_profiles(given.analytics_events(spark, folder, with_location=True))


@register
def users_page(spark, folder):
    events = given.analytics_events(spark, folder, with_location=True)
    return analytics.users(events, limit=100, offset=20)


@register
def users_filtered(spark, folder):
    events = given.analytics_events(spark, folder, with_location=True)
    return analytics.user_profiles(events, filter_text="browser:Firefox")


@register
def parse_window(spark, folder):
    """Window texts built from the events, read as seconds."""
    events = given.table(spark, folder, "events")
    unit = given.pick(F.col("event_id") % 5, ["s", "m", "h", "d", "w"])
    text = F.concat((F.col("event_id") % 13).cast("string"), unit)
    return events.select("event_id", clock.parse_window_column(text).alias("seconds"))


@register
def tenant_scope(spark, folder):
    events = given.analytics_events(spark, folder)
    scoped = analytics.tenant_scope(events, given.projects(spark, folder), "org_1")
    return scoped.groupBy("project_id").agg(F.count("*").alias("events"))


# --- ingest ------------------------------------------------------------------


@register
def attach_project(spark, folder):
    matched = ingest.attach_project(
        given.requests(spark, folder),
        given.api_keys(spark, folder),
        given.projects(spark, folder),
        "arrival_ts",
    )
    return matched.select("event_id", "project_id", "org_id")


@register
def reject_keys(spark, folder):
    refused = ingest.reject_keys(
        given.requests(spark, folder),
        given.api_keys(spark, folder),
        given.projects(spark, folder),
        "arrival_ts",
    )
    return refused.select("event_id", "api_key")


@register
def rate_limit(spark, folder):
    """An hourly quota of three requests per key and one of 40 a day."""
    requests = given.requests(spark, folder)
    checked = [
        ingest.rate_limit(requests, tie_cols=["event_id"], limit=limit, window_seconds=span)
        .withColumn("window_seconds", F.lit(span))
        for limit, span in ((3, 3600), (40, 86400))
    ]
    return checked[0].unionByName(checked[1]).select(
        "event_id", "window_seconds", "quota_key", "allowed", "remaining"
    )


@register
def rate_limit_large(spark, folder):
    """A quota of more than a thousand requests, for the few keys there are."""
    requests = given.requests(spark, folder)
    checked = ingest.rate_limit(
        requests, tie_cols=["event_id"], limit=1500, window_seconds=30 * 86400
    )
    return checked.withColumn("window_seconds", F.lit(30 * 86400)).select(
        "event_id", "window_seconds", "quota_key", "allowed", "remaining"
    )


@register
def explode_batch(spark, folder):
    items = ingest.explode_batch(given.raw_bodies(spark, folder))
    return items.select(
        "event_id", "pos", jv.kind(F.col("item")).alias("kind"),
        jv.text(jv.field(F.col("item"), "projectId")).alias("project_id"),
    )


def _with_headers(spark, folder):
    events = given.analytics_events(spark, folder)
    own = F.when(F.col("event_id") % 3 == 0, F.lit('{"ip":"192.0.2.1","k":1}')).when(
        F.col("event_id") % 3 == 1, F.lit('{"clientIp":"192.0.2.2"}')
    )
    header = F.when(
        F.col("event_id") % 4 != 0,
        F.concat(F.lit("10.0.0."), (F.col("event_id") % 250).cast("string")),
    )
    return events.select(
        "event_id", F.coalesce(own, F.col("properties")).alias("properties"),
        header.alias("header_ip"),
    )


def _client_ip(spark, folder, at_edge):
    seen = ingest.inject_client_ip(
        _with_headers(spark, folder), "properties", "header_ip", at_edge
    )
    return seen.select(
        "event_id",
        F.get_json_object("properties", "$.ip").alias("ip"),
        F.get_json_object("properties", "$.clientIp").alias("client_ip"),
        F.get_json_object("properties", "$.k").alias("k"),
    )


@register
def inject_client_ip(spark, folder):
    return _client_ip(spark, folder, at_edge=False)


@register
def inject_client_ip_edge(spark, folder):
    return _client_ip(spark, folder, at_edge=True)


@register
def assign_trace_id(spark, folder):
    arrivals = given.arrivals(spark, folder)
    return ingest.assign_trace_id(arrivals, "event_id", "seq").select(
        "event_id", "seq", "trace_id"
    )


@register
def dedup_key(spark, folder):
    return ingest.with_dedup_key(given.arrivals(spark, folder)).select(
        "event_id", "seq", "dedup_key"
    )


@register
def dedup_events(spark, folder):
    keyed = ingest.with_dedup_key(given.arrivals(spark, folder))
    return ingest.dedup_events(keyed).select("event_id", "seq", "status")


@register
def ingest_status(spark, folder):
    return ingest.ingest_status(given.raw_bodies(spark, folder))


# --- validation --------------------------------------------------------------


def _messages(spark, folder):
    bodies = given.raw_bodies(spark, folder)
    return bodies.select("event_id", F.col("body").alias("value"))


@register
def parse_event(spark, folder):
    return validate.parse_event(_messages(spark, folder)).select("event_id", "is_malformed")


@register
def validate_envelope(spark, folder):
    checked = validate.validate_envelope(validate.parse_event(_messages(spark, folder)))
    texts = F.transform(
        "issues",
        lambda i: F.concat_ws(":", F.array_join(i["path"], "."), i["message"]),
    )
    return checked.select("event_id", F.array_join(texts, "|").alias("issues"))


@register
def strip_unknown(spark, folder):
    parsed = validate.parse_event(_messages(spark, folder))
    return validate.strip_unknown(parsed, "raw", "event_id").select(
        "event_id", "event", "project_id", F.col("ts_ms").cast("string"), "user_id"
    )


@register
def validate_properties(spark, folder):
    events = given.analytics_events(spark, folder).withColumn(
        "properties", F.try_parse_json("properties")
    )
    checked = validate.validate_properties(events, given.property_rules(spark, folder))
    return checked.select("event_id", F.array_join("errors", "|").alias("errors"))


@register
def upsert_schema(spark, folder):
    """Changes of the second half merged into the registry of the first half."""
    changes = given.schema_changes(spark, folder)
    new = F.col("changed_at") >= F.lit(SCHEMA_SINCE).cast("timestamp_ntz")
    registry = validate.upsert_schema(changes.where(~new))
    return validate.upsert_schema(changes.where(new), registry)


@register
def read_schema_registry(spark, folder):
    path = scratch_path(spark)
    given.property_rules(spark, folder).write.parquet(path)
    return read_registry(spark, path)


@register
def read_geo_ranges(spark, folder):
    path = scratch_path(spark)
    given.geo_ranges(spark, folder).write.parquet(path)
    return read_ranges(spark, path)


@register
def route_valid_rejected(spark, folder):
    judged = validate.judge(_messages(spark, folder), given.property_rules(spark, folder))
    # Both sides are read; messages are parsed and judged once.
    good, bad = validate.route_valid_rejected(materialise(judged.select("event_id", "reason")))
    return good.select("event_id", F.lit("valid").alias("route")).unionByName(
        bad.select("event_id", F.split("reason", ":")[0].alias("route"))
    )


# --- enrichment --------------------------------------------------------------


def _tracked(spark, folder):
    return enrich.extract_context(
        given.tracked_properties(spark, folder), F.col("ip"), F.col("client_ip"), F.col("user_agent")
    )


@register
def extract_context(spark, folder):
    return _tracked(spark, folder).select("event_id", "address", "agent")


@register
def geo_enrich(spark, folder):
    located = enrich.geo_enrich(_tracked(spark, folder), given.geo_ranges(spark, folder))
    return located.select("event_id", "country", "city")


@register
def geo_enrich_many_ranges(spark, folder):
    """The same lookup on the path for range tables of any size."""
    located = enrich.geo_enrich(
        _tracked(spark, folder), given.geo_ranges(spark, folder), small_ranges=0
    )
    return located.select("event_id", "country", "city")


def _overlapping(spark, folder):
    """The blocks of the nations, a block inside each, and one around them all."""
    blocks = given.geo_ranges(spark, folder)
    size = 1 << 16
    inner = blocks.select(
        (F.col("start_ip") + size // 4).alias("start_ip"),
        (F.col("start_ip") + size // 2 - 1).alias("end_ip"),
        "country",
        F.lit("inner").alias("city"),
    )
    outer = blocks.agg(
        F.min("start_ip").alias("start_ip"), (F.max("start_ip") + size - 1).alias("end_ip")
    ).select("start_ip", "end_ip", F.lit("ANY").alias("country"), F.lit("outer").alias("city"))
    return blocks.unionByName(inner).unionByName(outer)


@register
def geo_enrich_overlap(spark, folder):
    located = enrich.geo_enrich(_tracked(spark, folder), _overlapping(spark, folder))
    return located.select("event_id", "country", "city")


@register
def geo_enrich_overlap_many(spark, folder):
    """The same on the path for range tables of any size."""
    located = enrich.geo_enrich(
        _tracked(spark, folder), _overlapping(spark, folder), small_ranges=0
    )
    return located.select("event_id", "country", "city")


@register
def geo_enrich_ipv6(spark, folder):
    """IPv6 addresses in several spellings, IPv4 ones in IPv6 form, and plain ones."""
    located = enrich.geo_enrich(
        given.ipv6_events(spark, folder),
        given.geo_ranges(spark, folder),
        ranges6=given.geo_ranges6(spark, folder),
    )
    return located.select("event_id", "country", "city")


@register
def ua_enrich(spark, folder):
    return enrich.ua_enrich(_tracked(spark, folder)).select(
        "event_id", "browser", "os", "device_type"
    )


@register
def fixed_ttl_anchor(spark, folder):
    events = given.analytics_events(spark, folder)
    anchored = attach_anchors(events, ["project_id", "user_id"], "ts", 6 * 3600)
    return anchored.select("event_id", clock.from_micros(F.col("anchor_us")).alias("anchor"))


@register
def fixed_ttl_anchor_tree(spark, folder):
    """Longer anchors, keys and islands of any size on their own paths."""
    events = given.analytics_events(spark, folder)
    anchored = attach_anchors(
        events, ["project_id", "user_id"], "ts", 2 * 86400, light_events=20, fold_limit=40, fan_in=4
    )
    return anchored.select("event_id", clock.from_micros(F.col("anchor_us")).alias("anchor"))


@register
def sessionize(spark, folder):
    sessions = enrich.sessionize(given.analytics_events(spark, folder))
    return sessions.select("event_id", "session_id")


@register
def enrich_project(spark, folder):
    tracked = given.tracked_properties(spark, folder)
    properties = F.to_variant_object(
        F.struct("ip", F.col("client_ip").alias("clientIp"), F.col("user_agent").alias("userAgent"))
    )
    enriched = enrich.enrich_project(
        tracked.withColumn("properties", properties), given.geo_ranges(spark, folder)
    )
    return enriched.select(
        "event_id", "country", "city", "browser", "os", "device_type", "session_id"
    )


@register
def normalise_event_row(spark, folder):
    """Stored rows of events whose optional fields are partly missing."""
    third = F.col("event_id") % 3 == 0
    events = given.analytics_events(spark, folder, with_location=True).withColumns(
        {
            "country": F.when(~third, F.col("country")),
            "properties": F.when(~third, F.col("properties")),
            "session_id": F.when(third, identity.trace_id(F.col("event_id"))),
            "ts_ms": clock.epoch_ms(F.col("ts")),
        }
    )
    return enrich.normalise_event_row(events, "event_id")


# --- dead letters ------------------------------------------------------------


@register
def dlq_envelope(spark, folder):
    letters = given.dead_letters(spark, folder).select(
        F.col("original_topic").alias("topic"),
        F.col("original_partition").alias("partition"),
        F.col("original_offset").alias("offset"),
        F.col("original_key").alias("key"),
        F.col("original_value").alias("value"),
        F.col("original_headers").alias("headers"),
        F.repeat(F.concat("reason", F.lit(";")), 30).alias("reason"),
        "created_at",
    )
    return _envelope_fields(deadletter.dlq_envelope(letters, F.col("created_at")))


def _envelope_fields(messages: DataFrame) -> DataFrame:
    part = lambda path: F.get_json_object("value", path)
    return messages.select(
        "key",
        "header_topic",
        "header_reason",
        part("$.originalTopic").alias("topic"),
        part("$.originalPartition").cast("int").alias("partition"),
        part("$.originalOffset").alias("offset"),
        part("$.originalValue").alias("original_value"),
        part("$.originalHeaders.traceId").alias("trace_id"),
        F.length(part("$.reason")).cast("bigint").alias("reason_length"),
        part("$.timestamp").cast("bigint").alias("at_ms"),
    )


@register
def dlq_store(spark, folder):
    letters = given.dead_letters(spark, folder)
    broken = F.col("id") % 10 == 0
    messages = letters.select(
        "created_at",
        F.to_json(
            F.struct(
                F.when(~broken, F.col("original_topic")).alias("originalTopic"),
                F.col("original_partition").alias("originalPartition"),
                F.col("original_offset").alias("originalOffset"),
                F.col("original_key").alias("originalKey"),
                F.col("original_value").alias("originalValue"),
                F.col("original_headers").alias("originalHeaders"),
                "reason",
                clock.epoch_ms(F.col("created_at")).alias("timestamp"),
            )
        ).alias("value"),
    )
    stored = deadletter.dlq_store(messages, F.lit(NOW).cast("timestamp_ntz"))
    first = deadletter.initial_status(stored).select("id", "status")
    return stored.join(first, "id").select(
        "id", "original_topic", "original_partition", "original_key", "reason", "status"
    )


def _dlq(spark, folder):
    return deadletter.dlq_table(
        given.dead_letters(spark, folder), given.dead_letter_log(spark, folder)
    )


@register
def dlq_current(spark, folder):
    return deadletter.dlq_current(given.dead_letter_log(spark, folder)).select(
        "id", "status", "retry_count", "last_error", "updated_at"
    )


@register
def dlq_list(spark, folder):
    return deadletter.dlq_list(_dlq(spark, folder), "pending", limit=100, offset=10)


@register
def dlq_total(spark, folder):
    return deadletter.dlq_total(_dlq(spark, folder), "pending")


@register
def dlq_get(spark, folder):
    """The full row of the newest dead letter."""
    table = _dlq(spark, folder)
    newest = table.agg(F.max("id").alias("id"))
    return table.join(newest, "id", "left_semi").select(
        "id", "original_topic", "original_offset", "original_value", "reason", "status",
        "retry_count", "last_error", "created_at", "updated_at",
    )


@register
def dlq_retry(spark, folder):
    """State of every dead letter after all of them were asked to be retried."""
    letters = given.dead_letters(spark, folder)
    log = given.dead_letter_log(spark, folder)
    sent = deadletter.dlq_retry(letters, log, letters)
    error = F.when(F.col("topic") == "enriched-events", F.lit("broker down"))
    entries = deadletter.retry_entries(sent, F.lit(NOW).cast("timestamp_ntz"), error)
    return deadletter.dlq_current(log.unionByName(entries)).select(
        "id", "status", "retry_count", "last_error"
    )


@register
def dlq_retry_messages(spark, folder):
    letters = given.dead_letters(spark, folder)
    sent = deadletter.dlq_retry(letters, given.dead_letter_log(spark, folder), letters)
    return sent.select("id", "topic", "key", "value", F.col("headers")["traceId"].alias("trace_id"))


@register
def dlq_discard(spark, folder):
    """State after the dead letters of one topic were asked to be discarded."""
    letters = given.dead_letters(spark, folder)
    log = given.dead_letter_log(spark, folder)
    chosen = letters.where(F.col("original_topic") == "raw-events")
    entries = deadletter.dlq_discard(log, chosen, F.lit(NOW).cast("timestamp_ntz"))
    return deadletter.dlq_current(log.unionByName(entries)).select("id", "status", "updated_at")


@register
def dlq_reasons(spark, folder):
    return deadletter.dlq_reasons(_dlq(spark, folder))


# --- health ------------------------------------------------------------------


@register
def stage_counts(spark, folder):
    return health.stage_counts(given.stage_events(spark, folder))


@register
def stage_rates(spark, folder):
    rates = health.stage_rates(
        health.stage_counts(given.stage_events(spark, folder)), span_seconds=300
    )
    return rates.select("stage", "bucket", F.round("per_second", 6).alias("per_second"))


@register
def lag_histogram(spark, folder):
    rows = given.timed_rows(spark, folder)
    return health.lag_histogram(
        rows, "started_at", "finished_at", health.LAG_BOUNDS["process"], ["stage"]
    )


@register
def lag_p99(spark, folder):
    rows = given.timed_rows(spark, folder)
    histogram = health.lag_histogram(
        rows, "started_at", "finished_at", health.LAG_BOUNDS["process"], ["stage"]
    )
    return health.lag_quantile(histogram, 0.99, ["stage"]).select(
        "stage", F.round("value", 6).alias("value")
    )


# --- streams -----------------------------------------------------------------
#
# Each reads the whole `events` table as a stream, runs until it is used up and
# returns what the sink holds.

ONCE = {"availableNow": True}
MESSAGE_TOPIC = topics.RAW


def _drained(stream: DataFrame, path: str, *columns: str) -> None:
    """Write what a stream has to `path`, batch by batch, until it is used up."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        sinks.write_batch(batch.select(*columns), batch_id, f"{path}/rows")

    query = (
        stream.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**ONCE)
        .start()
    )
    query.awaitTermination()


def _anchored(stream: DataFrame, keys, ts_col, ttl, delay, tie_col, *columns) -> DataFrame:
    """Run a stream through the anchor state and read the result."""
    path = scratch_path(stream.sparkSession)
    _drained(with_anchors(stream, keys, ts_col, ttl, delay, tie_col), path, *columns)
    return stream.sparkSession.read.parquet(f"{path}/rows").drop("batch_id")


@register
def stream_dedup(spark, folder):
    keyed = ingest.with_dedup_key(given.arrivals(spark, folder, stream=True))
    marked = _anchored(
        keyed, ["dedup_key"], "arrival_ts", ingest.DEDUP_SECONDS, stages.DEDUP_DELAY_SECONDS,
        "seq", "event_id", "seq", "sets_anchor",
    )
    return marked.where("sets_anchor").select("event_id", "seq")


@register
def stream_sessions(spark, folder):
    events = given.analytics_events(spark, folder, stream=True).withColumn(
        "user_id", F.nullif("user_id", F.lit(""))
    )
    anchored = _anchored(
        events, ["project_id", "user_id"], "ts", enrich.SESSION_SECONDS,
        stages.SESSION_DELAY_SECONDS, "event_id", "event_id", "project_id", "user_id", "anchor_us",
    )
    session = identity.session_id(F.col("project_id"), F.col("user_id"), F.col("anchor_us"))
    return anchored.select(
        "event_id", F.when(F.col("anchor_us").isNotNull(), session).alias("session_id")
    )


# A daily quota, with requests that come in three parts, cut in the middle of days.
QUOTA_CUTS = ("2024-01-10 12:00:00", "2024-01-20 07:30:00")


@register
def stream_quota(spark, folder):
    """`rate_limit` of 40 a day, decided batch by batch; a query is started for each."""
    path = scratch_path(spark)
    requests = given.requests(spark, folder)
    at = F.col("arrival_ts")
    low, high = (F.lit(cut).cast(requests.schema["arrival_ts"].dataType) for cut in QUOTA_CUTS)
    for part in (at < low, (at >= low) & (at < high), at >= high):
        requests.where(part).write.mode("append").parquet(f"{path}/requests")
        stream = spark.readStream.schema(requests.schema).parquet(f"{path}/requests")
        checked = with_quota(stream, "api_key", "arrival_ts", ["event_id"], 40, 86400, 3600)
        _drained(checked, path, "event_id", "quota_key", "allowed", "remaining")
    return spark.read.parquet(f"{path}/rows").drop("batch_id")


@register
def stream_rollups(spark, folder):
    """Rollup deltas of micro-batches, merged when read."""
    path = scratch_path(spark)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        sinks.write_rollups(rollups.sketch_rollups(batch), batch_id, f"{path}/rollups")

    query = (
        given.analytics_events(spark, folder, stream=True)
        .writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**ONCE)
        .start()
    )
    query.awaitTermination()
    return sinks.read_rollups(spark, f"{path}/rollups").select(
        "project_id", "event", "bucket", "count"
    )


# The stages themselves run over message files, in three batches. Every fifth event
# comes late, in the last one.


def _batches(messages: DataFrame, ts: str = "ts") -> list[DataFrame]:
    """Messages in three parts by day, late ones in the last."""
    late = F.col("event_id") % 5 == 0
    day = F.dayofmonth(ts)
    return [
        messages.where(~late & (day <= 10)),
        messages.where(~late & (day > 10) & (day <= 20)),
        messages.where(late | (day > 20)),
    ]


def _feed(spark: SparkSession, parts: list[DataFrame], topic: str, start) -> None:
    """Add each part to a topic and run what `start` makes of the topic until it is used up.

    So a part is a batch, of as many files as Spark writes, and each has a query of its own.
    """
    path = scratch_path(spark)
    sink = topics.to_files(path)
    for number, part in enumerate(parts):
        sink(part.select("key", "value", "headers", "arrival_ts"), number)
        start(topics.read_files(spark, path, topic)).awaitTermination()


def _messages_of(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.schema(topics.FILE_SCHEMA).option("recursiveFileLookup", "true")
    return reader.parquet(path)


def _field(name: str):
    return F.get_json_object("value", f"$.{name}")


def _body_messages(spark, folder):
    bodies = given.raw_bodies(spark, folder)
    return bodies.select(
        "event_id",
        F.col("message_key").alias("key"),
        F.col("body").alias("value"),
        F.create_map(F.lit("traceId"), F.concat(F.lit("t"), F.col("event_id").cast("string"))).alias(
            "headers"
        ),
        F.col("arrival_ts").cast("timestamp").alias("arrival_ts"),
    )


@register
def stream_ingest(spark, folder):
    """Accepted events; every tenth body is sent a second time within the minute."""
    path = scratch_path(spark)
    once = _body_messages(spark, folder)
    again = once.where(F.col("event_id") % 10 == 0).withColumn(
        "arrival_ts", F.col("arrival_ts") + F.expr("interval 30 seconds")
    )
    _feed(
        spark, _batches(once.unionByName(again), "arrival_ts"), MESSAGE_TOPIC,
        lambda topic: stages.start_ingest(
            topic, topics.to_files(f"{path}/raw"), f"{path}/checkpoint", ONCE
        ),
    )
    return _messages_of(spark, f"{path}/raw").select(
        _field("projectId").alias("project_id"),
        _field("event").alias("event"),
        _field("userId").alias("user_id"),
        _field("timestamp").cast("bigint").alias("ms"),
    )


@register
def stream_enrichment(spark, folder):
    """What became of every message: event and session, or the reason it was refused."""
    path = scratch_path(spark)
    messages = _body_messages(spark, folder)
    # In order of arrival: sessions go by arrival.
    day = F.dayofmonth("arrival_ts")
    parts = [messages.where((day > low) & (day <= low + 10)) for low in (0, 10, 20)]
    parts[2] = messages.where(day > 20)
    rules, ranges = given.property_rules(spark, folder), given.geo_ranges(spark, folder)
    _feed(
        spark, parts, MESSAGE_TOPIC,
        lambda topic: stages.start_enrichment(
            topic, rules, ranges, topics.to_files(f"{path}/enriched"),
            topics.to_files(f"{path}/dead"), f"{path}/checkpoint", ONCE,
        ),
    )
    number = F.substring(_field("traceId"), 2, 20).cast("bigint").alias("event_id")
    good = _messages_of(spark, f"{path}/enriched").select(
        number,
        _field("event").alias("outcome"),
        _field("sessionId").alias("session_id"),
        F.col("headers")["traceId"].alias("trace_id"),
    )
    bad = _messages_of(spark, f"{path}/dead").select(
        F.substring(_field("originalHeaders.traceId"), 2, 20).cast("bigint").alias("event_id"),
        F.split(_field("reason"), ":")[0].alias("outcome"),
        F.lit(None).cast("string").alias("session_id"),
        F.lit(None).cast("string").alias("trace_id"),
    )
    return good.unionByName(bad)


def _enriched_messages(spark, folder):
    events = given.analytics_events(spark, folder, with_location=True)
    value = F.struct(
        "event",
        F.col("project_id").alias("projectId"),
        F.parse_json("properties").alias("properties"),
        clock.epoch_ms(F.col("ts")).alias("timestamp"),
        F.col("user_id").alias("userId"),
        "country",
        "city",
        F.col("device_type").alias("deviceType"),
        "browser",
        "os",
    )
    return events.select(
        "event_id",
        "ts",
        F.col("project_id").alias("key"),
        F.to_json(value).alias("value"),
        F.create_map().cast(stages.HEADERS).alias("headers"),
        F.col("ts").cast("timestamp").alias("arrival_ts"),
    )


@register
def stream_storage(spark, folder):
    """Stored events of a topic with late messages."""
    path = scratch_path(spark)
    _feed(
        spark, _batches(_enriched_messages(spark, folder)), topics.ENRICHED,
        lambda topic: stages.start_storage(
            topic, f"{path}/events", f"{path}/rollups", topics.to_files(f"{path}/dead"),
            f"{path}/checkpoint", ONCE,
        ),
    )
    return read_events(spark, f"{path}/events").select(
        "project_id", "event", "user_id", "country", "city", "device_type", "browser", "os",
        clock.epoch_ms(F.col("ts")).alias("ms"),
    )


@register
def stream_replayed_topic(spark, folder):
    """Stored events of a topic whose second batch was published twice."""
    path = scratch_path(spark)
    own = identity.message_id("events", F.col("event_id"))
    messages = _enriched_messages(spark, folder).withColumn(
        "headers", F.create_map(F.lit(MESSAGE_ID), own)
    )
    parts = _batches(messages)
    _feed(
        spark, [parts[0], parts[1], parts[1], parts[2]], topics.ENRICHED,
        lambda topic: stages.start_storage(
            once(topic), f"{path}/events", f"{path}/rollups", topics.to_files(f"{path}/dead"),
            f"{path}/checkpoint", ONCE,
        ),
    )
    return read_events(spark, f"{path}/events").select(
        "project_id", "event", "user_id", clock.epoch_ms(F.col("ts")).alias("ms")
    )


@register
def stream_live_feed(spark, folder):
    """The last word of the live feed on each day: events, and users of the day."""
    path = scratch_path(spark)
    _feed(
        spark, _batches(_enriched_messages(spark, folder)), topics.ENRICHED,
        lambda topic: stages.start_live_feed(
            topic, topics.to_files(f"{path}/live"), f"{path}/rollups", f"{path}/checkpoint", ONCE
        ),
    )
    minutes = (
        _messages_of(spark, f"{path}/live")
        .select(
            F.col("key").alias("project_id"),
            _field("event").alias("event"),
            _field("timestamp").cast("bigint").alias("ms"),
            _field("count_1m").cast("bigint").alias("n"),
            _field("active_users").cast("bigint").alias("users"),
        )
        .groupBy("project_id", "event", "ms")
        .agg(F.max("n").alias("n"), F.max("users").alias("users"))
    )
    day = F.timestamp_millis("ms").cast("date").cast("string").alias("day")
    return minutes.groupBy("project_id", "event", day).agg(
        F.sum("n").alias("events"), F.max("users").alias("users")
    )


@register
def stream_daily_uniques(spark, folder):
    """Users of the days that are alive: some updates come three days later, some twelve.

    The latter begin anew. What was kept is made small once in between.
    """
    path = scratch_path(spark)
    messages = _enriched_messages(spark, folder)
    days = F.when(F.col("event_id") % 7 == 0, 12).when(F.col("event_id") % 5 == 0, 3).otherwise(0)
    later = messages.withColumn("arrival_ts", F.col("arrival_ts") + F.make_dt_interval(days=days))
    _feed(
        spark, _batches(later), topics.ENRICHED,
        lambda topic: stages.start_uniques(topic, f"{path}/kept", f"{path}/checkpoint", ONCE),
    )
    sinks.compact_uniques(spark, f"{path}/kept", f"{path}/small", UNIQUES_NOW)
    live = rollups.live_uniques(spark.read.parquet(f"{path}/small").drop("batch_id"), UNIQUES_NOW)
    return _dates_as_text(rollups.merge_uniques(live, [*rollups.KEY, "day"]))


def _closing(spark, folder):
    path = scratch_path(spark)
    _feed(
        spark, _batches(_enriched_messages(spark, folder)), topics.ENRICHED,
        lambda topic: stages.start_closing(
            topic, f"{path}/log", f"{path}/rollups", f"{path}/checkpoint", ONCE
        ),
    )
    return spark.read.parquet(f"{path}/log/rows")


@register
def stream_closing_log(spark, folder):
    """Minutes as they closed, and what late events added to them."""
    return _closing(spark, folder).select(
        "project_id", "event", "bucket", "kind", "count", F.col("batch_id").cast("bigint").alias("batch")
    )


@register
def stream_closed_rollups(spark, folder):
    """Closed minutes with all corrections."""
    return rollups.finalise_rollups(_closing(spark, folder)).select(
        "project_id", "event", "bucket", "count", F.col("corrections").cast("bigint").alias("corrections")
    )


@register
def stream_dead_letters(spark, folder):
    """Dead letters stored from their topic, with the status they begin in."""
    path = scratch_path(spark)
    letters = given.dead_letters(spark, folder)
    value = F.struct(
        F.col("original_topic").alias("originalTopic"),
        F.col("original_partition").alias("originalPartition"),
        F.col("original_offset").alias("originalOffset"),
        F.col("original_key").alias("originalKey"),
        F.col("original_value").alias("originalValue"),
        F.col("original_headers").alias("originalHeaders"),
        "reason",
        clock.epoch_ms(F.col("created_at")).alias("timestamp"),
    )
    messages = letters.select(
        F.col("id").alias("event_id"),
        F.col("original_key").alias("key"),
        F.to_json(value).alias("value"),
        F.create_map().cast(stages.HEADERS).alias("headers"),
        F.col("created_at").cast("timestamp").alias("arrival_ts"),
    )
    _feed(
        spark, _batches(messages, "arrival_ts"), topics.DEAD_LETTER,
        lambda topic: stages.start_dead_letters(
            topic, f"{path}/letters", f"{path}/log", f"{path}/checkpoint", ONCE
        ),
    )
    state = spark.read.parquet(f"{path}/log").select("id", "status")
    return spark.read.parquet(f"{path}/letters").join(state, "id").select(
        "id", "original_topic", "original_partition", "original_key", "reason", "status"
    )
