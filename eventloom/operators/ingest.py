"""Arrival of events: keys, quota, batches, addresses, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import clock, identity
from eventloom.functions import json_values as jv
from eventloom.operators.anchors import attach_anchors
from eventloom.operators.validate import with_envelope_issues
from eventloom.session import materialise

# Marker and length of the readable part of an API key.
KEY_MARKER = "pk_live_"
KEY_PREFIX_LENGTH = 16

# How long an event is remembered, and the request quota.
DEDUP_SECONDS = 60
QUOTA_REQUESTS = 1000
QUOTA_SECONDS = 60


def match_keys(
    requests: DataFrame, api_keys: DataFrame, projects: DataFrame, now: object
) -> DataFrame:
    """Add `project_id` and `org_id` of the presented key; NULL when unusable.

    A key counts when it carries the marker, its prefix and digest are known,
    and it has not expired at `now` (a column of the requests, or a value).
    The key and project tables are left to Spark's own size check: small ones
    are broadcast, large ones are shuffled.
    """
    at = F.col(now) if isinstance(now, str) and now in requests.columns else F.lit(now)
    owners = (
        api_keys.join(projects.select("project_id", "org_id"), "project_id")
        .groupBy("key_prefix", "key_hash")
        .agg(
            F.min(F.struct("project_id", "org_id", "expires_at")).alias("owner"),
        )
    )
    digest = F.sha2(F.col("api_key"), 256)
    presented = requests.drop("project_id").withColumns(
        {
            "key_prefix": F.substring("api_key", 1, KEY_PREFIX_LENGTH),
            "key_hash": F.when(F.col("api_key").startswith(KEY_MARKER), digest),
        }
    )
    expires = F.col("owner.expires_at")
    live = F.col("owner").isNotNull() & (expires.isNull() | (expires > at.cast("timestamp_ntz")))
    return (
        presented.join(owners, ["key_prefix", "key_hash"], "left")
        .withColumn("project_id", F.when(live, F.col("owner.project_id")))
        .withColumn("org_id", F.when(live, F.col("owner.org_id")))
        .drop("key_prefix", "key_hash", "owner")
    )


def attach_project(
    requests: DataFrame, api_keys: DataFrame, projects: DataFrame, now: object
) -> DataFrame:
    """Requests with a usable key; the key's project replaces any other."""
    return match_keys(requests, api_keys, projects, now).where(F.col("project_id").isNotNull())


def reject_keys(
    requests: DataFrame, api_keys: DataFrame, projects: DataFrame, now: object
) -> DataFrame:
    """Requests whose key is unknown, expired or of the wrong form."""
    return (
        match_keys(requests, api_keys, projects, now)
        .where(F.col("project_id").isNull())
        .drop("project_id", "org_id")
    )


# Slices of a quota window that are counted before instants are.
QUOTA_SLICES = 64
# Groups over which refused requests of a full window are spread.
REFUSED_GROUPS = 1024


def rate_limit(
    requests: DataFrame,
    key_col: str = "api_key",
    ts_col: str = "arrival_ts",
    tie_cols: Sequence[str] = ("seq",),
    limit: int = QUOTA_REQUESTS,
    window_seconds: int = QUOTA_SECONDS,
) -> DataFrame:
    """Add `allowed` and `remaining` per key and clock-aligned window.

    The first `limit` requests of a window, by time and ties, are admitted.
    Counts per slice of time, then per instant of the slice in which the limit
    is reached, give the instant at which a window is full. Requests behind it
    are refused without being ranked; at most `limit` requests, and those of
    that one instant, are ranked together. Every request is returned. Requests
    without a key share one quota, those without a time one window; of requests
    equal in all of `ts_col` and `tie_cols` any may be the first.
    """
    width = window_seconds * 1_000_000
    us = F.coalesce(clock.micros(F.col(ts_col)), F.lit(-(2**62)))
    digest = F.sha2(F.col(key_col), 256)
    numbered = requests.withColumns(
        {
            "quota_key": identity.quota_key(F.col(key_col)),
            "_key": F.coalesce(digest, F.lit("")),
            "_us": us,
            "_slot": clock.slot(us, width),
            "_slice": clock.slot(us, max(1, width // QUOTA_SLICES)),
        }
    )
    window = ["_key", "_slot"]
    times = numbered.select(*window, "_slice", "_us")
    slices = _reached(times, window, "_slice", F.lit(limit))
    inside = times.join(slices.select(*window, "_slice", "_before"), [*window, "_slice"])
    left = F.lit(limit) - F.col("_before")
    full = _reached(inside.withColumn("_left", left), window, "_us", F.col("_left"))
    edges = full.select(*window, F.col("_us").alias("_edge"))
    late = F.coalesce(F.col("_us") > F.col("_edge"), F.lit(False))
    spread = F.pmod(F.xxhash64("_us", *tie_cols), F.lit(REFUSED_GROUPS)) + 1
    rank = F.row_number().over(
        Window.partitionBy(*window, "_part").orderBy("_us", *tie_cols)
    )
    ranked = (
        numbered.join(edges, window, "left")
        .withColumn("_part", F.when(late, spread).otherwise(0))
        .withColumn("_rank", rank)
    )
    allowed = (F.col("_part") == 0) & (F.col("_rank") <= limit)
    left_over = F.when(allowed, F.lit(limit) - F.col("_rank")).otherwise(0).cast("bigint")
    return ranked.withColumns({"allowed": allowed, "remaining": left_over}).drop(
        "_key", "_us", "_slot", "_slice", "_edge", "_part", "_rank"
    )


def _reached(times: DataFrame, window: list[str], at: str, left: Column) -> DataFrame:
    """Per window the first value of `at` by which `left` requests were made, if any.

    `_before` is the number of requests before it.
    """
    n = F.count(F.lit(1)).alias("n")
    counts = times.groupBy(*window, at).agg(n, F.max(left).alias("left"))
    so_far = F.sum("n").over(Window.partitionBy(*window).orderBy(at))
    return (
        counts.withColumn("so_far", so_far)
        .where((F.col("so_far") >= F.col("left")) & (F.col("so_far") - F.col("n") < F.col("left")))
        .select(*window, at, (F.col("so_far") - F.col("n")).alias("_before"))
    )


def explode_batch(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    """One row per item of a body: `pos` and `item` (VARIANT).

    A body is one event or an array of events. A body that is not JSON gives
    one row with a NULL item.
    """
    body = F.try_parse_json(body_col)
    items = F.coalesce(body.try_cast("array<variant>"), F.array(body))
    return bodies.select("*", F.posexplode(items).alias("pos", "item"))


def with_client_ip(properties: Column, header_ip: Column, at_edge: bool) -> Column:
    """Property object (VARIANT) with the sender's address added.

    At the edge the address always replaces `clientIp`. Later it is added only
    where neither `ip` nor `clientIp` is set. Without a header address, or when
    the properties are not an object, nothing changes.
    """
    entries = F.when(jv.is_nothing(properties), F.create_map().cast("map<string,variant>")).otherwise(
        jv.as_map(properties)
    )
    added = F.create_map(F.lit("clientIp"), header_ip.cast("variant"))
    merged = F.to_variant_object(
        F.map_concat(F.map_filter(entries, lambda k, v: k != F.lit("clientIp")), added)
    )
    has_header = F.coalesce(header_ip, F.lit("")) != ""
    already = jv.truthy(jv.field(properties, "ip")) | jv.truthy(jv.field(properties, "clientIp"))
    wanted = has_header & entries.isNotNull()
    if not at_edge:
        wanted = wanted & ~already
    return F.when(wanted, merged).otherwise(properties)


def inject_client_ip(
    events: DataFrame, properties_col: str, header_col: str, at_edge: bool = False
) -> DataFrame:
    """`with_client_ip` for a column of JSON text."""
    properties = F.try_parse_json(properties_col)
    return events.withColumn(
        properties_col, F.to_json(with_client_ip(properties, F.col(header_col), at_edge))
    )


def assign_trace_id(events: DataFrame, *coordinates: str) -> DataFrame:
    """A trace id that is the same in every replay of the same input."""
    return events.withColumn("trace_id", identity.trace_id(*[F.col(c) for c in coordinates]))


def with_dedup_key(events: DataFrame) -> DataFrame:
    """Add `dedup_key` from project_id, user_id, ts_ms and event."""
    key = identity.dedup_key(F.col("project_id"), F.col("user_id"), F.col("ts_ms"), F.col("event"))
    return events.withColumn("dedup_key", key)


def dedup_events(
    events: DataFrame,
    key_cols: Sequence[str] = ("dedup_key",),
    ts_col: str = "arrival_ts",
    tie_col: str = "seq",
    ttl_seconds: int = DEDUP_SECONDS,
    **options: int,
) -> DataFrame:
    """Add `status`: ``accepted`` or ``duplicate``.

    An accepted event is remembered for `ttl_seconds`; a duplicate does not
    renew that. `tie_col` orders arrivals of one key at the same instant; of
    arrivals equal in that, too, one is accepted. An event without a key or
    without a time cannot repeat another one and is accepted.
    """
    marked = attach_anchors(events, key_cols, ts_col, ttl_seconds, tie_col=tie_col, **options)
    unknown = F.col(ts_col).isNull()
    for name in key_cols:
        unknown = unknown | F.col(name).isNull()
    return marked.withColumn(
        "status",
        F.when(F.col("sets_anchor") | unknown, F.lit("accepted")).otherwise(F.lit("duplicate")),
    ).drop("anchor_us", "sets_anchor")


def judged_items(
    bodies: DataFrame, body_col: str = "body", header_ip: str | None = None
) -> DataFrame:
    """Exploded items with `item`, `issues` and `verdict`, before duplicates.

    Verdicts are ``valid``, ``rejected`` and ``error``. The last one stands for
    a body that is not JSON, and for an item or properties that cannot take the
    sender's address at all.
    """
    items = explode_batch(bodies, body_col)
    raw = F.col("item")
    properties = jv.field(raw, "properties")
    scalar = ("string", "number", "boolean")
    if header_ip is None:
        broken = raw.isNull()
        injected = properties
    else:
        has_header = F.coalesce(F.col(header_ip), F.lit("")) != ""
        broken = raw.isNull() | has_header & (
            jv.kind(raw).isin("null", *scalar) | jv.kind(properties).isin(*scalar)
        )
        injected = with_client_ip(properties, F.col(header_ip), at_edge=False)
    judged = with_envelope_issues(items.withColumn("properties", injected), "item", "properties")
    return judged.withColumn(
        "verdict",
        F.when(broken, F.lit("error"))
        .when(F.size("issues") > 0, F.lit("rejected"))
        .otherwise(F.lit("valid")),
    )


def ingest_status(
    bodies: DataFrame,
    body_col: str = "body",
    ts_col: str = "arrival_ts",
    tie_col: str = "event_id",
    header_ip: str | None = None,
) -> DataFrame:
    """Number of items per outcome: accepted, duplicate, rejected, error."""
    items = judged_items(bodies, body_col, header_ip).select(
        "verdict",
        F.col(ts_col).alias("arrival_ts"),
        F.struct(tie_col, "pos").alias("place"),
        identity.dedup_key(
            jv.text(jv.field(F.col("item"), "projectId")),
            jv.text(jv.field(F.col("item"), "userId")),
            jv.field(F.col("item"), "timestamp").cast("string"),
            jv.text(jv.field(F.col("item"), "event")),
        ).alias("dedup_key"),
    )
    # Read several times below; bodies are parsed and judged only here.
    items = materialise(items)
    valid = F.col("verdict") == "valid"
    known = dedup_events(items.where(valid), tie_col="place")
    counts = known.groupBy("status").agg(F.count("*").alias("items"))
    others = (
        items.where(~valid)
        .groupBy(F.col("verdict").alias("status"))
        .agg(F.count("*").alias("items"))
    )
    return counts.unionByName(others)
