"""Counts and unique users per bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import clock, identity

KEY = ["project_id", "event"]
ROLLUP_KEY = [*KEY, "bucket"]


def rolling_counts(
    events: DataFrame, ts_col: str = "ts", grains: Sequence[str] = clock.GRAINS
) -> DataFrame:
    """Tumbling counts per project, event, grain and bucket.

    Events are counted once, per minute; coarser grains add up the minutes.
    """
    minutes = events.groupBy(*KEY, clock.bucket(F.col(ts_col), "minute").alias("minute")).agg(
        F.count("*").alias("n")
    )
    buckets = F.array(
        *[
            F.struct(F.lit(g).alias("grain"), clock.bucket(F.col("minute"), g).alias("bucket"))
            for g in grains
        ]
    )
    return (
        minutes.select(*KEY, "n", F.inline(buckets))
        .groupBy(*KEY, "grain", "bucket")
        .agg(F.sum("n").alias("count"))
    )


def _named(user: str = "user_id") -> Column:
    return identity.text_or_empty(F.col(user)) != ""


def daily_uniques(events: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Distinct non-empty users per project, event and UTC day, exactly."""
    return (
        events.where(_named())
        .groupBy(*KEY, F.col(ts_col).cast("date").alias("day"))
        .agg(F.count_distinct("user_id").alias("unique_users"))
    )


def daily_sketches(events: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Mergeable sketch of the non-empty users per project, event and day."""
    return (
        events.where(_named())
        .groupBy(*KEY, F.col(ts_col).cast("date").alias("day"))
        .agg(F.hll_sketch_agg("user_id").alias("users_sketch"))
    )


def merge_uniques(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Estimated distinct users of merged sketches; of rows with `user_id`, their exact number."""
    if "user_id" in sketches.columns:
        return sketches.groupBy(*keys).agg(F.count_distinct("user_id").alias("unique_users"))
    return sketches.groupBy(*keys).agg(
        F.hll_sketch_estimate(F.hll_union_agg("users_sketch")).alias("unique_users")
    )


# Fixed value: days a day's users are kept after their last update.
UNIQUES_DAYS = 7


def unique_updates(events: DataFrame, ts_col: str = "ts", at_col: str = "arrival_ts") -> DataFrame:
    """What a batch adds to the kept users: a sketch per project, event, day and hour of arrival.

    `first_at` and `last_at` are the first and last arrival in it. Rows of all batches
    together are the state; `live_uniques` reads it, or makes it small again.
    """
    at = F.col(at_col).cast("timestamp_ntz")
    day = F.col(ts_col).cast("date").alias("day")
    return (
        events.where(_named())
        .groupBy(*KEY, day, clock.bucket(at, "hour").alias("hour"))
        .agg(
            F.min(at).alias("first_at"),
            F.max(at).alias("last_at"),
            F.hll_sketch_agg("user_id").alias("users_sketch"),
        )
        .drop("hour")
    )


def user_updates(events: DataFrame, ts_col: str = "ts", at_col: str = "arrival_ts") -> DataFrame:
    """`unique_updates` with a row per user instead of a sketch, so that users are counted exactly."""
    at = F.col(at_col).cast("timestamp_ntz")
    day = F.col(ts_col).cast("date").alias("day")
    return (
        events.where(_named())
        .groupBy(*KEY, day, clock.bucket(at, "hour").alias("hour"), "user_id")
        .agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"))
        .drop("hour")
    )


def _live_users(updates: DataFrame, now: object, days: int) -> DataFrame:
    """`live_uniques` of `user_updates`: a row per user, with the arrivals of all users of the day."""
    key = [*KEY, "day"]
    hour = clock.bucket(F.col("first_at"), "hour").alias("hour")
    hours = updates.groupBy(*key, hour).agg(
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")
    )
    held = _held(hours, now, days).groupBy(*key).agg(
        F.min("first_at").alias("_first"), F.max("last_at").alias("_last")
    )
    rows = updates.join(held, key).where(F.col("first_at") >= F.col("_first"))
    return rows.select(
        *key, "user_id", F.col("_first").alias("first_at"), F.col("_last").alias("last_at")
    ).distinct()


def live_uniques(updates: DataFrame, now: object, days: int = UNIQUES_DAYS) -> DataFrame:
    """One row per project, event and day that is alive at `now`, in the form of the updates.

    Users of a day are forgotten `days` after their last update, whenever the day was; what
    comes later begins anew. Updates are taken by arrival, however they were dealt to batches.
    """
    if "user_id" in updates.columns:
        return _live_users(updates, now, days)
    return _held(updates, now, days).groupBy(*KEY, "day").agg(
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
        F.hll_union_agg("users_sketch").alias("users_sketch"),
    )


def _held(updates: DataFrame, now: object, days: int) -> DataFrame:
    """Updates that are not forgotten at `now`."""
    key = [*KEY, "day"]
    life = F.make_dt_interval(days=F.lit(days))
    own = Window.partitionBy(*key)
    # One row per hour with arrivals, or one for all that was made small before.
    earlier = own.orderBy("first_at").rowsBetween(Window.unboundedPreceding, -1)
    anew = F.col("first_at") >= F.max("last_at").over(earlier) + life
    rows = updates.withColumn("_anew", F.when(anew, F.col("first_at"))).withColumns(
        {"_start": F.max("_anew").over(own), "_last": F.max("last_at").over(own)}
    )
    held = F.col("_start").isNull() | (F.col("first_at") >= F.col("_start"))
    alive = F.col("_last") + life > F.lit(now).cast("timestamp_ntz")
    return rows.where(held & alive)


def build_rollups(events: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Minute rollups: `count`, `unique_users`, `unique_users_bucket`.

    `unique_users` is the distinct users of the whole day, repeated on each of
    its buckets; `unique_users_bucket` is the distinct users of the bucket.
    Both come from one scan, without a join: a user counts for the day in the
    first bucket they are seen in, and the buckets of a day add up.
    """
    bucket = clock.bucket(F.col(ts_col), "minute")
    per_user = (
        events.groupBy(
            *KEY, bucket.alias("bucket"), identity.text_or_empty(F.col("user_id")).alias("user_id")
        )
        .agg(F.count("*").alias("n"))
        .withColumn("day", F.col("bucket").cast("date"))
    )
    # At most one row per minute of the day, whoever the user is.
    first = F.min("bucket").over(Window.partitionBy(*KEY, "day", "user_id"))
    buckets = (
        per_user.withColumn("new", _named() & (F.col("bucket") == first))
        .groupBy(*ROLLUP_KEY, "day")
        .agg(
            F.sum("n").alias("count"),
            F.count_if(_named()).alias("unique_users_bucket"),
            F.count_if("new").alias("new"),
        )
    )
    return buckets.select(
        *ROLLUP_KEY,
        "count",
        F.sum("new").over(Window.partitionBy(*KEY, "day")).alias("unique_users"),
        "unique_users_bucket",
    )


def sketch_rollups(events: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Minute rollups that carry a sketch, so that uniques can be merged."""
    user = F.when(_named(), F.col("user_id"))
    return events.groupBy(*KEY, clock.bucket(F.col(ts_col), "minute").alias("bucket")).agg(
        F.count("*").alias("count"), F.hll_sketch_agg(user).alias("users_sketch")
    )


def closing_rows(
    stored: DataFrame, fresh: DataFrame, closed_until: Column, until: Column
) -> DataFrame:
    """Rows of the closing log for one step of the clock.

    `stored` are the rollups of all events so far, `fresh` those of the last batch;
    minutes up to `closed_until` are closed, those up to `until` close now. A minute
    closes once, with all it has by then; what comes later is a `correction` with what
    it adds. A minute without events has no row.
    """
    close = stored.where((F.col("bucket") > closed_until) & (F.col("bucket") <= until))
    late = fresh.where(F.col("bucket") <= closed_until)
    kinds = [close.withColumn("kind", F.lit("close")), late.withColumn("kind", F.lit("correction"))]
    both = kinds[0].unionByName(kinds[1].select(*kinds[0].columns))
    return both.where("count > 0").withColumn("closed_until", until)


def finalise_rollups(log: DataFrame) -> DataFrame:
    """Closed minutes with their corrections: `count` and `unique_users_bucket`."""
    return log.groupBy(*ROLLUP_KEY).agg(
        F.sum("count").alias("count"),
        F.hll_sketch_estimate(F.hll_union_agg("users_sketch")).alias("unique_users_bucket"),
        F.count_if(F.col("kind") == "correction").alias("corrections"),
    )


def merge_rollups(deltas: DataFrame) -> DataFrame:
    """One row per key: counts add up, the greatest unique count wins."""
    return deltas.groupBy(*ROLLUP_KEY).agg(
        F.sum("count").alias("count"), F.max("unique_users").alias("unique_users")
    )


def live_messages(rollups: DataFrame) -> DataFrame:
    """`project_id` and the JSON message that announces each rolled-up key."""
    message = F.struct(
        F.lit("metric_update").alias("type"),
        F.col("project_id").alias("projectId"),
        F.col("event"),
        F.col("count").alias("count_1m"),
        F.col("unique_users").alias("active_users"),
        clock.epoch_ms(F.col("bucket")).alias("timestamp"),
    )
    return rollups.select("project_id", F.to_json(message).alias("value"))


def live_counts(
    events: DataFrame, now: object = None, project: str | None = None, ts_col: str = "ts"
) -> DataFrame:
    """Events per name in the clock minute of `now`.

    Without `now` it is the minute of the latest event, for replays.
    """
    if project is not None:
        events = events.where(F.col("project_id") == project)
    if now is None and "event_date" in events.columns:
        # Only the last recorded day can hold the latest event.
        last_day = events.agg(F.max("event_date")).first()[0]
        events = events.where(F.col("event_date") == F.lit(last_day))
    if now is None:
        latest = events.agg(clock.bucket(F.max(ts_col), "minute").alias("minute"))
        current = events.withColumn("minute", clock.bucket(F.col(ts_col), "minute")).join(
            latest, "minute"
        )
    else:
        kind = events.schema[ts_col].dataType
        start = F.date_trunc("minute", F.lit(now).cast("timestamp")).cast(kind)
        end = start + F.expr("interval 1 minute")
        current = events.where((F.col(ts_col) >= start) & (F.col(ts_col) < end))
        if "event_date" in events.columns:
            current = current.where(F.col("event_date") == start.cast("date"))
    return current.groupBy(*KEY).agg(F.count("*").alias("count"))
