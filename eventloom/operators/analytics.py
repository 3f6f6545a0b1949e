"""The questions product teams ask: metrics, funnels, retention, users.

`project=None` answers for every project at once and keeps `project_id` as the
first column of the result.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import clock
from eventloom.sources.tables import bound, scan_events, scan_rollups

MICROS = 1_000_000


def metrics(
    rollups: DataFrame,
    project: str | None = None,
    event: str | None = None,
    start: object = None,
    end: object = None,
    granularity: str = "hour",
) -> DataFrame:
    """Counts and summed unique users per bucket, in time order.

    `unique_users` adds up the column of the rollups, which counts a user once
    per bucket; `metrics_unique` counts each user once.
    """
    keys = _keys(project, event)
    grain = clock.granularity(granularity)
    return (
        scan_rollups(rollups, project, event, start, end)
        .groupBy(*keys, clock.bucket(F.col("bucket"), grain).alias("bucket"))
        .agg(
            F.sum("count").cast("bigint").alias("count"),
            F.sum("unique_users").cast("bigint").alias("unique_users"),
        )
        .orderBy("bucket", *keys)
    )


def metrics_from_grains(
    grains: Mapping[str, DataFrame],
    project: str | None = None,
    event: str | None = None,
    start: object = None,
    end: object = None,
    granularity: str = "hour",
) -> DataFrame:
    """`metrics` from tables by minute, hour and day, as `sinks.write_grains` stores them.

    The range is covered by whole days as far as the granularity allows, then by whole
    hours, then by the minutes left at its ends; each table is read for its own part only,
    so a long range opens few days of the finer ones.
    """
    keys = _keys(project, event)
    grain = clock.granularity(granularity)
    steps = clock.GRAINS[: clock.GRAINS.index(grain) + 1]
    minutes = grains["minute"]
    low = None if start is None else clock.next_bucket(bound(minutes, "bucket", start), "minute")
    high = None
    if end is not None:
        high = clock.bucket(bound(minutes, "bucket", end), "minute") + F.expr("interval 1 minute")
    parts = [
        _cover(scan_rollups(grains[step], project, event), low, high, step, coarser)
        for step, coarser in zip(steps, [*steps[1:], None], strict=True)
        if coarser is None or low is not None or high is not None
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return (
        rows.groupBy(*keys, clock.bucket(F.col("bucket"), grain).alias("bucket"))
        .agg(
            F.sum("count").cast("bigint").alias("count"),
            F.sum("unique_users").cast("bigint").alias("unique_users"),
        )
        .orderBy("bucket", *keys)
    )


def _cover(
    table: DataFrame, low: Column | None, high: Column | None, grain: str, coarser: str | None
) -> DataFrame:
    """Whole buckets of a grain from `low` to before `high` that no coarser table covers."""
    day, at = F.col("bucket_date"), F.col("bucket")
    if low is not None:
        first = clock.next_bucket(low, grain)
        table = table.where((at >= first) & (day >= first.cast("date")))
    if high is not None:
        behind = clock.bucket(high, grain)
        table = table.where((at < behind) & (day <= behind.cast("date")))
    if coarser is not None:
        ends = []
        if low is not None:
            inner = clock.next_bucket(low, coarser)
            ends.append((at < inner, day <= (inner - F.expr("interval 1 microsecond")).cast("date")))
        if high is not None:
            inner = clock.bucket(high, coarser)
            ends.append((at >= inner, day >= inner.cast("date")))
        # The days alone once more: they choose the folders.
        for condition in zip(*ends, strict=True):
            table = table.where(condition[0] if len(condition) == 1 else condition[0] | condition[1])
    return table.select("project_id", "event", "bucket", "count", "unique_users")


def metrics_unique(
    sketches: DataFrame,
    project: str | None = None,
    event: str | None = None,
    start: object = None,
    end: object = None,
    granularity: str = "hour",
) -> DataFrame:
    """`metrics` over sketch rollups: merged, so nobody is counted twice."""
    keys = _keys(project, event)
    grain = clock.granularity(granularity)
    return (
        scan_rollups(sketches, project, event, start, end)
        .groupBy(*keys, clock.bucket(F.col("bucket"), grain).alias("bucket"))
        .agg(
            F.sum("count").cast("bigint").alias("count"),
            F.hll_sketch_estimate(F.hll_union_agg("users_sketch")).alias("unique_users"),
        )
        .orderBy("bucket", *keys)
    )


def metrics_unique_exact(
    events: DataFrame,
    project: str | None = None,
    event: str | None = None,
    start: object = None,
    end: object = None,
    granularity: str = "hour",
) -> DataFrame:
    """Exact twin of `metrics_unique`, from the events themselves."""
    keys = _keys(project, event)
    grain = clock.granularity(granularity)
    chosen = scan_events(events, project, None if event is None else [event], start, end)
    user = F.when(F.col("user_id") != "", F.col("user_id"))
    return (
        chosen.groupBy(*keys, clock.bucket(F.col("ts"), grain).alias("bucket"))
        .agg(F.count("*").alias("count"), F.count_distinct(user).alias("unique_users"))
        .orderBy("bucket", *keys)
    )


def _keys(project: str | None, event: str | None) -> list[str]:
    return [
        name
        for name, value in (("project_id", project), ("event", event))
        if value is None
    ]


def funnel(
    events: DataFrame,
    steps: Sequence[str],
    window: str = "7d",
    project: str | None = None,
    start: object = None,
    end: object = None,
) -> DataFrame:
    """Users per adjacent pair of steps who did the second within the window.

    Pairs are independent of each other. The first event must lie in
    [start, end]; the second may follow later than `end`. A step followed by
    itself is met by a single event.

    Time is cut into slots as long as the window. Within a slot every A
    reaches every later B, so the earliest A and the latest B decide; between
    neighbouring slots the latest A and the earliest B decide; further apart
    nothing can match. So four extremes per user, event and slot hold all that
    is needed. They are built before the shuffle, whatever the size of a user,
    and no pair of events is ever formed. Pairs nobody completed show 0.
    """
    if len(steps) < 2:
        raise ValueError("at least 2 steps required")
    length = clock.parse_window(window) * MICROS
    chosen = scan_events(events, project, steps, start)
    us = clock.micros(F.col("ts"))
    entered = us
    if end is not None:
        # The second event lies at most one window behind `end`.
        last = bound(events, "ts", end) + F.make_dt_interval(secs=F.lit(length // MICROS))
        chosen = chosen.where(F.col("ts") <= last)
        if "event_date" in events.columns:
            chosen = chosen.where(F.col("event_date") <= last.cast("date"))
        entered = F.when(F.col("ts") <= bound(events, "ts", end), us)
    extremes = chosen.groupBy(
        "project_id", "user_id", "event", clock.slot(us, length).alias("slot")
    ).agg(
        F.min(entered).alias("first_a"),
        F.max(entered).alias("last_a"),
        F.min(us).alias("first_b"),
        F.max(us).alias("last_b"),
    )

    # An event takes part in every pair that names it, as A in its own slot and
    # as B in its own and the previous slot.
    def role(pair: int, as_a: bool, back: int):
        return F.struct(
            F.lit(pair).alias("pair"), F.lit(as_a).alias("as_a"), F.lit(back).alias("back")
        )

    roles = None
    for name in sorted(set(steps)):
        taken = [role(i, True, 0) for i, a in enumerate(steps[:-1]) if a == name]
        for i, b in enumerate(steps[1:]):
            if b == name:
                taken += [role(i, False, 0), role(i, False, 1)]
        match, parts = F.col("event") == name, F.array(*taken)
        roles = F.when(match, parts) if roles is None else roles.when(match, parts)

    is_a, is_b = F.col("as_a"), ~F.col("as_a")
    same, following = F.col("back") == 0, F.col("back") == 1
    meetings = (
        extremes.withColumn("role", F.explode(roles))
        .select("*", "role.pair", "role.as_a", "role.back")
        .groupBy(
            "project_id", "user_id", "pair", (F.col("slot") - F.col("back")).alias("slot")
        )
        .agg(
            F.min(F.when(is_a, F.col("first_a"))).alias("first_a"),
            F.max(F.when(is_a, F.col("last_a"))).alias("last_a"),
            F.max(F.when(is_b & same, F.col("last_b"))).alias("last_b"),
            F.min(F.when(is_b & following, F.col("first_b"))).alias("next_b"),
        )
        .withColumn(
            "met",
            F.coalesce(F.col("first_a") <= F.col("last_b"), F.lit(False))
            | F.coalesce(F.col("next_b") - F.col("last_a") <= length, F.lit(False)),
        )
    )
    per_user = meetings.groupBy("project_id", "user_id", "pair").agg(F.max("met").alias("met"))
    counted = per_user.groupBy(*_keys(project, "")).agg(
        *[
            F.count_if(F.col("met") & (F.col("pair") == i)).alias(f"users_{i}")
            for i in range(len(steps) - 1)
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("pair"),
                F.lit(a).alias("from"),
                F.lit(b).alias("to"),
                F.col(f"users_{i}").alias("users"),
            )
            for i, (a, b) in enumerate(zip(steps, steps[1:], strict=False))
        ]
    )
    keys = _keys(project, "")
    return counted.select(*keys, F.inline(rows)).orderBy(*keys, "pair")


def _weeks(
    events: DataFrame,
    cohort_event: str,
    return_event: str,
    project: str | None,
    start: object,
    end: object,
) -> DataFrame:
    """Per user the weeks of the cohort event and of the return event.

    Repetitions within a week disappear before the shuffle. The arrays hold at
    most one entry per week of recorded time.
    """
    chosen = scan_events(events, project, [cohort_event, return_event])
    joined = F.col("event") == cohort_event
    if start is not None:
        joined = joined & (F.col("ts") >= bound(events, "ts", start))
        # Nothing before the week of the first cohort counts as a return.
        monday = F.date_trunc("week", bound(events, "ts", start)).cast(events.schema["ts"].dataType)
        chosen = chosen.where(F.col("ts") >= monday)
        if "event_date" in events.columns:
            chosen = chosen.where(F.col("event_date") >= monday.cast("date"))
    if end is not None:
        joined = joined & (F.col("ts") <= bound(events, "ts", end))
    returned = F.col("event") == return_event
    weekly = chosen.groupBy(
        "project_id", "user_id", clock.week_of(F.col("ts")).alias("week")
    ).agg(F.max(joined).alias("joined"), F.max(returned).alias("returned"))
    return weekly.groupBy("project_id", "user_id").agg(
        F.collect_list(F.when(F.col("joined"), F.col("week"))).alias("cohorts"),
        F.collect_list(F.when(F.col("returned"), F.col("week"))).alias("returns"),
    )


def retention_long(
    events: DataFrame,
    cohort_event: str,
    return_event: str,
    project: str | None = None,
    start: object = None,
    end: object = None,
) -> DataFrame:
    """Users per cohort week and return week, the return not before the cohort.

    A user belongs to every week (Monday start) with a cohort event inside
    [start, end]. Returns have no time bound.
    """
    keys = _keys(project, "")
    weeks = _weeks(events, cohort_event, return_event, project, start, end)
    cells = weeks.select(*keys, "returns", F.explode("cohorts").alias("cohort_week")).select(
        *keys,
        "cohort_week",
        F.explode(
            F.filter("returns", lambda week: week >= F.col("cohort_week"))
        ).alias("return_week"),
    )
    return (
        cells.groupBy(*keys, "cohort_week", "return_week")
        .agg(F.count("*").alias("users"))
        .orderBy(*keys, "cohort_week", "return_week")
    )


def retention(
    events: DataFrame,
    cohort_event: str,
    return_event: str,
    periods: int = 8,
    project: str | None = None,
    start: object = None,
    end: object = None,
    with_size: bool = False,
) -> DataFrame:
    """One row per cohort week: `total`, then `period_0`, `period_1`, ...

    `total` is period 0: users who returned in their cohort week. Cohorts
    nobody ever returned to are absent. `with_size` adds `cohort_size`, the
    users in the cohort whether they returned or not.
    """
    weeks = _weeks(events, cohort_event, return_event, project, start, end)
    return _retained(weeks, _keys(project, ""), periods, with_size)


def _retained(weeks: DataFrame, keys: list[str], periods: int, with_size: bool) -> DataFrame:
    # Per user and cohort one row: which of the wanted weeks it came back in.
    came = [
        F.array_contains("returns", F.date_add("cohort", 7 * p)).alias(f"came_{p}")
        for p in range(periods)
    ]
    later = F.exists("returns", lambda week: week >= F.col("cohort")).alias("ever")
    table = (
        weeks.select(*keys, "returns", F.explode("cohorts").alias("cohort"))
        .select(*keys, "cohort", later, *came)
        .groupBy(*keys, "cohort")
        .agg(
            F.count("*").alias("cohort_size"),
            F.count_if("ever").alias("ever"),
            *[F.count_if(f"came_{p}").alias(f"period_{p}") for p in range(periods)],
        )
        .where("ever > 0")
        .withColumn("total", F.col("period_0") if periods > 0 else F.lit(0).cast("bigint"))
    )
    names = [*keys, "cohort", "total", *[f"period_{p}" for p in range(periods)]]
    if with_size:
        names.append("cohort_size")
    return table.select(*names).orderBy(*keys, "cohort")


# Days are kept as bits, nine whole weeks to a number. Fixed value: the first Monday of the clock.
FIRST_MONDAY = "1970-01-05"
CHUNK_WEEKS = 9
USER_DAYS = ["project_id", "event", "user_id", "chunk"]


def user_days(events: DataFrame, ts_col: str = "ts") -> DataFrame:
    """The days of every user's events: `project_id, event, user_id, chunk, days`.

    `days` has a bit for each of the 63 days of a chunk. Rows of several batches or days
    are put together by `merge_user_days`, in any order and any number of times.
    """
    day = F.datediff(F.col(ts_col).cast("date"), F.lit(FIRST_MONDAY).cast("date"))
    size = 7 * CHUNK_WEEKS
    return (
        events.withColumns({"chunk": F.floor(day / size).cast("int"), "_day": F.pmod(day, F.lit(size))})
        .groupBy(*USER_DAYS)
        .agg(F.bit_or(F.expr("shiftleft(1L, _day)")).alias("days"))
    )


def merge_user_days(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*USER_DAYS).agg(F.bit_or("days").alias("days"))


def retention_from_days(
    days: DataFrame,
    cohort_event: str,
    return_event: str,
    periods: int = 8,
    project: str | None = None,
    first_day: object = None,
    last_day: object = None,
    with_size: bool = False,
) -> DataFrame:
    """`retention` from kept `user_days`: reads a row per user and nine weeks, no events.

    The cohort event lies on the days from `first_day` to `last_day`, both included.
    """
    chosen = days.where(F.col("event").isin(cohort_event, return_event))
    if project is not None:
        chosen = chosen.where(F.col("project_id") == project)
    monday = F.lit(FIRST_MONDAY).cast("date")
    if first_day is not None:
        first_week = F.datediff(F.date_trunc("week", F.lit(first_day).cast("date")).cast("date"), monday)
        chosen = chosen.where(F.col("chunk") >= F.floor(first_week / (7 * CHUNK_WEEKS)))
    week = F.explode(F.sequence(F.lit(0), F.lit(CHUNK_WEEKS - 1))).alias("n")
    weekly = (
        merge_user_days(chosen)
        .select("*", week)
        .withColumn("bits", F.expr("shiftright(days, 7 * n) & 127L"))
        .withColumn("week", F.expr(f"date_add(DATE'{FIRST_MONDAY}', 7 * ({CHUNK_WEEKS} * chunk + n))"))
        .where("bits <> 0")
    )
    low, high = F.lit(0), F.lit(6)
    if first_day is not None:
        weekly = weekly.where(F.col("week") >= F.date_add(monday, first_week))
        low = F.greatest(low, F.datediff(F.lit(first_day).cast("date"), F.col("week")))
    if last_day is not None:
        high = F.least(high, F.datediff(F.lit(last_day).cast("date"), F.col("week")))
    inside = F.exists(
        F.sequence(F.lit(0), F.lit(6)),
        lambda day: (day >= low) & (day <= high) & F.getbit(F.col("bits"), day).cast("boolean"),
    )
    joined = (F.col("event") == cohort_event) & inside
    weeks = weekly.groupBy("project_id", "user_id").agg(
        F.collect_list(F.when(joined, F.col("week"))).alias("cohorts"),
        F.collect_list(F.when(F.col("event") == return_event, F.col("week"))).alias("returns"),
    )
    return _retained(weeks, _keys(project, ""), periods, with_size)


# Columns of the user listing, in order.
USER_COLUMNS = ("user_id", "country", "city", "browser", "os", "device_type")
FILTER_COLUMNS = (
    "project_id", "event", "user_id", "session_id", "country", "city", "device_type",
    "browser", "os",
)
DEFAULT_PAGE, MAX_PAGE = 50, 1000


def users_filter(events: DataFrame, text: str | None) -> DataFrame:
    """Keep events whose column equals a value, given as ``column:value``.

    The text is split at its first colon, the column name is reduced to letters
    and underscores. A text without either part filters nothing.
    """
    field, colon, value = (text or "").partition(":")
    if not (colon and field and value):
        return events
    name = re.sub(r"[^a-zA-Z_]", "", field)
    if name not in FILTER_COLUMNS or name not in events.columns:
        raise ValueError(f"unknown column: {name}")
    return events.where(F.col(name) == value)


def user_profiles(
    events: DataFrame, project: str | None = None, filter_text: str | None = None
) -> DataFrame:
    """First and last event per distinct combination of user and context."""
    keys = [*_keys(project, ""), *USER_COLUMNS]
    chosen = users_filter(scan_events(events, project), filter_text)
    return (
        chosen.where(F.col("user_id") != "")
        .groupBy(*keys)
        .agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    )


def users(
    events: DataFrame,
    project: str | None = None,
    filter_text: str | None = None,
    limit: int = DEFAULT_PAGE,
    offset: int = 0,
) -> DataFrame:
    """A page of `user_profiles`, latest activity first.

    A page has 1 to MAX_PAGE rows; other limits are errors. Deep pages cost what
    all pages before them do: `users_after` goes on from a row instead.
    """
    page(limit, offset, MAX_PAGE)
    profiles = user_profiles(events, project, filter_text)
    return profiles.orderBy(F.desc("last_seen"), *_profile_keys(profiles)).offset(offset).limit(limit)


def users_after(
    events: DataFrame,
    last: Sequence[object] | None = None,
    project: str | None = None,
    filter_text: str | None = None,
    limit: int = DEFAULT_PAGE,
) -> DataFrame:
    """The page behind a row, given by its `last_seen` and its key columns in order."""
    page(limit, 0, MAX_PAGE)
    profiles = user_profiles(events, project, filter_text)
    keys = _profile_keys(profiles)
    if last is not None:
        seen = bound(profiles, "last_seen", last[0])
        behind = F.struct(*keys) > F.struct(
            *[F.lit(v).alias(k) for k, v in zip(keys, last[1:], strict=True)]
        )
        profiles = profiles.where(
            (F.col("last_seen") < seen) | ((F.col("last_seen") == seen) & behind)
        )
    return profiles.orderBy(F.desc("last_seen"), *keys).limit(limit)


def _profile_keys(profiles: DataFrame) -> list[str]:
    return [name for name in profiles.columns if name not in ("first_seen", "last_seen")]


def page(limit: int, offset: int, most: int) -> None:
    """Refuse what would otherwise be cut without a word."""
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be from 1 to {most}")
    if offset < 0:
        raise ValueError("offset must not be negative")


def tenant_scope(df: DataFrame, projects: DataFrame, org: str | None = None) -> DataFrame:
    """Rows of the projects that belong to an organisation.

    Without `org` every row must carry its own `org_id`, and the two must agree.
    """
    if org is not None:
        owned = projects.where(F.col("org_id") == org).select("project_id")
        return df.join(owned, "project_id", "left_semi")
    return df.join(projects.select("project_id", "org_id"), ["project_id", "org_id"], "left_semi")
