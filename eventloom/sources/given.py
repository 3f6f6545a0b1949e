"""Adapters from the given tables to the event model.

The columns the given tables lack (project, device, anonymous events, repeated
arrivals, dead letters) are computed from the ones they have, row by row, so
that every derived table grows with its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import clock
from eventloom.functions.address import PREFIX_SIZE

PRESENTED_KEY_TAIL = 24


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(index: Column, choices: list[str]) -> Column:
    """The choice under an index that counts from zero."""
    return F.element_at(F.array(*[F.lit(c) for c in choices]), (index + 1).cast("int"))


def events_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The `events` table as a stream."""
    schema = table(spark, folder, "events").schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(folder)
    )


def analytics_events(
    spark: SparkSession, folder: str, with_location: bool = False, stream: bool = False
) -> DataFrame:
    """The `events` table in the stored form of the event model."""
    events = events_stream(spark, folder) if stream else table(spark, folder, "events")
    rows = events.select(
        "event_id",
        "ts",
        F.concat(F.lit("proj_"), (F.col("user_id") % 4).cast("string")).alias("project_id"),
        F.col("event_type").alias("event"),
        F.when(F.col("event_id") % 20 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("user_"), F.col("user_id").cast("string")))
        .alias("user_id"),
        F.col("user_id").alias("customer_key"),
        pick(F.col("event_id") % 3, ["desktop", "mobile", "tablet"]).alias("device_type"),
        pick(F.col("user_id") % 3, ["Chrome", "Firefox", "Safari"]).alias("browser"),
        pick(F.col("user_id") % 2, ["Windows", "macOS"]).alias("os"),
        F.col("props").alias("properties"),
    )
    if not with_location:
        return rows.drop("customer_key")
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("customer_key"), "c_nationkey"
    )
    nations = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country")
    )
    return (
        rows.join(customers, "customer_key")
        .join(nations, "c_nationkey")
        .withColumn("city", F.concat(F.lit("city_"), F.col("c_nationkey").cast("string")))
        .drop("customer_key", "c_nationkey")
    )


def arrivals(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """Events as they arrive: some again after 30 s, some again after 60 s."""
    events = analytics_events(spark, folder, stream=stream).withColumn("ts_ms", clock.epoch_ms(F.col("ts")))
    copies = F.filter(
        F.array(
            F.struct(F.lit(0).alias("seq"), F.lit(0).alias("delay")),
            F.when(
                F.col("event_id") % 10 == 0,
                F.struct(F.lit(1).alias("seq"), F.lit(30).alias("delay")),
            ),
            F.when(
                F.col("event_id") % 30 == 0,
                F.struct(F.lit(2).alias("seq"), F.lit(60).alias("delay")),
            ),
        ),
        lambda c: c.isNotNull(),
    )
    return (
        events.withColumn("copy", F.explode(copies))
        .withColumn("seq", F.col("copy.seq"))
        .withColumn(
            "arrival_ts", F.col("ts") + F.make_dt_interval(secs=F.col("copy.delay"))
        )
        .drop("copy")
    )


def projects(spark: SparkSession, folder: str) -> DataFrame:
    """One project per region, spread over two organisations."""
    key = F.col("r_regionkey").cast("string")
    return table(spark, folder, "region").select(
        F.concat(F.lit("proj_"), key).alias("project_id"),
        F.concat(F.lit("org_"), (F.col("r_regionkey") % 2).cast("string")).alias("org_id"),
        F.col("r_name").alias("name"),
    )


def presented_key(index: Column) -> Column:
    """API key text of a project number."""
    digest = F.sha2(F.concat(F.lit("key-"), index.cast("string")), 256)
    return F.concat(F.lit("pk_live_"), F.substring(digest, 1, PRESENTED_KEY_TAIL))


def api_keys(spark: SparkSession, folder: str) -> DataFrame:
    """One key per project; the key of project 3 has expired."""
    full = presented_key(F.col("r_regionkey"))
    return table(spark, folder, "region").select(
        F.concat(F.lit("proj_"), F.col("r_regionkey").cast("string")).alias("project_id"),
        F.substring(full, 1, 16).alias("key_prefix"),
        F.sha2(full, 256).alias("key_hash"),
        F.when(F.col("r_regionkey") == 3, F.lit("2024-01-15 00:00:00"))
        .cast("timestamp_ntz")
        .alias("expires_at"),
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a keyed request; one in seven carries an unusable key."""
    events = table(spark, folder, "events")
    key = presented_key(F.col("user_id") % 4)
    return events.select(
        "event_id",
        F.col("ts").alias("arrival_ts"),
        F.when(F.col("event_id") % 14 == 0, F.concat(F.lit("sk_test_"), key))
        .when(F.col("event_id") % 7 == 0, F.concat(key, F.lit("x")))
        .otherwise(key)
        .alias("api_key"),
    )


def raw_bodies(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """Request bodies: plain events, two-item arrays, and several broken kinds."""
    events = analytics_events(spark, folder, stream=stream)
    ms = clock.epoch_ms(F.col("ts")).cast("string")
    name = F.col("event")
    good = F.concat(
        F.lit('{"event":"'), name, F.lit('","projectId":"'), F.col("project_id"),
        F.lit('","userId":"'), F.col("user_id"), F.lit('","timestamp":'), ms,
        F.lit(',"properties":'), F.col("properties"), F.lit("}"),
    )
    no_event = F.concat(
        F.lit('{"projectId":"'), F.col("project_id"), F.lit('","timestamp":'), ms, F.lit("}")
    )
    text_time = F.concat(
        F.lit('{"event":"'), name, F.lit('","projectId":"'), F.col("project_id"),
        F.lit('","timestamp":"'), ms, F.lit('"}'),
    )
    null_user = F.concat(
        F.lit('{"event":"'), name, F.lit('","projectId":"'), F.col("project_id"),
        F.lit('","userId":null,"timestamp":'), ms, F.lit("}"),
    )
    list_props = F.concat(
        F.lit('{"event":"'), name, F.lit('","projectId":"'), F.col("project_id"),
        F.lit('","timestamp":'), ms, F.lit(',"properties":[1]}'),
    )
    number_event = F.concat(
        F.lit('{"event":7,"projectId":"'), F.col("project_id"), F.lit('","timestamp":'),
        ms, F.lit("}"),
    )
    case = F.col("event_id") % 40
    return events.select(
        "event_id",
        F.col("ts").alias("arrival_ts"),
        F.col("project_id").alias("message_key"),
        F.when(case == 1, no_event)
        .when(case == 2, text_time)
        .when(case == 3, null_user)
        .when(case == 4, list_props)
        .when(case == 5, number_event)
        .when(case == 6, F.lit("null"))
        .when(case == 7, F.substring(good, 1, 20))
        .when(case == 8, F.concat(F.lit("["), good, F.lit(","), no_event, F.lit("]")))
        .when(case == 9, F.concat(F.lit("["), good, F.lit(",5]")))
        .otherwise(good)
        .alias("body"),
    )


def tracked_properties(spark: SparkSession, folder: str) -> DataFrame:
    """Events with a richer property object: page, device text and address."""
    events = table(spark, folder, "events")
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"), "c_nationkey"
    )
    address = F.concat_ws(
        ".",
        F.lit("10"),
        F.col("c_nationkey").cast("string"),
        (F.col("event_id") % 256).cast("string"),
        (F.col("user_id") % 256).cast("string"),
    )
    agent = pick(F.col("event_id") % 6, SAMPLE_AGENTS)
    return events.join(customers, "user_id").select(
        "event_id",
        "ts",
        F.concat(F.lit("proj_"), (F.col("user_id") % 4).cast("string")).alias("project_id"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("user_id"),
        F.col("event_type").alias("event"),
        F.when(F.col("event_id") % 5 == 1, F.lit(""))
        .when(F.col("event_id") % 5 == 2, F.lit(None))
        .otherwise(address)
        .alias("ip"),
        F.when(F.col("event_id") % 5 < 3, address).alias("client_ip"),
        agent.alias("user_agent"),
    )


# Sample agent texts, the last one empty.
SAMPLE_AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko)"
    " Chrome/120.0.0.0 Safari/537.36",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_1 like Mac OS X) AppleWebKit/605.1.15"
    " (KHTML, like Gecko) Version/17.1 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (X11; Ubuntu; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0",
    "Mozilla/5.0 (Linux; Android 13; SM-G991B) AppleWebKit/537.36 (KHTML, like Gecko)"
    " Chrome/119.0.0.0 Mobile Safari/537.36",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15"
    " (KHTML, like Gecko) Version/17.0 Safari/605.1.15",
    "",
]


def geo_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """One address block per nation; its last quarter belongs to nobody."""
    base = F.lit(10 << 24).cast("bigint") + F.col("n_nationkey") * PREFIX_SIZE
    return table(spark, folder, "nation").select(
        base.alias("start_ip"),
        (base + PREFIX_SIZE * 3 // 4 - 1).alias("end_ip"),
        F.col("n_name").alias("country"),
        F.concat(F.lit("city_"), F.col("n_nationkey").cast("string")).alias("city"),
    )


def geo_ranges6(spark: SparkSession, folder: str) -> DataFrame:
    """A /48 per nation, two /64 inside it that are one range, and a range around some of them."""
    nation = table(spark, folder, "nation")
    net = F.concat(F.lit("2001:db8:"), F.lower(F.hex("n_nationkey")))
    ends = lambda low, high, city: nation.select(
        F.concat(net, F.lit(low)).alias("start_ip"),
        F.concat(net, F.lit(high)).alias("end_ip"),
        F.col("n_name").alias("country"),
        city.alias("city"),
    )
    city = F.concat(F.lit("city_"), F.col("n_nationkey").cast("string"))
    outer = spark.createDataFrame(
        [("2001:DB8:0:0:0:0:0:0", "2001:db8:ff:ffff:ffff:ffff:255.255.255.255", "ANY", "outer"), ("no", "::1", "NO", "no")],
        "start_ip string, end_ip string, country string, city string",
    )
    whole = ends("::", ":ffff:ffff:ffff:ffff:ffff", city)
    return whole.unionByName(ends(":1::", ":2:ffff:ffff:ffff:ffff", F.lit("inner"))).unionByName(outer)


def ipv6_events(spark: SparkSession, folder: str) -> DataFrame:
    """`event_id, address`: one of eight spellings for each event."""
    nation = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    rows = table(spark, folder, "events").join(nation, F.col("user_id") == F.col("c_custkey"))
    key, event = F.col("c_nationkey"), F.col("event_id")
    digits = lambda value: F.lower(F.hex(value))
    ipv4 = F.concat(F.lit("10."), key.cast("string"), F.lit("."), (event % 256).cast("string"), F.lit(".7"))
    spellings = [
        F.concat(F.lit("2001:db8:"), digits(key), F.lit("::"), digits(event % 65536)),
        F.concat(F.lit("2001:0DB8:"), F.lpad(F.hex(key), 4, "0"), F.lit(":0002:0:0:ABCD:"), F.hex(event % 65536)),
        F.concat(F.lit("2001:db8:"), digits(key), F.lit(":3::"), ipv4),
        F.concat(F.lit("::ffff:"), ipv4),
        F.concat(F.lit("0:0:0:0:0:FFFF:0a"), F.lpad(digits(key), 2, "0"), F.lit(":"), digits((event % 256) * 256 + 7)),
        ipv4,
        F.concat(F.lit("2001:db8:"), digits(key + 32), F.lit("::1")),
        F.when(event % 16 == 7, F.concat(F.lit("2001:db9::"), digits(key))).when(event % 32 == 15, F.lit("1::2::3")),
    ]
    spelling = F.lit(None).cast("string")
    for i, text in enumerate(spellings):
        spelling = F.when(event % 8 == i, text).otherwise(spelling)
    return rows.select("event_id", spelling.alias("address"))


def property_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Property rules per (project, event), one set for each project.

    Purchases need a coupon, errors need a text `k`, sign-ups a numeric one,
    clicks an integer `k` and a page; views have no rule.
    """
    rules = F.array(
        _rule("purchase", '{"required":["k","coupon"],"properties":{"k":{"type":"number"}}}'),
        _rule("error", '{"required":["k"],"properties":{"k":{"type":"string"}}}'),
        _rule("signup", '{"properties":{"k":{"type":"number"},"z":{"type":"boolean"}}}'),
        _rule(
            "click",
            '{"required":["page"],"properties":{"page":{"type":"string"},"k":{"type":"boolean"}}}',
        ),
    )
    return projects(spark, folder).select("project_id", F.inline(rules))


def _rule(event: str, schema: str) -> Column:
    return F.struct(F.lit(event).alias("event"), F.lit(schema).alias("schema"))


def schema_changes(spark: SparkSession, folder: str) -> DataFrame:
    """A change log of property rules: one change per event row."""
    events = analytics_events(spark, folder)
    return events.select(
        "project_id",
        "event",
        F.concat(F.lit('{"required":["f'), F.col("event_id").cast("string"), F.lit('"]}')).alias(
            "schema"
        ),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("changed_at"),
    )


def dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    """Rejected messages as first stored: one per event of type `error`."""
    events = analytics_events(spark, folder).where(F.col("event") == "error")
    number = F.col("event_id")
    return events.select(
        number.alias("id"),
        pick(number % 2, ["raw-events", "enriched-events"]).alias("original_topic"),
        (number % 8).cast("int").alias("original_partition"),
        number.cast("string").alias("original_offset"),
        F.col("project_id").alias("original_key"),
        F.col("properties").alias("original_value"),
        F.create_map(F.lit("traceId"), number.cast("string")).alias("original_headers"),
        F.concat(
            F.when(number % 3 == 0, F.lit("Schema validation failed"))
            .when(number % 3 == 1, F.lit("Project schema validation failed"))
            .otherwise(F.lit("Connection lost")),
            F.lit(": "),
            number.cast("string"),
        ).alias("reason"),
        F.col("ts").alias("created_at"),
    )


def dead_letter_log(spark: SparkSession, folder: str) -> DataFrame:
    """Status log of the dead letters: retried, discarded, failed again."""
    letters = dead_letters(spark, folder)
    number = F.col("id")

    def step(seq: int, status: str, error: str | None = None) -> Column:
        return F.struct(
            F.lit(seq).alias("seq"),
            F.lit(status).alias("status"),
            F.lit(error).cast("string").alias("last_error"),
        )

    steps = (
        F.when(
            number % 3 == 0, F.array(step(0, "pending"), step(1, "retrying"), step(2, "retried"))
        )
        .when(number % 7 == 0, F.array(step(0, "pending"), step(1, "discarded")))
        .when(
            number % 11 == 0,
            F.array(step(0, "pending"), step(1, "retrying"), step(2, "pending", "broker down")),
        )
        .otherwise(F.array(step(0, "pending")))
    )
    return letters.select("id", F.col("created_at").alias("letter_at"), F.inline(steps)).select(
        "id",
        "seq",
        "status",
        "last_error",
        (F.col("letter_at") + F.make_dt_interval(mins=F.col("seq"))).alias("at"),
    )


def stage_events(spark: SparkSession, folder: str) -> DataFrame:
    """What each stage did with every arrival, with its timings."""
    seen = arrivals(spark, folder)
    duplicate = F.col("seq") == 1
    rejected = F.col("event") == "error"
    stages = F.filter(
        F.array(
            F.lit("received"),
            F.when(duplicate, F.lit("deduped")),
            F.when(~duplicate & rejected, F.lit("rejected")),
            F.when(~duplicate & rejected, F.lit("dead_lettered")),
            F.when(~duplicate & ~rejected, F.lit("valid")),
            F.when(~duplicate & ~rejected, F.lit("processed")),
            F.when(~duplicate & ~rejected, F.lit("stored")),
        ),
        lambda s: s.isNotNull(),
    )
    return seen.select("event_id", F.explode(stages).alias("stage"), F.col("arrival_ts").alias("at"))


def timed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Start and end of the processing of every event.

    The event's own value, read as hundredths of a millisecond, is the time it
    took.
    """
    events = table(spark, folder, "events")
    spent = F.round(F.col("value") * 10000).cast("bigint")
    started = clock.micros(F.col("ts"))
    return events.select(
        "event_id",
        F.col("event_type").alias("stage"),
        clock.from_micros(started).alias("started_at"),
        clock.from_micros(started + spent).alias("finished_at"),
    )
