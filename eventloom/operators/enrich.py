"""Enrichment: address and agent, location, device, session."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import address as ip
from eventloom.functions import agents, clock, identity
from eventloom.functions import json_values as jv
from eventloom.operators.anchors import attach_anchors
from eventloom.session import materialise, ship_package

# Fixed value: length of a session; it is not extended by activity.
SESSION_SECONDS = 1800

# Ranges up to this count of pieces may be looked up next to the events.
SMALL_RANGES = 100_000


def extract_context(events: DataFrame, ip: Column, client_ip: Column, agent: Column) -> DataFrame:
    """Add `address` and `agent`; an empty address falls through to the next."""
    chosen = F.coalesce(F.nullif(ip, F.lit("")), F.nullif(client_ip, F.lit("")))
    return events.withColumns({"address": chosen, "agent": F.nullif(agent, F.lit(""))})


def context_from_properties(events: DataFrame, properties_col: str = "properties") -> DataFrame:
    """`extract_context` from a property object (VARIANT)."""
    part = lambda name: jv.text(jv.field(F.col(properties_col), name))
    return extract_context(events, part("ip"), part("clientIp"), part("userAgent"))


def geo_enrich(
    events: DataFrame,
    ranges: DataFrame,
    address_col: str = "address",
    small_ranges: int = SMALL_RANGES,
    ranges6: DataFrame | None = None,
) -> DataFrame:
    """Add `country` and `city` of the address; NULL without address or range.

    An IPv6 address that stands for an IPv4 one has the place of the latter. Other
    ones are found in `ranges6`, see `locate_ipv6`, and have no place without it.

    `ranges` are (start_ip, end_ip, country, city). Where they overlap, the
    shortest one holds an address, then the one that starts last: overlaps are
    cut first, so that both ways of looking up see the same disjoint pieces. A
    range join becomes an equality join on the upper 16 bits. Where the ranges
    are few, counted and not assumed, that join runs on the events as they are.
    Otherwise the distinct addresses are located first and joined back.
    """
    address = F.col(address_col)
    digits = ip.ipv6_hex(address)
    number = F.coalesce(ip.ipv4_number(address), ip.mapped_number(digits))
    numbered = events.withColumn("ip_number", number)
    pieces = _disjoint(_by_prefix(ranges))
    # Cutting at the borders of a prefix gives at most two pieces for each of its ranges.
    cuts = ranges.agg(F.sum(ip.prefix_of(F.col("end_ip")) - ip.prefix_of(F.col("start_ip")) + 1))
    if (cuts.first()[0] or 0) <= small_ranges:
        located = numbered.withColumn("prefix", ip.prefix_of(F.col("ip_number"))).alias("e")
        inside = (F.col("e.prefix") == F.col("r.prefix")) & F.col("e.ip_number").between(
            F.col("r.start_ip"), F.col("r.end_ip")
        )
        placed = located.join(F.broadcast(pieces.alias("r")), inside, "left").select(
            *[F.col(f"e.{name}") for name in events.columns], "r.country", "r.city"
        )
    else:
        # One row without a number may stay: a filter would read every address a second time.
        places = _locate(numbered.select("ip_number").distinct(), pieces)
        # Events without a number match nothing; a salt below zero spreads them over the tasks.
        salt = -1 - F.monotonically_increasing_id() % 1024
        keyed = numbered.withColumn("ip_number", F.coalesce("ip_number", salt))
        placed = keyed.join(places, "ip_number", "left").drop("ip_number")
    if ranges6 is None:
        return placed
    asked = ip.unmapped(digits)
    found = locate_ipv6(events.select(asked.alias("ip6")).dropna().distinct(), ranges6)
    found = found.select("ip6", F.struct("country", "city").alias("place"))
    # Events without such an address match nothing; a salt spreads them over the tasks.
    spread = F.concat(F.lit("-"), (F.monotonically_increasing_id() % 1024).cast("string"))
    joined = placed.withColumn("ip6", F.coalesce(asked, spread)).join(found, "ip6", "left")
    return joined.select(
        *events.columns,
        F.coalesce("place.country", "country").alias("country"),
        F.coalesce("place.city", "city").alias("city"),
    )


def locate_ipv6(addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """`ip6, country, city` of addresses that a range holds; `ip6` are 32 hex digits.

    `ranges` are (start_ip, end_ip, country, city) with addresses as texts. Each range is
    cut into prefixes; an address is looked up by its own prefix of every length that occurs,
    all in one equality join. Where several ranges hold it, the shortest one counts, then the
    one that starts last. Ranges that are not valid hold nothing.
    """
    ship_package(ranges.sparkSession)
    cut = ranges.select(
        ip.ipv6_hex(F.col("start_ip")).alias("low"), ip.ipv6_hex(F.col("end_ip")).alias("high"), "country", "city"
    ).where("low <= high")
    prefixes = materialise(
        cut.mapInArrow(
            _prefixes, "bits int, prefix string, length string, low string, country string, city string"
        )
    )
    # An address has 129 prefixes at most.
    lengths = sorted(r["bits"] for r in prefixes.select("bits").distinct().collect())
    if not lengths:
        return addresses.select("ip6", *[F.lit(None).cast("string").alias(c) for c in ("country", "city")]).limit(0)
    own = F.array(
        *[F.struct(F.lit(n).alias("bits"), ip.ipv6_prefix(F.col("ip6"), n).alias("prefix")) for n in lengths]
    )
    hits = addresses.select("ip6", F.inline(own)).join(prefixes, ["bits", "prefix"])
    # Starts are of equal length, so the last one is the least when its digits are mirrored.
    later = F.translate("low", ip.HEX, ip.HEX[::-1])
    best = F.min_by(F.struct("country", "city"), F.struct("length", later, "country", "city"))
    return hits.groupBy("ip6").agg(best.alias("place")).select("ip6", "place.country", "place.city")


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefixes of each range (low, high, country, city), with its length and start in hex."""
    for batch in batches:
        bits, found, lengths, rows = [], [], [], []
        low, high = (batch.column(i).to_pylist() for i in range(2))
        for row, ends in enumerate(zip(low, high, strict=True)):
            first, last = (ipaddress.IPv6Address(int(end, 16)) for end in ends)
            for network in ipaddress.summarize_address_range(first, last):
                bits.append(network.prefixlen)
                found.append(f"{int(network.network_address):032x}"[: -(-network.prefixlen // 4)])
                lengths.append(f"{int(last) - int(first):032x}")
                rows.append(row)
        taken = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(bits, pa.int32()),
                pa.array(found, pa.string()),
                pa.array(lengths, pa.string()),
                *[batch.column(i).take(taken) for i in (0, 2, 3)],
            ],
            ["bits", "prefix", "length", "low", "country", "city"],
        )


def _by_prefix(ranges: DataFrame) -> DataFrame:
    """Ranges cut at the borders of their prefixes."""
    cut = ranges.withColumn(
        "prefix",
        F.explode(F.sequence(ip.prefix_of(F.col("start_ip")), ip.prefix_of(F.col("end_ip")))),
    )
    floor = F.col("prefix") * ip.PREFIX_SIZE
    return cut.select(
        "prefix",
        F.greatest("start_ip", floor).alias("start_ip"),
        F.least(F.col("end_ip"), floor + ip.PREFIX_SIZE - 1).alias("end_ip"),
        "country",
        "city",
        (F.col("end_ip") - F.col("start_ip")).alias("length"),
        F.col("start_ip").alias("range_start"),
    )


def _disjoint(pieces: DataFrame) -> DataFrame:
    """Pieces of which no two overlap: each stretch belongs to the most specific range.

    Only prefixes in which ranges overlap are cut. A stretch lies between two
    neighbouring borders; of the pieces that cover it one is chosen.
    """
    before = Window.partitionBy("prefix").orderBy("start_ip", "end_ip")
    earlier = F.max("end_ip").over(before.rowsBetween(Window.unboundedPreceding, -1))
    marked = pieces.withColumn(
        "mixed",
        F.max(F.coalesce(earlier >= F.col("start_ip"), F.lit(False))).over(
            Window.partitionBy("prefix")
        ),
    )
    columns = ["prefix", "start_ip", "end_ip", "country", "city"]
    mixed = marked.where("mixed")
    borders = (
        mixed.select("prefix", F.explode(F.array("start_ip", F.expr("end_ip + 1"))).alias("start"))
        .distinct()
        .withColumn("stop", F.lead("start").over(Window.partitionBy("prefix").orderBy("start")) - 1)
        .where("stop is not null")
    )
    chosen = F.min_by(
        F.struct("country", "city"),
        F.struct("length", -F.col("range_start"), "country", "city"),
    )
    cut = (
        borders.join(mixed, "prefix")
        .where((F.col("start_ip") <= F.col("start")) & (F.col("end_ip") >= F.col("stop")))
        .groupBy("prefix", "start", "stop")
        .agg(chosen.alias("place"))
        .select(
            "prefix",
            F.col("start").alias("start_ip"),
            F.col("stop").alias("end_ip"),
            "place.country",
            "place.city",
        )
    )
    return marked.where("not mixed").select(*columns).unionByName(cut)


def _locate(addresses: DataFrame, pieces: DataFrame) -> DataFrame:
    """The last range that starts at or before each address.

    Both sides are merged per prefix; a prefix has at most 65,536 addresses and
    as many ranges, so no window grows with the events.
    """
    place = F.struct("start_ip", "end_ip", "country", "city")
    marks = pieces.select("prefix", F.col("start_ip").alias("at"), place.alias("range"))
    looked_up = addresses.select(
        ip.prefix_of(F.col("ip_number")).alias("prefix"),
        F.col("ip_number").alias("at"),
        F.lit(None).cast(marks.schema["range"].dataType).alias("range"),
    )
    before = Window.partitionBy("prefix").orderBy(
        F.col("at"), F.col("range").isNull()
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = marks.withColumn("asked", F.lit(False)).unionByName(
        looked_up.withColumn("asked", F.lit(True))
    )
    found = merged.withColumn("hit", F.last("range", ignorenulls=True).over(before))
    return (
        found.where(F.col("asked") & (F.col("at") <= F.col("hit.end_ip")))
        .select(F.col("at").alias("ip_number"), "hit.country", "hit.city")
    )


def ua_enrich(events: DataFrame, agent_col: str = "agent") -> DataFrame:
    """Add `browser`, `os` and `device_type` of the agent text."""
    agent = F.col(agent_col)
    return events.withColumns(
        {
            "browser": agents.browser(agent),
            "os": agents.system(agent),
            "device_type": agents.device_type(agent),
        }
    )


def sessionize(
    events: DataFrame, ts_col: str = "ts", ttl_seconds: int = SESSION_SECONDS, **options: int
) -> DataFrame:
    """Add `session_id`; events without a user have none."""
    named = events.withColumn("session_user", F.nullif(F.col("user_id"), F.lit("")))
    keys = ["project_id", "session_user"]
    anchored = attach_anchors(named, keys, ts_col, ttl_seconds, **options)
    session = identity.session_id(F.col("project_id"), F.col("user_id"), F.col("anchor_us"))
    return anchored.withColumn(
        "session_id", F.when(F.col("anchor_us").isNotNull(), session)
    ).drop("session_user", "anchor_us")


def enrich_project(
    events: DataFrame, ranges: DataFrame, ts_col: str = "ts", properties_col: str = "properties"
) -> DataFrame:
    """All enrichment columns and the two processing times for valid events.

    Sessions come first: they read the events twice, and so only the plain ones.
    """
    contextual = context_from_properties(sessionize(events, ts_col), properties_col)
    return ua_enrich(geo_enrich(contextual, ranges)).drop("address", "agent").withColumns(
        {"validated_at": F.current_timestamp(), "enriched_at": F.current_timestamp()}
    )


# Stored text columns; a missing text is stored as ''.
STORED_TEXTS = (
    "user_id", "session_id", "country", "city", "device_type", "browser", "os",
)


def normalise_event_row(enriched: DataFrame, *keep: str) -> DataFrame:
    """Events in stored form: no NULL texts, properties as JSON text."""
    kind = enriched.schema["properties"].dataType.typeName()
    properties = F.col("properties")
    text = properties if kind == "string" else F.to_json(properties)
    return enriched.select(
        *keep,
        "project_id",
        "event",
        *[identity.text_or_empty(F.col(name)).alias(name) for name in STORED_TEXTS],
        F.coalesce(text, F.lit("{}")).alias("properties"),
        clock.from_epoch_ms(F.col("ts_ms")).cast("timestamp_ntz").alias("ts"),
    )
