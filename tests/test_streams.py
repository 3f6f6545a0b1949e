"""The streaming stages, in several batches and across restarts."""

from __future__ import annotations

import json
import pathlib
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventloom.operators import enrich, ingest, rollups
from eventloom.session import materialise, scratch_path, scratch_scope
from eventloom.sources import given, sinks, tables, topics
from eventloom.streaming import stages
from eventloom.streaming.state import MESSAGE_ID, once, run_anchors, with_anchors, with_quota

ONCE = {"availableNow": True}
BASE = 1_700_000_000_000


def put(spark, path, number, rows):
    """One file of messages: (key, value, arrival in seconds after BASE)."""
    frame = pd.DataFrame(
        [(k, v, {"h": "1"}, pd.Timestamp(BASE + int(s * 1000), unit="ms")) for k, v, s in rows],
        columns=["key", "value", "headers", "arrival_ts"],
    )
    spark.createDataFrame(frame, topics.FILE_SCHEMA).coalesce(1).write.parquet(f"{path}/{number}")


def body(event, user="u1", at=0.0, **properties):
    return json.dumps(
        {
            "event": event,
            "projectId": "p",
            "userId": user,
            "timestamp": BASE + int(at * 1000),
            "properties": properties,
            "deviceId": "dropped",
        }
    )


def drain(query):
    query.awaitTermination(120)
    assert query.exception() is None


def ingest_run(spark, tmp_path):
    source, raw = f"{tmp_path}/bodies", f"{tmp_path}/raw"
    same = body("view")
    batches = [
        [("p", same, 0), ("p", same, 10), ("p", "[" + same + "," + body("click") + "]", 20)],
        [("p", same, 40), ("p", "not json", 41), ("p", "null", 42), ("p", '{"event":1}', 43)],
        [("p", same, 200), ("p", body("late", at=3), 201)],
        [("p", body("end", at=9), 4000)],
    ]
    for number, rows in enumerate(batches):
        put(spark, source, number, rows)
        stream = topics.read_files(spark, source, topics.RAW)
        # A new query on the old checkpoint: a restart after every batch.
        sink, place = topics.to_files(raw), f"{tmp_path}/checkpoint"
        drain(stages.start_ingest(stream, sink, place, ONCE))
    found = spark.read.schema(topics.FILE_SCHEMA).option("recursiveFileLookup", "true").parquet(raw)
    return sorted(
        (json.loads(r.value)["event"], r.arrival_ts.timestamp() - BASE / 1000)
        for r in found.collect()
    )


ACCEPTED = [("click", 20), ("end", 4000), ("late", 201), ("view", 0), ("view", 200)]


def test_ingest_keeps_each_event_once_per_minute(spark, tmp_path):
    assert ingest_run(spark, tmp_path) == ACCEPTED


def test_replayed_batch_is_written_once(spark, tmp_path):
    sink = topics.to_files(f"{tmp_path}/topic")
    messages = spark.createDataFrame([("k", "v")], "key STRING, value STRING").withColumn(
        "headers", F.create_map().cast("map<string,string>")
    )
    sink(messages, 7)
    sink(messages, 7)
    sink(messages, 8)
    written = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/topic")
    assert written.count() == 2


def test_pipeline_from_raw_messages_to_stored_rows(spark, tmp_path):
    raw, enriched, dead = (f"{tmp_path}/{n}" for n in ("raw", "enriched", "dead"))
    rules = spark.createDataFrame(
        [("p", "buy", '{"required":["coupon"]}')], "project_id STRING, event STRING, schema STRING"
    )
    ranges = spark.createDataFrame(
        [(167772160, 167772160 + 255, "AA", "aa")],
        "start_ip BIGINT, end_ip BIGINT, country STRING, city STRING",
    )
    sent = [
        [
            ("p", body("view", at=0, ip="10.0.0.5", userAgent="Mozilla/5.0 (X11; Linux) Firefox/1"), 0),
            ("p", body("view", at=10, user="u2"), 10),
            ("p", body("buy", at=11), 11),
            ("p", "{broken", 12),
        ],
        [
            ("p", body("view", at=70, user=""), 70),
            ("p", body("view", at=1700), 1700),
            ("p", body("buy", at=1799, coupon="x"), 1799),
        ],
        [("p", body("view", at=1800), 1800), ("p", body("view", at=5), 1801)],
        [("p", body("view", at=9000, user="u9"), 9000)],
    ]
    for number, rows in enumerate(sent):
        put(spark, raw, number, rows)
        drain(
            stages.start_enrichment(
                topics.read_files(spark, raw, topics.RAW),
                rules,
                ranges,
                topics.to_files(enriched),
                topics.to_files(dead),
                f"{tmp_path}/c1",
                ONCE,
            )
        )
        drain(
            stages.start_storage(
                topics.read_files(spark, enriched, topics.ENRICHED),
                f"{tmp_path}/events",
                f"{tmp_path}/rollups",
                topics.to_files(f"{tmp_path}/dead2"),
                f"{tmp_path}/c2",
                ONCE,
            )
        )
    stored = tables.read_events(spark, f"{tmp_path}/events")
    rows = {
        (r.event, (r.ts - pd.Timestamp(BASE, unit="ms")).total_seconds()): r
        for r in stored.collect()
    }
    assert len(rows) == 8
    first = rows["view", 0]
    assert (first.country, first.city, first.browser, first.os) == ("AA", "aa", "Firefox", "Linux")
    assert rows["view", 10].country == "" and rows["view", 10].device_type == "unknown"
    assert rows["view", 70].session_id == ""
    # Sessions last 1800 s from their first event and are not extended.
    assert first.session_id == rows["view", 1700].session_id == rows["buy", 1799].session_id
    assert first.session_id not in (rows["view", 1800].session_id, rows["view", 10].session_id)
    assert rows["view", 5].session_id == rows["view", 1800].session_id

    again = enrich.sessionize(
        spark.createDataFrame(
            [("p", "u1", BASE + s * 1000) for s in (0, 1700, 1799, 1800)],
            "project_id STRING, user_id STRING, ms BIGINT",
        ).withColumn("ts", F.timestamp_millis("ms"))
    ).orderBy("ts")
    assert [r.session_id for r in again.collect()] == [
        rows[k].session_id for k in (("view", 0), ("view", 1700), ("buy", 1799), ("view", 1800))
    ]

    counts = sinks.read_rollups(spark, f"{tmp_path}/rollups")
    exact = rollups.build_rollups(stored).select(
        "project_id", "event", "bucket", "count", "unique_users"
    )
    keys = ["project_id", "event", "bucket", "count", "unique_users"]
    assert sorted(counts.select(*keys).collect()) == sorted(exact.collect())

    drain(
        stages.start_dead_letters(
            topics.read_files(spark, dead, topics.DEAD_LETTER),
            f"{tmp_path}/letters",
            f"{tmp_path}/log",
            f"{tmp_path}/c3",
            ONCE,
        )
    )
    letters = spark.read.parquet(f"{tmp_path}/letters").orderBy("reason").collect()
    assert [r.reason for r in letters] == [
        "Malformed message",
        'Project schema validation failed: ["Missing required property: coupon"]',
    ]
    assert letters[1].original_headers == {"h": "1"} and letters[1].original_topic == topics.RAW
    log = spark.read.parquet(f"{tmp_path}/log").collect()
    assert [r.status for r in log] == ["pending", "pending"]


def test_live_feed_counts_late_events(spark, tmp_path):
    source, live = f"{tmp_path}/enriched", f"{tmp_path}/live"
    batches = [
        [("p", body("view", at=s, user=f"u{s % 2}"), s) for s in (0, 1, 2, 61)],
        [("p", body("view", at=s, user="u5"), s) for s in (3, 62, 500)],
        [("p", body("view", at=1000, user="u0"), 1000)],
        [("p", body("view", at=4, user="u6"), 2000)],  # its minute is long over
    ]
    for number, rows in enumerate(batches):
        put(spark, source, number, rows)
        drain(
            stages.start_live_feed(
                topics.read_files(spark, source, topics.ENRICHED),
                topics.to_files(live),
                f"{tmp_path}/rollups",
                f"{tmp_path}/c",
                ONCE,
            )
        )
    start = BASE - BASE % 60_000
    seen = []
    for number in range(4):
        messages = [json.loads(r.value) for r in spark.read.parquet(f"{live}/batch={number}").collect()]
        assert {m["type"] for m in messages} <= {"metric_update"}
        seen.append(
            {(m["timestamp"] - start) // 60_000: (m["count_1m"], m["active_users"]) for m in messages}
        )
    minute = {s: (BASE + s * 1000 - start) // 60_000 for s in (0, 61, 500, 1000)}
    assert seen == [
        {minute[0]: (3, 2), minute[61]: (1, 2)},
        {minute[0]: (4, 3), minute[61]: (2, 3), minute[500]: (1, 3)},
        {minute[1000]: (1, 3)},
        {minute[0]: (5, 4)},
    ]


def test_live_feed_counts_many_users_exactly(spark, tmp_path):
    """Two batches with 3000 users of a day in common, and one of them again."""
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    days = []
    for batch_id, (low, high) in [(0, (0, 0)), (1, (0, 4000)), (2, (1000, 5000)), (2, (1000, 5000))]:
        events = spark.range(low, high).select(
            F.lit("p").alias("project_id"), F.lit("e").alias("event"),
            F.concat(F.lit("u"), "id").alias("user_id"), at.alias("ts"),
        )
        rows = stages.live_updates(events, batch_id, f"{tmp_path}/rollups").collect()
        days.append([(json.loads(r.value)["count_1m"], json.loads(r.value)["active_users"]) for r in rows])
    assert days == [[], [(4000, 4000)], [(8000, 5000)], [(8000, 5000)]]


def run_batches(spark, path, parts, stateful, replay=()):
    """Rows after each part, every one by a new query on the old checkpoint; some run again."""
    progress = []

    def on_batch(batch, number):
        sinks.write_batch(batch.withColumn("part", F.lit(len(progress))), number, f"{path}/rows")

    for number, part in enumerate(parts):
        part.write.mode("append").parquet(f"{path}/source")
        for again in range(1 + (number in replay)):
            if again:
                # The last batch was written, but not noted as done.
                done = pathlib.Path(f"{path}/checkpoint/commits")
                last = max(int(f.name) for f in done.iterdir() if f.name.isdigit())
                for name in (str(last), f".{last}.crc"):
                    (done / name).unlink(missing_ok=True)
            stream = spark.readStream.schema(part.schema).parquet(f"{path}/source")
            query = (
                stateful(stream)
                .writeStream.foreachBatch(on_batch)
                .option("checkpointLocation", f"{path}/checkpoint")
                .trigger(**ONCE)
                .start()
            )
            drain(query)
        progress.append(query.lastProgress)
    return spark.read.parquet(f"{path}/rows"), progress


@pytest.mark.parametrize("replay", [(), (1,)])
def test_batch_and_stream_duplicates_agree(spark, folder, tmp_path, replay):
    """Arrivals of the given events in three batches, the second one twice."""
    keyed = ingest.with_dedup_key(given.arrivals(spark, folder))
    accepted = ingest.dedup_events(keyed).where("status = 'accepted'")
    wanted = sorted((r.event_id, r.seq) for r in accepted.collect())
    edges = keyed.approxQuantile("ts_ms", [0.33, 0.66], 0.01)
    parts = [
        keyed.where(F.col("ts_ms") < edges[0]),
        keyed.where((F.col("ts_ms") >= edges[0]) & (F.col("ts_ms") < edges[1])),
        keyed.where(F.col("ts_ms") >= edges[1]),
    ]
    marked, _ = run_batches(
        spark, tmp_path, parts,
        lambda stream: with_anchors(stream, ["dedup_key"], "arrival_ts", 60, 60, "seq"), replay,
    )
    assert sorted((r.event_id, r.seq) for r in marked.where("sets_anchor").collect()) == wanted
    # Every column comes back as it was.
    back = marked.select(*keyed.columns)
    assert back.schema.simpleString() == keyed.schema.simpleString()
    assert back.exceptAll(keyed).isEmpty() and keyed.exceptAll(back).isEmpty()


def seconds_frame(spark, rows):
    frame = spark.createDataFrame([(k, s, i) for i, (k, s) in enumerate(rows)], "k STRING, s BIGINT, i BIGINT")
    return frame.withColumn("ts", F.timestamp_seconds("s"))


def test_state_goes_on_and_is_forgotten(spark, tmp_path):
    batches = [
        [("a", 0), ("a", 30), (None, 1), (None, 1), ("x", None)],
        [("a", 59), ("a", 60), ("b", 60)],
        [("a", 50), ("a", 119)],  # a late event joins the running anchor
        [("c", 5000)],
        [("a", 10)],  # far behind the watermark, yet it is there
        [("d", 5001)],
        [("e", 5002)],
    ]
    wanted = [
        [(None, 1, None, False), (None, 1, None, False), ("a", 0, 0, True), ("a", 30, 0, False), ("x", None, None, False)],
        [("a", 59, 0, False), ("a", 60, 60, True), ("b", 60, 60, True)],
        [("a", 50, 60, False), ("a", 119, 60, False)],
        [("c", 5000, 5000, True)],
        None,  # joins the anchor at 60, or sets its own where that is forgotten
        [("d", 5001, 5001, True)],
        [("e", 5002, 5002, True)],
    ]
    found, progress = run_batches(
        spark, tmp_path, [seconds_frame(spark, rows) for rows in batches],
        lambda stream: with_anchors(stream, ["k"], "ts", 60, 60, "i"),
    )
    rows = found.collect()
    for number, part in enumerate(wanted):
        got = [
            (r.k, r.s, None if r.anchor_us is None else r.anchor_us // 1_000_000, r.sets_anchor)
            for r in rows
            if r.part == number
        ]
        if part is None:
            assert got in ([("a", 10, 60, False)], [("a", 10, 10, True)])
        else:
            assert sorted(got, key=repr) == sorted(part, key=repr)


def test_what_is_over_leaves_the_state(spark, tmp_path):
    """Keys go once the watermark has passed their end, not by the clock on the wall."""

    def batches():
        for rows in ([("a", 0), ("b", 0)], [("c", 1)], [("d", 1)], [("e", 9000)], [("f", 9000)], [("g", 9000)]):
            if rows[0][0] in "dg":
                time.sleep(2.2)
            yield seconds_frame(spark, rows)

    _, progress = run_batches(
        spark, tmp_path, batches(),
        lambda stream: with_anchors(stream, ["k"], "ts", 1, 1, "i"),
    )
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    # Two seconds of the wall pass, but the stream stands at its first second.
    assert kept[:3] == [2, 3, 4]
    assert kept[-1] == 3


def test_calls_are_bounded_by_groups_not_keys(spark, tmp_path, monkeypatch):
    """Many keys share a group: each keeps its own anchor, and the state has a row per group."""
    monkeypatch.setattr("eventloom.streaming.state.ANCHOR_GROUPS", 4)
    keys = [f"k{i}" for i in range(300)]
    batches = [
        [(k, i) for i, k in enumerate(keys)] + [(k, 400 + i) for i, k in enumerate(keys)],
        [(k, 430 + i) for i, k in enumerate(keys)] + [(k, 460 + i) for i, k in enumerate(keys)] + [(None, 1)],
    ]
    found, progress = run_batches(
        spark, tmp_path, [seconds_frame(spark, rows) for rows in batches],
        lambda stream: with_anchors(stream, ["k"], "ts", 60, 1000, "i"),
    )
    got = {(r.k, r.s): (r.anchor_us // 1_000_000, r.sets_anchor) for r in found.where("k is not null").collect()}
    wanted = {}
    for i, k in enumerate(keys):
        wanted |= {(k, at + i): (at + i, True) for at in (0, 400, 460)} | {(k, 430 + i): (400 + i, False)}
    assert got == wanted
    assert [p["stateOperators"][0]["numRowsTotal"] for p in progress] == [4, 4]


def test_anchors_of_many_keys_in_one_walk():
    """Same as a loop over each key's rows; of ties at one instant the least sets the anchor."""
    rng = np.random.default_rng(7)
    codes, us = rng.integers(0, 40, 2000), rng.integers(0, 500, 2000)
    ties = np.array([json.dumps({"i": int(i)}) for i in rng.permutation(2000)], dtype=object)
    before = [int(at) if at % 3 else None for at in rng.integers(0, 300, 40)]
    running = list(before)
    anchor, setters = run_anchors(codes, us, ties, running, 60)
    wanted, setting = np.zeros(2000, dtype=np.int64), set()
    for code in range(40):
        run = before[code]
        own = np.flatnonzero(codes == code)
        for i in sorted(own, key=lambda i: (us[i], json.loads(ties[i])["i"])):
            if run is None or us[i] >= run + 60:
                run = us[i]
                setting.add(int(i))
            wanted[i] = run
        assert running[code] == run
    assert (anchor == wanted).all() and set(setters) == setting


def test_a_few_large_partitions_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    """Files of a batch are bounded, so the next stage is spread however the rows were dealt."""
    monkeypatch.setattr("eventloom.sources.topics.FILE_MESSAGES", 10)
    rows = spark.range(95).coalesce(1).select(
        F.lit("p").alias("key"), F.col("id").cast("string").alias("value"),
        F.create_map(F.lit("h"), F.lit("1")).alias("headers"), F.timestamp_seconds("id").alias("arrival_ts"),
    )
    topics.to_files(f"{tmp_path}/topic")(rows, 0)
    assert len(list(pathlib.Path(f"{tmp_path}/topic/batch=0").glob("*.parquet"))) == 10
    found = spark.read.parquet(f"{tmp_path}/topic")
    assert sorted(int(r.value) for r in found.collect()) == list(range(95))


def test_storage_holds_the_text_of_broken_messages_only(spark, tmp_path, monkeypatch):
    """A batch is held while it is written; good events travel as columns."""
    good = json.dumps({"event": "view", "projectId": "p", "timestamp": BASE, "userId": "u"})
    messages = spark.createDataFrame([("p", good, None), ("p", "no json", {"h": "1"})], "key string, value string, headers map<string,string>")
    monkeypatch.setattr(stages, "_run", lambda stream, *rest: stream)
    held = stages.start_storage(messages, f"{tmp_path}/e", f"{tmp_path}/r", None, f"{tmp_path}/c")
    rows = {r.project_id: r for r in held.collect()}
    assert (rows["p"].value, rows["p"].key, rows["p"].event) == (None, None, "view")
    assert (rows[None].value, rows[None].key, rows[None].headers) == ("no json", "p", {"h": "1"})


def test_quota_is_decided_in_its_batch(spark, tmp_path):
    batches = [
        [("a", 0), ("a", 5), ("b", 1)],
        [("a", 59), ("a", 3), ("a", 60), (None, 7)],  # one more of the first minute: the earlier
        [("a", 1), ("a", 61), ("a", 62), ("a", 63)],
    ]
    found, _ = run_batches(
        spark, tmp_path, [seconds_frame(spark, rows) for rows in batches],
        lambda stream: with_quota(stream, "k", "ts", ["i"], 3, 60, 600),
    )
    got = sorted(((r.part, r.k or "", r.s, r.allowed, r.remaining) for r in found.collect()))
    assert got == [
        (0, "a", 0, True, 2), (0, "a", 5, True, 1), (0, "b", 1, True, 2),
        (1, "", 7, True, 2), (1, "a", 3, True, 0), (1, "a", 59, False, 0), (1, "a", 60, True, 2),
        (2, "a", 1, False, 0), (2, "a", 61, True, 1), (2, "a", 62, True, 0), (2, "a", 63, False, 0),
    ]


def test_messages_published_again_are_read_once(spark, tmp_path):
    def part(*rows):
        frame = spark.createDataFrame(
            [({MESSAGE_ID: i} if i else {"x": None}, f"v{i}", str(n), s) for n, (i, s) in enumerate(rows)],
            "headers map<string,string>, value string, offset string, s bigint",
        )
        time_ = F.timestamp_seconds("s").alias("arrival_ts")
        return frame.select("headers", "value", F.lit("t").alias("topic"), F.lit(0).alias("partition"), "offset", time_)

    parts = [
        part(("a", 0), ("b", 1), ("a", 1), (None, 1), (None, 1)),
        part(("a", 50), ("b", 51), ("c", 52)),  # published again, with one that is new
        part(("a", 60), ("d", None), ("d", None)),  # later than ids are held; without a time
    ]
    found, _ = run_batches(spark, tmp_path, parts, lambda stream: once(stream, 60, 60))
    rows = sorted((r.part, r.value, str(r.headers.get("x", "-"))) for r in found.collect())
    assert rows == [
        (0, "vNone", "None"), (0, "vNone", "None"), (0, "va", "-"), (0, "vb", "-"),
        (1, "vc", "-"), (2, "va", "-"), (2, "vd", "-"), (2, "vd", "-"),
    ]


def test_scratch_tables_are_removed(spark):
    with scratch_scope(spark):
        table = materialise(spark.range(3))
        folder = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
        assert table.count() == 3 and pathlib.Path(folder).exists()
    assert not pathlib.Path(folder).exists()


def enriched(event, at):
    return json.dumps({"event": event, "projectId": "p", "userId": "u1", "timestamp": BASE + int(at * 1000)})


def test_a_message_is_parsed_once(spark):
    """Whatever is read of it, and whatever filters stand behind."""
    body = '{"event":"a","projectId":"p","timestamp":1704067200000,"userId":"u","country":"X"}'
    texts = F.element_at(F.array(F.lit(body), F.lit("{"), F.lit(None)), (F.col("id") + 1).cast("int"))
    stored = stages.stored_events(spark.range(3).select(texts.alias("value")))
    known = stored.where(F.col("project_id").isNotNull()).select("project_id", "event", "user_id", "country")
    assert known._jdf.queryExecution().executedPlan().toString().count("from_json(") == 1
    assert [tuple(row) for row in known.collect()] == [("p", "a", "u", "X")]
    assert stored.where(F.col("project_id").isNull()).count() == 2


def closing_run(spark, tmp_path, again=False):
    """The closing log after five batches, each by a new query; the last one may repeat."""
    source, log = f"{tmp_path}/enriched", f"{tmp_path}/log"
    # BASE is 20 seconds into a minute. (event, event time, arrival)
    batches = [
        [("a", 0, 0), ("a", 30, 31), ("a", 45, 50)],  # clock in minute 1: nothing closes
        [("a", 5, 170), ("b", 170, 170)],  # minute 3: minutes 0 and 1 close
        [("a", 10, 171), ("c", -300, 172)],  # late for minute 0, and for one that had no events
        [("a", 170, 20)],  # an old arrival does not turn the clock back
        [("d", 200, 4000)],  # everything closes
    ]
    for number, rows in enumerate(batches):
        put(spark, source, number, [("p", enriched(e, at), arrival) for e, at, arrival in rows])
        stream = topics.read_files(spark, source, topics.ENRICHED)
        run = lambda: drain(
            stages.start_closing(stream, log, f"{tmp_path}/rollups", f"{tmp_path}/checkpoint", ONCE)
        )
        run()
        if again:
            # The batch was written, but not noted as done.
            for name in (str(number), f".{number}.crc"):
                pathlib.Path(f"{tmp_path}/checkpoint/commits/{name}").unlink(missing_ok=True)
            run()
    start = (BASE // 60_000) * 60
    rows = spark.read.parquet(f"{log}/rows").collect()
    minute = lambda r: int((r["bucket"] - pd.Timestamp(start, unit="s")).total_seconds()) // 60
    return sorted((r["batch_id"], r["event"], minute(r), r["kind"], r["count"]) for r in rows)


@pytest.mark.parametrize("again", [False, True])
def test_minutes_close_once(spark, tmp_path, again):
    assert closing_run(spark, tmp_path, again) == [
        (1, "a", 0, "close", 3),
        (1, "a", 1, "close", 1),
        (2, "a", 0, "correction", 1),
        (2, "c", -5, "correction", 1),
        (4, "a", 3, "close", 1),
        (4, "b", 3, "close", 1),
        (4, "d", 3, "close", 1),
    ]
    closed = rollups.finalise_rollups(spark.read.parquet(f"{tmp_path}/log/rows"))
    first = closed.where("event = 'a'").orderBy("bucket").first()
    assert (first["count"], first["unique_users_bucket"], first["corrections"]) == (4, 1, 1)


def test_registered_streams_take_several_batches(spark, folder):
    from eventloom.plans import catalogue

    sizes, place = [], scratch_path(spark)
    catalogue._feed(
        spark, catalogue._batches(catalogue._enriched_messages(spark, folder)), topics.ENRICHED,
        lambda topic: topic.writeStream.foreachBatch(lambda batch, number: sizes.append(batch.count()))
        .option("checkpointLocation", place)
        .trigger(**ONCE)
        .start(),
    )
    assert len(sizes) == 3 and all(sizes)


def test_trace_id_of_the_header_counts(spark, tmp_path):
    source, enriched = f"{tmp_path}/raw", f"{tmp_path}/enriched"
    rows = [("p", body("view", at=1), 1, {"traceId": "h"}), ("p", body("click", at=2), 2, {})]
    frame = spark.createDataFrame(rows, "key STRING, value STRING, s BIGINT, headers MAP<STRING,STRING>")
    frame.withColumn("arrival_ts", F.timestamp_seconds("s")).drop("s").select(
        "key", "value", "headers", "arrival_ts"
    ).write.parquet(source)
    rules = spark.createDataFrame([], "project_id STRING, event STRING, schema STRING")
    ranges = spark.createDataFrame([], "start_ip BIGINT, end_ip BIGINT, country STRING, city STRING")
    drain(
        stages.start_enrichment(
            topics.read_files(spark, source, topics.RAW), rules, ranges, topics.to_files(enriched),
            topics.to_files(f"{tmp_path}/dead"), f"{tmp_path}/c", ONCE,
        )
    )
    found = spark.read.option("recursiveFileLookup", "true").parquet(enriched).collect()
    traces = {json.loads(r.value)["event"]: (json.loads(r.value)["traceId"], r.headers["traceId"]) for r in found}
    assert traces["view"] == ("h", "h")
    assert traces["click"][0] == traces["click"][1] and len(traces["click"][0]) == 64
