"""Keys, quota, bodies, envelopes, property rules."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from eventloom.functions import json_values as jv
from eventloom.operators import ingest, validate


def test_quota_boundary(spark):
    """The 1000th request passes, the 1001st does not, the next window starts afresh."""
    requests = spark.range(2003).select(
        F.lit("pk_live_x").alias("api_key"),
        F.col("id").alias("seq"),
        F.timestamp_seconds(F.when(F.col("id") < 2001, F.lit(119)).otherwise(F.lit(120))).alias(
            "arrival_ts"
        ),
    )
    rows = {r.seq: (r.allowed, r.remaining) for r in ingest.rate_limit(requests).collect()}
    assert len(rows) == 2003
    assert rows[0] == (True, 999) and rows[999] == (True, 0) and rows[1000] == (False, 0)
    assert rows[2000] == (False, 0) and rows[2001] == (True, 999) and rows[2002] == (True, 998)


@pytest.mark.parametrize("limit", [1, 3, 1001, 100_000])
def test_quota_returns_every_request(spark, limit):
    """Missing keys and times, equal ties: none goes missing, and `limit` are admitted."""
    rows = [("a", 1, 5)] * 6 + [("a", i, 6) for i in range(5)] + [(None, i, 7) for i in range(4)]
    rows += [("b", 1, None)] * 3 + [("c", i, 3600 + i % 50) for i in range(1500)]
    requests = spark.createDataFrame(rows, "api_key STRING, seq BIGINT, s BIGINT").withColumn(
        "arrival_ts", F.timestamp_seconds("s")
    )
    got = ingest.rate_limit(requests, limit=limit).collect()
    assert len(got) == len(rows)
    for key, total in (("a", 11), (None, 4), ("b", 3), ("c", 1500)):
        own = [r for r in got if r.api_key == key]
        admitted = sorted(r.remaining for r in own if r.allowed)
        assert len(own) == total
        assert admitted == list(range(limit - min(limit, total), limit))
        assert all(r.remaining == 0 for r in own if not r.allowed)
        if key == "c" and limit < 1500:
            last = max((r.s, r.seq) for r in own if r.allowed)
            assert all((r.s, r.seq) > last for r in own if not r.allowed)


def test_quota_spreads_refused_requests(spark):
    """A key with very many requests: what is refused is not ranked in one place."""
    requests = spark.range(200_000).select(
        F.lit("k").alias("api_key"), F.col("id").alias("seq"),
        F.timestamp_micros(F.col("id")).alias("arrival_ts"),
    )
    got = ingest.rate_limit(requests, limit=1500)
    assert got.where("allowed").count() == 1500 and got.count() == 200_000
    assert got.where("allowed").agg(F.max("seq")).first()[0] == 1499


def test_missing_keys_and_equal_arrivals(spark):
    rows = [("k", 0, 1), ("k", 0, 1), ("k", 5, 2), (None, 0, 1), (None, 0, 1), ("k", None, 1)]
    frame = spark.createDataFrame(rows, "dedup_key STRING, s BIGINT, seq BIGINT").withColumn(
        "arrival_ts", F.timestamp_seconds("s")
    )
    for options in ({}, {"light_events": 1}):
        got = ingest.dedup_events(frame, **options).collect()
        assert len(got) == len(rows)
        assert sum(r.status == "accepted" for r in got if r.dedup_key == "k" and r.s is not None) == 1
        assert all(r.status == "accepted" for r in got if r.dedup_key is None or r.s is None)


def test_rules_of_several_versions_join_once(spark):
    rules = spark.createDataFrame(
        [("p", "e", '{"required":["a"]}', 1), ("p", "e", '{"required":["b"]}', 2)],
        "project_id STRING, event STRING, schema STRING, version INT",
    )
    compiled = validate.compile_rules(rules).collect()
    assert [r.required for r in compiled] == [["b"]]


VALID = {"event": "e", "projectId": "p", "timestamp": 1}


def change(**fields):
    return json.dumps({**VALID, **fields})


def without(name):
    return json.dumps({k: v for k, v in VALID.items() if k != name})


@pytest.mark.parametrize(
    ("text", "fields"),
    [
        (json.dumps(VALID), []),
        (change(event=""), []),
        (change(extra=[1]), []),
        (change(timestamp=1.5), []),
        (change(properties={}), []),
        (change(userId="u"), []),
        (without("event"), ["event"]),
        (without("projectId"), ["projectId"]),
        (without("timestamp"), ["timestamp"]),
        (change(event=None), ["event"]),
        (change(event=5), ["event"]),
        (change(projectId={}), ["projectId"]),
        (change(timestamp="1"), ["timestamp"]),
        (change(timestamp=None), ["timestamp"]),
        (change(timestamp=True), ["timestamp"]),
        (change(userId=None), ["userId"]),
        (change(userId=1), ["userId"]),
        (change(properties=None), ["properties"]),
        (change(properties=[]), ["properties"]),
        (change(properties="x"), ["properties"]),
        ("{}", ["event", "projectId", "timestamp"]),
        ("[]", [""]),
        ("7", [""]),
        ('{"event":1,"event":"e","projectId":"p","timestamp":1}', []),
    ],
)
def test_envelope(spark, text, fields):
    frame = validate.validate_envelope(
        validate.parse_event(spark.createDataFrame([(text,)], "value STRING"))
    )
    row = frame.select(F.transform("issues", lambda i: F.array_join(i["path"], ".")).alias("f")).first()
    assert row.f == fields


def test_envelope_reason_text(spark):
    empty = spark.createDataFrame([], "project_id STRING, event STRING, schema STRING")
    frame = validate.judge(spark.createDataFrame([(without("event"),)], "value STRING"), empty)
    assert frame.first().reason == (
        'Schema validation failed: [{"expected":"string","code":"invalid_type","path":["event"],'
        '"message":"Invalid input: expected string, received undefined"}]'
    )


@pytest.mark.parametrize(
    ("value", "reason"),
    [
        ("nope", "Malformed message"),
        ("null", "Malformed message"),
        (change(timestamp=1e17), "Invalid time value"),
        (change(timestamp=8640000000000000), None),
        (change(timestamp=0), None),
    ],
)
def test_other_reasons(spark, value, reason):
    empty = spark.createDataFrame([], "project_id STRING, event STRING, schema STRING")
    frame = validate.judge(spark.createDataFrame([(value,)], "value STRING"), empty)
    assert frame.first().reason == reason


RULE = json.dumps(
    {
        "required": ["b", "a"],
        "properties": {
            "s": {"type": "string"},
            "n": {"type": "number"},
            "i": {"type": "integer"},
            "t": {"type": "boolean"},
            "o": {"type": "object"},
            "many": {"type": ["string", "null"]},
            "plain": "string",
        },
    }
)
FULL = {"a": 1, "b": 2}


@pytest.mark.parametrize(
    ("properties", "errors"),
    [
        (FULL, []),
        ({"a": None, "b": None}, []),
        ({}, ["Missing required property: b", "Missing required property: a"]),
        (None, ["Missing required property: b", "Missing required property: a"]),
        ({**FULL, "s": "x", "n": 1.5, "i": 1.5, "t": False, "o": 1, "many": 2, "plain": 3}, []),
        (
            {**FULL, "t": "x", "s": 1, "i": "1", "n": None},
            [
                "Field s should be a string",
                "Field n should be a number",
                "Field i should be a number",
                "Field t should be a boolean",
            ],
        ),
        ({"b": 1, "s": []}, ["Missing required property: a", "Field s should be a string"]),
    ],
)
def test_property_rules(spark, properties, errors):
    rules = spark.createDataFrame([("p", "e", RULE)], "project_id STRING, event STRING, schema STRING")
    text = None if properties is None else json.dumps(properties)
    frame = spark.createDataFrame([("p", "e", text)], "project_id STRING, event STRING, t STRING")
    checked = validate.validate_properties(
        frame.withColumn("properties", F.try_parse_json("t")), rules
    )
    assert checked.first().errors == errors


def test_no_rule_no_check(spark):
    rules = spark.createDataFrame(
        [("p", "e", RULE), ("p", "odd", '{"required":"text"}'), ("p", "bad", "not json")],
        "project_id STRING, event STRING, schema STRING",
    )
    frame = spark.createDataFrame(
        [("p", "other"), ("q", "e"), ("p", "odd"), ("p", "bad")], "project_id STRING, event STRING"
    ).withColumn("properties", F.parse_json(F.lit("{}")))
    assert [r.errors for r in validate.validate_properties(frame, rules).collect()] == [[]] * 4


@pytest.mark.parametrize(
    ("item", "verdicts"),
    [
        (json.dumps(VALID), ["valid"]),
        (f"[{json.dumps(VALID)},{without('event')}]", ["valid", "rejected"]),
        ("[]", []),
        ("[null,5,[]]", ["error", "error", "rejected"]),
        (change(properties=None), ["valid"]),  # the address makes it an object
        (change(properties="x"), ["error"]),
        (change(properties=[1]), ["rejected"]),
        ("broken", ["error"]),
    ],
)
def test_item_verdicts_with_sender_address(spark, item, verdicts):
    frame = spark.createDataFrame([(item, "1.2.3.4")], "body STRING, sender STRING")
    judged = ingest.judged_items(frame, "body", "sender").orderBy("pos")
    assert [r.verdict for r in judged.select("verdict").collect()] == verdicts


@pytest.mark.parametrize(
    ("properties", "edge", "ip"),
    [
        ("{}", False, "9.9.9.9"),
        ('{"ip":"1.1.1.1"}', False, None),
        ('{"ip":""}', False, "9.9.9.9"),
        ('{"clientIp":"1.1.1.1"}', False, "1.1.1.1"),
        ('{"clientIp":"1.1.1.1"}', True, "9.9.9.9"),
        ('{"ip":"1.1.1.1"}', True, "9.9.9.9"),
        (None, False, "9.9.9.9"),
    ],
)
def test_sender_address(spark, properties, edge, ip):
    frame = spark.createDataFrame([(properties, "9.9.9.9")], "p STRING, h STRING")
    row = ingest.inject_client_ip(frame, "p", "h", edge).first()
    assert json.loads(row.p).get("clientIp") == ip


def test_keys(spark):
    keys = spark.sql(
        "SELECT substring(k, 1, 16) AS key_prefix, sha2(k, 256) AS key_hash, project_id, expires_at "
        "FROM VALUES ('pk_live_aaaaaaaaaaaa', 'p', NULL), "
        "('pk_live_aaaaaaaabbbb', 'q', TIMESTAMP_NTZ'2024-01-01'), "
        "('sk_live_cccccccccccc', 'p', NULL) AS t(k, project_id, expires_at)"
    )
    projects = spark.sql("SELECT 'p' AS project_id, 'o' AS org_id UNION ALL SELECT 'q', 'o'")
    sent = spark.createDataFrame(
        [("pk_live_aaaaaaaaaaaa",), ("pk_live_aaaaaaaabbbb",), ("pk_live_aaaaaaaazzzz",),
         ("sk_live_cccccccccccc",)], "api_key STRING"
    )
    before = ingest.attach_project(sent, keys, projects, "2023-12-31 00:00:00").collect()
    assert {(r.api_key[-4:], r.project_id) for r in before} == {("aaaa", "p"), ("bbbb", "q")}
    after = ingest.attach_project(sent, keys, projects, "2024-01-01 00:00:00").collect()
    assert {r.api_key[-4:] for r in after} == {"aaaa"}
    refused = ingest.reject_keys(sent, keys, projects, "2024-01-01 00:00:00")
    assert refused.count() == 3


def test_json_kinds(spark):
    frame = spark.createDataFrame(
        [(t,) for t in ("null", '"x"', "1", "1.5", "1e3", "true", "[]", "{}", "x")], "t STRING"
    ).select(jv.kind(F.try_parse_json("t")).alias("k"))
    assert [r.k for r in frame.collect()] == [
        "null", "string", "number", "number", "number", "boolean", "array", "object", "undefined",
    ]
