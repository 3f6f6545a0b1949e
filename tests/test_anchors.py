"""Fixed-expiry anchors against a direct loop, on all three paths."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventloom.operators import ingest
from eventloom.operators.anchors import anchor_table, attach_anchors, whole_nodes

TTL = 60
SECOND = 1_000_000


def loop(instants, ttl):
    held, anchor = {}, None
    for t in sorted(instants):
        if anchor is None or t >= anchor + ttl:
            anchor = t
        held[t] = anchor
    return held


@pytest.fixture(scope="module")
def dense():
    """Sparse and dense keys, equal instants, exact boundaries, one hot key."""
    rng = np.random.default_rng(7)
    rows = []
    for key, (n, span) in enumerate([(3, 500), (60, 3000), (700, 20000), (4000, 9000), (900, 300)]):
        rows += [(f"k{key}", int(t)) for t in rng.integers(0, span * SECOND, n)]
    rows += [("edge", t * SECOND) for t in (0, 59, 60, 60, 119, 120, 179, 240, -1, -61)]
    rows += [("regular", t * SECOND // 4) for t in range(2000)]
    return pd.DataFrame(rows, columns=["k", "us"])


@pytest.mark.parametrize(
    "options",
    [
        {},
        {"light_events": 1, "fold_limit": 10, "fan_in": 4},
        {"light_events": 1, "fold_limit": 0, "fan_in": 2, "levels": 4},
        {"light_events": 1, "fold_limit": 0, "levels": 1},
        {"light_events": 1},
        {"light_events": 100_000},
    ],
)
def test_same_as_loop(spark, dense, options):
    frame = spark.createDataFrame(dense).withColumn("ts", F.timestamp_micros("us"))
    got = attach_anchors(frame, ["k"], "ts", TTL, **options).select("k", "us", "anchor_us")
    wanted = {k: loop(g.us.tolist(), TTL * SECOND) for k, g in dense.groupby("k")}
    rows = got.collect()
    assert len(rows) == len(dense)
    assert all(r.anchor_us == wanted[r.k][r.us] for r in rows)


def test_one_row_per_block(spark, dense):
    frame = spark.createDataFrame(dense)
    table = anchor_table(frame, ["k"], TTL, fold_limit=50)
    assert table.count() == table.select("k", "block").distinct().count()


def test_missing_key_has_no_anchor(spark):
    frame = spark.sql("SELECT CAST(NULL AS STRING) AS k, TIMESTAMP'2024-01-01' AS ts")
    assert attach_anchors(frame, ["k"], "ts", TTL).first().anchor_us is None


@pytest.mark.parametrize("options", [{}, {"light_events": 1}, {"light_events": 1, "fold_limit": 0, "fan_in": 2}])
def test_duplicates_at_one_instant(spark, options):
    """One accepted event per anchor, the first by the tie column."""
    rows = [("a", 0, 2), ("a", 0, 1), ("a", 59, 3), ("a", 60, 5), ("a", 60, 4), ("b", 7, 1)]
    frame = spark.createDataFrame(rows, "dedup_key STRING, s BIGINT, seq BIGINT").withColumn(
        "arrival_ts", F.timestamp_seconds("s")
    )
    got = ingest.dedup_events(frame, **options).where("status = 'accepted'")
    assert sorted((r.dedup_key, r.s, r.seq) for r in got.collect()) == [
        ("a", 0, 1),
        ("a", 60, 4),
        ("b", 7, 1),
    ]


def test_nodes_are_whole_however_batches_are_cut():
    """Many small nodes share a batch, one node may span several; NaN is one key."""
    names = [("a", 1.0)] * 3 + [("a", float("nan"))] * 2 + [("b", 1.0)] * 7 + [("c", 2.0)]
    table = pa.table({"k": [n for n, _ in names], "p": [v for _, v in names], "x": list(range(len(names)))})
    for size in (1, 2, 5, 100):
        nodes = list(whole_nodes(iter(table.to_batches(max_chunksize=size)), ["k", "p"]))
        assert [node.column("x").to_pylist() for node in nodes] == [
            [0, 1, 2], [3, 4], [5, 6, 7, 8, 9, 10, 11], [12],
        ]


def test_tree_reads_nodes_from_partitions(spark, dense):
    """A call in Python per node would grow with the keys."""
    frame = spark.createDataFrame(dense)
    found = attach_anchors(frame, ["k"], "us", TTL, light_events=1, fold_limit=0, fan_in=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInArrow" not in plan
