"""Keyed state of streams, kept in Spark's state store.

A stream is grouped by key, or by a hash of it; a group's rows of a micro-batch and what is
stored of it meet in one function on the workers. Only groups of the batch, and those due to
be forgotten, are handed to Python. Time is the stream's own: the watermark tells when what
is stored of a key may go, and no row is dropped for being late. The number of shuffle
partitions at a query's first start is kept by its checkpoint: choose it for the cluster.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from eventloom.functions import clock, identity
from eventloom.session import ship_package

MICROS = 1_000_000
#: Keeps the state on disk, and only its changes in the checkpoint folder. Keys are forgotten
#: when data comes; otherwise each batch would ask for another one, and no run would end.
STORE = {
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Groups that rows without a key are spread over.
KEYLESS_GROUPS = 1024
#: Groups that the keys of anchors are spread over: a batch costs this many calls at most, of
#: some milliseconds each. A checkpoint keeps its groups: choose the number before its first start.
ANCHOR_GROUPS = 2048
#: Rows travel as JSON beside their key, time and tie; instants keep their microseconds.
AS_JSON = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "ignoreNullFields": "false",
}

Frames = Iterator[pd.DataFrame]
Step = Callable[[tuple, Frames, GroupState], Frames]


def _stateful(
    stream: DataFrame,
    key: Column,
    us: Column,
    ties: Sequence[str],
    delay_seconds: int,
    added: str,
    stored: str,
    step: Step,
    groups: int | None = None,
) -> DataFrame:
    """The stream's rows with the columns `added` by `step`, which sees a key at a time.

    `key` is JSON text, or NULL for rows that have no state. With `groups`, `step` sees as
    many hashed groups of keys, and each row's own key as `own`.
    """
    spark = stream.sparkSession
    ship_package(spark)
    for name, value in STORE.items():
        spark.conf.set(name, value)
    fields = stream.schema.fields
    variant = {f.name for f in fields if isinstance(f.dataType, T.VariantType)}
    columns = [F.to_json(f.name).alias(f.name) if f.name in variant else F.col(f.name) for f in fields]
    plain = T.StructType(
        [T.StructField(f.name, T.StringType() if f.name in variant else f.dataType) for f in fields]
    )
    group = F.col("key")
    if groups:
        group = F.concat(F.lit("{"), F.pmod(F.xxhash64("key"), F.lit(groups)).cast("string"))
    rows = (
        stream.select(
            key.alias("key"),
            us.alias("us"),
            F.to_json(F.struct(*ties), AS_JSON).alias("tie"),
            F.to_json(F.struct(*columns), AS_JSON).alias("payload"),
            F.timestamp_micros(us).alias("clock"),
        )
        .withColumns(
            {
                "own": F.col("key"),
                "key": F.coalesce(
                    F.when(F.col("key").isNotNull(), group),
                    F.pmod(F.xxhash64("payload"), F.lit(KEYLESS_GROUPS)).cast("string"),
                ),
            }
        )
        .withWatermark("clock", f"{delay_seconds} seconds")
    )
    stepped = rows.groupBy("key").applyInPandasWithState(
        step, f"payload string, {added}", stored, "append", GroupStateTimeout.ProcessingTimeTimeout
    )
    back = stepped.withColumn("payload", F.from_json("payload", plain, AS_JSON))
    names = [f.name for f in T.StructType.fromDDL(added).fields]
    return back.select(
        *[
            (F.parse_json(f"payload.{n}") if n in variant else F.col(f"payload.{n}")).alias(n)
            for n in plain.names
        ],
        *names,
    )


def _forget(state: GroupState, ends_us: int, wait_ms: int) -> None:
    """Drop what is stored once the watermark has passed its end; else look again later.

    Being woken by the clock on the wall is not enough: a stream that lags behind would
    forget keys whose next events it has not read yet.
    """
    if state.getCurrentWatermarkMs() * 1000 >= ends_us:
        state.remove()
    else:
        state.setTimeoutDuration(wait_ms)


def _tie(text: str) -> tuple:
    """Tie columns in their order; missing ones come first, as in Spark."""
    return json.loads(
        text, object_pairs_hook=lambda pairs: tuple((v is not None, v) for _, v in pairs)
    )


# --- anchors -----------------------------------------------------------------


def run_anchors(
    codes: np.ndarray, us: np.ndarray, ties: np.ndarray, running: list[int | None], ttl: int
) -> tuple[np.ndarray, list[int]]:
    """Anchor of every row, and the rows that set one, in one walk over the rows of many keys.

    `codes` number the keys; `running` has the running anchor of each, and is carried on.
    """
    order = np.lexsort((us, codes))
    found, setters = [], []
    last, run, first = -1, None, None
    for i, code, at in zip(order.tolist(), codes[order].tolist(), us[order].tolist(), strict=True):
        if code != last:
            last, run, first = code, running[code], None
        if run is None or at >= run + ttl:
            run = running[code] = at
            first = i
            setters.append(i)
        elif first is not None and at == run and _tie(ties[i]) < _tie(ties[first]):
            first = setters[-1] = i
        found.append(run)
    anchor = np.empty(len(order), dtype=np.int64)
    anchor[order] = found
    return anchor, setters


def _anchor_step(ttl: int, wait_ms: int) -> Step:
    def keep(state: GroupState, held: dict[str, int], touched: set[str]) -> None:
        """Store running anchors; those that the watermark has passed go, unless just touched."""
        over = state.getCurrentWatermarkMs() * 1000 - ttl
        left = {k: a for k, a in held.items() if a > over or k in touched}
        if left:
            state.update((list(left), list(left.values())))
            state.setTimeoutDuration(wait_ms)
        else:
            state.remove()

    def step(key: tuple, frames: Frames, state: GroupState) -> Frames:
        if not key[0].startswith("{"):
            for frame in frames:
                missing = pd.array([None] * len(frame), dtype="Int64")
                yield pd.DataFrame({"payload": frame["payload"], "anchor_us": missing, "sets_anchor": False})
            return
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        if state.hasTimedOut:
            keep(state, held, set())
            return
        parts = list(frames)
        rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        codes, names = pd.factorize(rows["own"])
        running = [held.get(name) for name in names]
        us = rows["us"].to_numpy(dtype=np.int64)
        anchor, setters = run_anchors(codes, us, rows["tie"].to_numpy(), running, ttl)
        sets = np.zeros(len(rows), dtype=bool)
        sets[setters] = True
        held.update(zip(names, running, strict=True))
        keep(state, held, set(names))
        yield pd.DataFrame({"payload": rows["payload"], "anchor_us": anchor, "sets_anchor": sets})

    return step


def with_anchors(
    stream: DataFrame,
    keys: Sequence[str],
    ts_col: str,
    ttl_seconds: int,
    delay_seconds: int,
    tie_col: str,
) -> DataFrame:
    """Add `anchor_us` and `sets_anchor` to the events of a stream.

    Anchors go on from batch to batch. An event older than its key's running anchor, a
    late one, joins that anchor. A running anchor is forgotten once the latest event lies
    `delay_seconds` behind its end. `tie_col` is unique among the events of a key at one
    instant. Events without a time or a part of their key have no anchor. A task holds the
    rows that one group of keys has in one micro-batch, and its running anchors; the source's
    limit per trigger bounds them.
    """
    us = clock.micros(F.col(ts_col))
    known = us.isNotNull()
    for name in keys:
        known = known & F.col(name).isNotNull()
    ttl = ttl_seconds * MICROS
    wait_ms = max(1, ttl_seconds + delay_seconds) * 1000
    key = F.when(known, F.to_json(F.struct(*keys), AS_JSON))
    return _stateful(
        stream, key, us, [tie_col], delay_seconds,
        "anchor_us bigint, sets_anchor boolean", "keys array<string>, running array<bigint>",
        _anchor_step(ttl, wait_ms), ANCHOR_GROUPS,
    )


#: Header with the id a producer gives a message, and how long readers remember it.
MESSAGE_ID = "messageId"
HOLD_SECONDS = 86_400


def once(
    messages: DataFrame, hold_seconds: int = HOLD_SECONDS, delay_seconds: int = 600
) -> DataFrame:
    """Messages of a topic without those that a restarted producer published again.

    A producer repeats its last batch at most, so ids are remembered for `hold_seconds`
    after their first arrival and then forgotten; what is published again later than that
    passes. Messages without an id, or without a time, pass always.
    """
    named = messages.withColumns(
        {
            "_message": F.col("headers")[MESSAGE_ID],
            "_place": F.struct("topic", "partition", "offset"),
        }
    )
    marked = with_anchors(
        named, ["_message"], "arrival_ts", hold_seconds, delay_seconds, "_place"
    )
    first = F.col("sets_anchor") | F.col("anchor_us").isNull()
    return marked.where(first).select(*messages.columns)


# --- quota -------------------------------------------------------------------

#: Windows without a time never end.
NEVER = 2**62


def _quota_step(limit: int, width: int, wait_ms: int) -> Step:
    def decided(rows: pd.DataFrame, remaining: np.ndarray, allowed: bool) -> pd.DataFrame:
        return rows[["payload"]].assign(allowed=allowed, remaining=remaining)

    def step(key: tuple, frames: Frames, state: GroupState) -> Frames:
        if state.hasTimedOut:
            _forget(state, state.get[1], wait_ms)
            return
        used = state.get[0] if state.exists else 0
        slot = json.loads(key[0])["slot"]
        left = max(limit - used, 0)
        first = None
        for frame in frames:
            rows = frame if first is None else pd.concat([first, frame])
            ties = [_tie(t) for t in rows["tie"]]
            times = rows["us"].fillna(0).to_numpy(dtype=np.int64)
            order = sorted(range(len(rows)), key=lambda i: (times[i], ties[i]))
            # Not more than the quota is held; the others are refused as they come.
            first = rows.iloc[order[:left]]
            rest = rows.iloc[order[left:]]
            yield decided(rest, np.zeros(len(rest), dtype=np.int64), False)
        n = len(first)
        state.update((used + n, NEVER if slot is None else (slot + 1) * width))
        state.setTimeoutDuration(wait_ms)
        yield decided(first, left - 1 - np.arange(n, dtype=np.int64), True)

    return step


def with_quota(
    requests: DataFrame,
    key_col: str,
    ts_col: str,
    tie_cols: Sequence[str],
    limit: int,
    window_seconds: int,
    delay_seconds: int,
) -> DataFrame:
    """`rate_limit` on a stream: adds `quota_key`, `allowed` and `remaining`.

    A request is decided in its micro-batch, by what its key's window has left, and never
    again. Inside a batch the first by time and ties are admitted; so a stream that comes
    in order is decided as the table would be. A window is forgotten once the latest
    request lies `delay_seconds` behind its end. A task holds `limit` requests of a window
    and an Arrow batch, however many come.
    """
    us = clock.micros(F.col(ts_col))
    width = window_seconds * MICROS
    owner = F.coalesce(F.sha2(F.col(key_col), 256), F.lit("")).alias("owner")
    key = F.to_json(F.struct(owner, clock.slot(us, width).alias("slot")), AS_JSON)
    return _stateful(
        requests.withColumn("quota_key", identity.quota_key(F.col(key_col))),
        key, us, tie_cols, delay_seconds,
        "allowed boolean, remaining bigint", "used bigint, ends bigint",
        _quota_step(limit, width, max(1, window_seconds + delay_seconds) * 1000),
    )
