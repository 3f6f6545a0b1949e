"""Hashes that identify events, keys and sessions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def dedup_key(project: Column, user: Column, ts_ms: Column, event: Column) -> Column:
    """SHA-256 over project, user, millisecond timestamp and event name.

    Properties are not part of an event's identity.
    """
    parts = F.concat_ws(":", project, text_or_empty(user), ts_ms.cast("string"), event)
    return F.sha2(parts, 256)


def quota_key(api_key: Column) -> Column:
    """First 16 hex digits of the key's SHA-256, to show; quotas go by the whole digest."""
    return F.substring(F.sha2(api_key, 256), 1, 16)


def session_id(project: Column, user: Column, anchor_us: Column) -> Column:
    """Replay-stable id: the same session gets the same id in every run."""
    return F.sha2(F.concat_ws("|", project, user, anchor_us.cast("string")), 256)


def trace_id(*parts: Column) -> Column:
    """Replay-stable trace id from the coordinates of an event."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def message_id(producer: str, *place: Column) -> Column:
    """Id of what a producer makes of the message at a place: the same whenever it is made."""
    return F.sha2(F.concat_ws("|", F.lit(producer), *[p.cast("string") for p in place]), 256)
