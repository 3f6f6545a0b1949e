"""Scans of the stored tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bound(df: DataFrame, column: str, value: object) -> Column:
    """A literal of the column's own type, so that the filter reaches the files."""
    return F.lit(value).cast(df.schema[column].dataType)


def within(df: DataFrame, column: str, start: object = None, end: object = None) -> DataFrame:
    """Closed range; a missing bound leaves that side open."""
    if start is not None:
        df = df.where(F.col(column) >= bound(df, column, start))
    if end is not None:
        df = df.where(F.col(column) <= bound(df, column, end))
    return df


def scan_events(
    events: DataFrame,
    project: str | None = None,
    names: Iterable[str] | None = None,
    start: object = None,
    end: object = None,
) -> DataFrame:
    """Base scan below the event queries.

    A table partitioned by `event_date` also gets the matching date filter, so
    that whole partitions are skipped.
    """
    if project is not None:
        events = events.where(F.col("project_id") == project)
    if names is not None:
        events = events.where(F.col("event").isin(*sorted(set(names))))
    events = within(events, "ts", start, end)
    if "event_date" in events.columns:
        if start is not None:
            events = events.where(F.col("event_date") >= bound(events, "ts", start).cast("date"))
        if end is not None:
            events = events.where(F.col("event_date") <= bound(events, "ts", end).cast("date"))
    return events


def scan_rollups(
    rollups: DataFrame,
    project: str | None = None,
    event: str | None = None,
    start: object = None,
    end: object = None,
) -> DataFrame:
    """Base scan below the metrics: equality on keys, closed range of buckets."""
    if project is not None:
        rollups = rollups.where(F.col("project_id") == project)
    if event is not None:
        rollups = rollups.where(F.col("event") == event)
    return within(rollups, "bucket", start, end)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Stored events; a replayed batch has already replaced its own files."""
    return spark.read.parquet(path).drop("batch_id")


def read_geo_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Address ranges (start_ip, end_ip, country, city) from Parquet or CSV."""
    if path.endswith(".csv"):
        return spark.read.csv(
            path, header=True, schema="start_ip BIGINT, end_ip BIGINT, country STRING, city STRING"
        )
    return spark.read.parquet(path)


def read_schema_registry(spark: SparkSession, path: str) -> DataFrame:
    """Property rules: project_id, event, schema."""
    return spark.read.parquet(path).select("project_id", "event", "schema")
