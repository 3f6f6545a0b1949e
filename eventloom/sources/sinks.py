"""Writing events, rollups and messages.

Every sink used from a micro-batch writes into partitions of that batch and
replaces them on a replay, so a repeated batch leaves no trace.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import clock
from eventloom.operators.rollups import live_uniques
from eventloom.session import materialise, remove_folder
from eventloom.sources.tables import bound

# Fixed value: days an event is kept.
RETENTION_DAYS = 90


def oldest_kept(events: DataFrame, column: str, now: object, days: int = RETENTION_DAYS) -> Column:
    """First instant that is not yet expired at `now`."""
    return bound(events, column, now) - F.make_dt_interval(days=F.lit(days))


def message_rows(df: DataFrame, key_col: str, *columns: str) -> DataFrame:
    """Rows as messages: `key` and the chosen columns as JSON `value`."""
    chosen = columns or tuple(df.columns)
    return df.select(F.col(key_col).alias("key"), F.to_json(F.struct(*chosen)).alias("value"))


def write_batch(df: DataFrame, batch_id: int, path: str, *partition_cols: str) -> None:
    """Write a micro-batch; writing the same batch again replaces it."""
    (
        df.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_cols, "batch_id")
        .parquet(path)
    )


def write_events(df: DataFrame, batch_id: int, path: str) -> None:
    """Append stored events, partitioned by day."""
    write_batch(df.withColumn("event_date", F.col("ts").cast("date")), batch_id, path, "event_date")


def layout_events(df: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Write events in their query layout: by day, sorted by project, event, time.

    Ranges over (day, project, event, time) split a day with very many events
    into several tasks and keep small days together, and give each file narrow
    bounds for the filters of a scan.
    """
    dated = df.withColumn("event_date", F.col("ts").cast("date"))
    order = ["event_date", "project_id", "event", "ts"]
    (
        dated.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy("event_date")
        .parquet(path)
    )


def compact_events(spark: SparkSession, source: str, target: str) -> None:
    """Rewrite the many small batch files of `source` in the query layout."""
    layout_events(spark.read.parquet(source).drop("batch_id", "event_date"), target)


def expire_events(
    spark: SparkSession, path: str, now: object, days: int = RETENTION_DAYS
) -> None:
    """Remove expired events from a table partitioned by day.

    Days that are expired as a whole are dropped without being read. Only the
    day on the border is rewritten.
    """
    events = spark.read.parquet(path)
    first = oldest_kept(events, "ts", now, days)
    border = spark.range(1).select(first.cast("date").cast("string")).first()[0]
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # One name per recorded day.
    for status in files.listStatus(folder):
        name, _, day = status.getPath().getName().partition("=")
        if name == "event_date" and day < border:
            files.delete(status.getPath(), True)

    events = spark.read.parquet(path)
    parts = [name for name in ("event_date", "batch_id") if name in events.columns]
    last_day = events.where(F.col("event_date") == F.lit(border).cast("date"))
    kept = materialise(last_day.where(F.col("ts") >= first))
    # Folders of one day, by name.
    before, after = (
        {"/".join(f"{p}={row[p]}" for p in parts) for row in rows.select(*parts).distinct().collect()}
        for rows in (last_day, kept)
    )
    (
        kept.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*parts)
        .parquet(path)
    )
    # A folder that keeps no row was not overwritten.
    for name in before - after:
        remove_folder(spark, f"{path}/{name}")


def write_rollups(df: DataFrame, batch_id: int, path: str) -> None:
    """Add the sketch rollups of a micro-batch, by day; `read_rollups` merges them."""
    write_batch(
        df.withColumn("bucket_date", F.col("bucket").cast("date")), batch_id, path, "bucket_date"
    )


def write_grains(rollups: DataFrame, path: str) -> None:
    """Store rollups by minute, hour and day, in a table each; days they have are replaced.

    `rollups` are the minutes of whole days; counts and unique users add up, as they do in
    `metrics`. A day with many rows is dealt over several files.
    """
    dated = materialise(rollups.withColumn("bucket_date", F.col("bucket").cast("date")))
    order = ["bucket_date", "project_id", "event", "bucket"]
    for grain in clock.GRAINS:
        start = clock.bucket(F.col("bucket"), grain).alias("bucket")
        table = dated.groupBy("bucket_date", "project_id", "event", start).agg(
            F.sum("count").alias("count"), F.sum("unique_users").alias("unique_users")
        )
        (
            table.repartitionByRange(*order)
            .sortWithinPartitions(*order)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket_date")
            .parquet(f"{path}/{grain}")
        )


def read_grains(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {grain: spark.read.parquet(f"{path}/{grain}") for grain in clock.GRAINS}


def compact_uniques(spark: SparkSession, source: str, target: str, now: object) -> None:
    """Write what is alive of the kept users as one batch of a new folder."""
    write_batch(live_uniques(spark.read.parquet(source).drop("batch_id"), now), 0, target)


def read_sketch_rollups(
    spark: SparkSession,
    path: str,
    start: object = None,
    end: object = None,
    days: Sequence[object] | None = None,
) -> DataFrame:
    """One row per project, event and minute of the days from `start` to `end`, or of `days`."""
    stored = spark.read.parquet(path)
    if days is not None:
        stored = stored.where(F.col("bucket_date").isin(list(days)))
    if start is not None:
        stored = stored.where(F.col("bucket_date") >= F.lit(start).cast("date"))
    if end is not None:
        stored = stored.where(F.col("bucket_date") <= F.lit(end).cast("date"))
    return merge_sketch_rollups(stored)


def merge_sketch_rollups(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("project_id", "event", "bucket").agg(
        F.sum("count").alias("count"), F.hll_union_agg("users_sketch").alias("users_sketch")
    )


def read_rollups(
    spark: SparkSession,
    path: str,
    start: object = None,
    end: object = None,
    days: Sequence[object] | None = None,
) -> DataFrame:
    """Rollups with `unique_users`: the day's users so far, on each bucket of it.

    `start` and `end`, or `days`, choose whole days; other days are not opened.
    """
    minutes = read_sketch_rollups(spark, path, start, end, days).withColumn(
        "day", F.col("bucket").cast("date")
    )
    days = minutes.groupBy("project_id", "event", "day").agg(
        F.hll_sketch_estimate(F.hll_union_agg("users_sketch")).alias("unique_users")
    )
    return minutes.join(days, ["project_id", "event", "day"]).select(
        "project_id", "event", "bucket", "count", "unique_users", "users_sketch"
    )


def compact_rollups(spark: SparkSession, source: str, target: str) -> None:
    """Write the merged rollups as one batch of a new folder."""
    write_rollups(read_sketch_rollups(spark, source), 0, target)


def compact_days(spark: SparkSession, source: str, target: str, before: object) -> None:
    """Move the days before a date from the batch files of `source` to the query layout.

    A day that is in `target` already is merged with what came since. The days
    moved are retired from `source` once they are written, so a second call has
    only new ones to do. `before` must lie behind the day that is being written.
    """
    border = F.lit(before).cast("date")
    moved = spark.read.parquet(source).where(F.col("event_date") < border)
    days = [row[0] for row in moved.select("event_date").distinct().collect()]
    if not days:
        return
    rows = moved.drop("batch_id")
    if _exists(spark, target):
        again = spark.read.parquet(target).where(F.col("event_date").isin(days))
        rows = materialise(rows.unionByName(again.select(*rows.columns)))
    layout_events(rows.drop("event_date"), target)
    for day in days:
        remove_folder(spark, f"{source}/event_date={day}")


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
