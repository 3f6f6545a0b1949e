"""Pipeline health: what passed each stage, how fast, and how late."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import clock

# Upper bounds of the latency buckets in milliseconds.
LAG_BOUNDS = {
    "process": (10, 50, 100, 250, 500, 1000, 5000),
    "insert": (50, 100, 250, 500, 1000, 2500, 5000),
    "publish": (5, 10, 25, 50, 100, 250, 500),
    "validate": (5, 10, 25, 50, 100, 250, 500, 1000),
}


def stage_counts(passed: DataFrame, every: str = "minute") -> DataFrame:
    """Rows per stage and time bucket, from (stage, at)."""
    return passed.groupBy("stage", clock.bucket(F.col("at"), every).alias("bucket")).agg(
        F.count("*").alias("count")
    )


def stage_rates(counts: DataFrame, span_seconds: int = 60) -> DataFrame:
    """Rows per second over the `span_seconds` that end with each bucket.

    The window runs over counted buckets: a stage has one row per minute.
    """
    end = F.unix_seconds(F.col("bucket").cast("timestamp"))
    span = Window.partitionBy("stage").orderBy(end).rangeBetween(-span_seconds + 1, 0)
    return counts.select(
        "stage", "bucket", (F.sum("count").over(span) / span_seconds).alias("per_second")
    )


def lag_ms(start: Column, end: Column) -> Column:
    return (clock.micros(end) - clock.micros(start)) / 1000


def lag_histogram(
    rows: DataFrame,
    start_col: str,
    end_col: str,
    bounds: Sequence[int],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Rows with a lag of at most `le` ms, per bound; the last bound is infinite.

    Counted in one pass, one column per bound, then turned into rows.
    """
    lag = lag_ms(F.col(start_col), F.col(end_col))
    limits = [*[float(b) for b in bounds], float("inf")]
    counted = rows.groupBy(*keys).agg(
        *[F.count_if(lag <= limit).alias(f"le_{i}") for i, limit in enumerate(limits)]
    )
    cells = F.array(
        *[
            F.struct(F.lit(limit).alias("le"), F.col(f"le_{i}").alias("cumulative_count"))
            for i, limit in enumerate(limits)
        ]
    )
    return counted.select(*keys, F.inline(cells))


def lag_quantile(
    histogram: DataFrame, q: float = 0.99, keys: Sequence[str] = ()
) -> DataFrame:
    """Quantile of a cumulative histogram, linear within a bucket.

    A quantile in the infinite bucket is reported as the highest finite bound.
    """
    cells = F.sort_array(F.collect_list(F.struct("le", "cumulative_count")))
    grouped = histogram.groupBy(*keys).agg(cells.alias("cells"))
    last = F.element_at("cells", -1)
    rank = F.lit(q) * last["cumulative_count"]
    reached = F.filter("cells", lambda c: c["cumulative_count"] >= rank)
    below = F.filter("cells", lambda c: c["cumulative_count"] < rank)
    measured = grouped.withColumns(
        {
            "hit": F.get(reached, F.lit(0)),
            "low": F.when(F.size(below) > 0, F.element_at(below, -1)),
            "top": F.get(F.col("cells"), F.size("cells") - 2)["le"],
            "rank": rank,
        }
    )
    low_le = F.coalesce(F.col("low.le"), F.lit(0.0))
    low_count = F.coalesce(F.col("low.cumulative_count"), F.lit(0))
    inside = (F.col("rank") - low_count) / (F.col("hit.cumulative_count") - low_count)
    value = F.when(F.col("hit.le") == float("inf"), F.col("top")).otherwise(
        low_le + (F.col("hit.le") - low_le) * inside
    )
    return measured.where(last["cumulative_count"] > 0).select(*keys, value.alias("value"))
