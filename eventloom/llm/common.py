"""What several of these operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.session import configure, materialise

#: Rows handed to Python at once. Texts may be long; the default of 10,000 would take
#: tens of megabytes per task on both sides.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators of this folder rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return configure(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text of a row; a missing one counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def in_blocks(df: DataFrame, *order: Column) -> DataFrame:
    """The rows with `block`, a number that ascends along the order.

    Blocks are ranges of the order chosen by sampling, so the table is written
    once: a second evaluation could cut it elsewhere.
    """
    return materialise(df.repartitionByRange(*order).withColumn("block", F.spark_partition_id()))


def with_rank(df: DataFrame, *order: Column) -> DataFrame:
    """The rows with `rank`, their place from 0 along a total order.

    Rows are numbered inside their block; only one count per block is summed
    up over all blocks.
    """
    blocks = in_blocks(df, *order)
    before = F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = (
        blocks.groupBy("block")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("block", F.coalesce(before, F.lit(0)).alias("offset"))
    )
    place = F.row_number().over(Window.partitionBy("block").orderBy(*order))
    return (
        blocks.withColumn("place", place)
        .join(offsets, "block")
        .withColumn("rank", F.col("offset") + F.col("place") - 1)
        .drop("block", "place", "offset")
    )
