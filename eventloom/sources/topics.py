"""Message streams: Kafka topics, or folders of message files.

Both give the same columns, so everything behind them is the same code:
key, value, headers (MAP<STRING,STRING>), topic, partition, offset, arrival_ts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the three topics.
RAW, ENRICHED, DEAD_LETTER = "raw-events", "enriched-events", "dead-letter-events"

FILE_SCHEMA = (
    "key STRING, value STRING, headers MAP<STRING,STRING>, arrival_ts TIMESTAMP"
)

#: Messages of a file at most: a reader's tasks are as many as the files, however rows were dealt.
FILE_MESSAGES = 100_000

Sink = Callable[[DataFrame, int], None]


def read_kafka(
    spark: SparkSession, topic: str, servers: str, per_trigger: int | None = None
) -> DataFrame:
    """A Kafka topic from its end on; needs Spark's Kafka connector."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "latest")
        .option("includeHeaders", "true")
    )
    if per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", per_trigger)
    return (
        reader.load()
        .where(F.col("value").isNotNull())
        .select(
            F.col("key").cast("string").alias("key"),
            F.col("value").cast("string").alias("value"),
            header_texts(F.col("headers")).alias("headers"),
            "topic",
            "partition",
            F.col("offset").cast("string").alias("offset"),
            F.col("timestamp").alias("arrival_ts"),
        )
    )


def header_texts(headers: Column) -> Column:
    """Kafka headers as MAP<STRING,STRING>; of a repeated name the last counts."""

    def last_value(name: Column) -> Column:
        same = F.filter(headers, lambda h: h["key"] == name)
        return F.element_at(same, -1)["value"].cast("string")

    names = F.array_distinct(F.transform(headers, lambda h: h["key"]))
    return F.map_from_arrays(names, F.transform(names, last_value))


def read_files(
    spark: SparkSession, path: str, topic: str, files_per_trigger: int = 1000
) -> DataFrame:
    """A folder of Parquet message files as a stream.

    File name and row number stand for the offset.
    """
    messages = (
        spark.readStream.schema(FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )
    place = F.concat_ws(":", F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    return messages.where(F.col("value").isNotNull()).select(
        "key",
        "value",
        "headers",
        F.lit(topic).alias("topic"),
        F.lit(0).alias("partition"),
        place.alias("offset"),
        "arrival_ts",
    )


def to_kafka(topic: str, servers: str) -> Sink:
    """Sink that publishes a batch of messages; needs Spark's Kafka connector."""

    def send(messages: DataFrame, batch_id: int) -> None:
        (
            messages.select(
                "key",
                "value",
                F.transform(
                    F.map_entries("headers"),
                    lambda h: F.struct(h["key"], h["value"].cast("binary").alias("value")),
                ).alias("headers"),
            )
            .write.format("kafka")
            .option("kafka.bootstrap.servers", servers)
            .option("topic", topic)
            .option("includeHeaders", "true")
            .save()
        )

    return send


def to_files(path: str) -> Sink:
    """Sink that writes each batch to its own folder, once.

    A replayed batch whose folder is complete is not written again, so readers
    of the folder see every message once.
    """

    def write(messages: DataFrame, batch_id: int) -> None:
        spark = messages.sparkSession
        folder = f"{path}/batch={batch_id}"
        jvm = spark.sparkContext._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            return
        arrived = (
            F.col("arrival_ts") if "arrival_ts" in messages.columns else F.current_timestamp()
        )
        columns = messages.select("key", "value", "headers", arrived.alias("arrival_ts"))
        columns.write.mode("overwrite").option("maxRecordsPerFile", FILE_MESSAGES).parquet(folder)

    return write
