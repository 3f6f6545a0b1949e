"""Dead letters: wrapping, storing, listing, replaying, discarding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import clock
from eventloom.operators.analytics import page

# States of a dead letter.
PENDING, RETRYING, RETRIED, DISCARDED = "pending", "retrying", "retried", "discarded"

# Fixed value: characters of the reason repeated in the message header.
HEADER_REASON_LENGTH = 500
DEFAULT_PAGE, MAX_PAGE = 50, 500

LISTED = (
    "id", "original_topic", "original_partition", "original_offset", "original_key",
    "reason", "status", "retry_count", "created_at", "updated_at",
)

# Fields of a dead-letter message.
ENVELOPE_SCHEMA = (
    "originalTopic STRING, originalPartition INT, originalOffset STRING, originalKey STRING, "
    "originalValue STRING, originalHeaders MAP<STRING,STRING>, reason STRING, timestamp BIGINT"
)


def header_map(headers: Column) -> Column:
    """Message headers as texts; headers without a value are dropped."""
    return F.map_filter(headers, lambda name, value: value.isNotNull())


def dlq_envelope(rejected: DataFrame, at: Column) -> DataFrame:
    """Messages for the dead-letter topic: key, value (JSON), header texts.

    `rejected` carries topic, partition, offset, key, value, headers
    (MAP<STRING,STRING>) and reason; `at` is the time of rejection.
    """
    envelope = F.struct(
        F.col("topic").alias("originalTopic"),
        F.col("partition").alias("originalPartition"),
        F.col("offset").cast("string").alias("originalOffset"),
        F.col("key").alias("originalKey"),
        F.col("value").alias("originalValue"),
        header_map(F.coalesce("headers", F.create_map().cast("map<string,string>"))).alias(
            "originalHeaders"
        ),
        F.col("reason"),
        clock.epoch_ms(at).alias("timestamp"),
    )
    return rejected.select(
        "key",
        F.to_json(envelope).alias("value"),
        F.col("topic").alias("header_topic"),
        F.substring("reason", 1, HEADER_REASON_LENGTH).alias("header_reason"),
    )


def dlq_store(messages: DataFrame, at: Column, value_col: str = "value") -> DataFrame:
    """Rows of the dead-letter table; messages without a full envelope are skipped.

    The id is built from the original coordinates, so storing a message again
    yields the same row.
    """
    parsed = messages.withColumn("m", F.from_json(value_col, ENVELOPE_SCHEMA))
    topic, part, offset = (
        F.col("m.originalTopic"), F.col("m.originalPartition"), F.col("m.originalOffset"),
    )
    complete = (
        topic.isNotNull()
        & part.isNotNull()
        & offset.isNotNull()
        & F.col("m.reason").isNotNull()
        & F.col("m.timestamp").isNotNull()
    )
    return parsed.where(complete).select(
        F.concat_ws("/", topic, part.cast("string"), offset).alias("id"),
        topic.alias("original_topic"),
        part.alias("original_partition"),
        offset.alias("original_offset"),
        F.col("m.originalKey").alias("original_key"),
        F.col("m.originalValue").alias("original_value"),
        F.col("m.originalHeaders").alias("original_headers"),
        F.col("m.reason").alias("reason"),
        at.alias("created_at"),
    )


def initial_status(letters: DataFrame) -> DataFrame:
    """First entry of the status log for newly stored dead letters."""
    return letters.select(
        "id",
        F.lit(0).alias("seq"),
        F.lit(PENDING).alias("status"),
        F.lit(None).cast("string").alias("last_error"),
        F.col("created_at").alias("at"),
    )


def dlq_current(log: DataFrame) -> DataFrame:
    """Latest state per dead letter, from the append-only status log."""
    return log.groupBy("id").agg(
        F.max_by("status", "seq").alias("status"),
        F.count_if(F.col("status") == RETRIED).alias("retry_count"),
        F.max_by("last_error", F.when(F.col("last_error").isNotNull(), F.col("seq"))).alias(
            "last_error"
        ),
        F.max_by("at", "seq").alias("updated_at"),
        F.max("seq").alias("seq"),
    )


def dlq_table(letters: DataFrame, log: DataFrame) -> DataFrame:
    """Dead letters together with their current state."""
    return letters.join(dlq_current(log).drop("seq"), "id")


def dlq_list(
    table: DataFrame, status: str = PENDING, limit: int = DEFAULT_PAGE, offset: int = 0
) -> DataFrame:
    """A page of dead letters with a status, newest first; 1 to MAX_PAGE rows."""
    page(limit, offset, MAX_PAGE)
    return (
        table.where(F.col("status") == status)
        .select(*LISTED)
        .orderBy(F.desc("created_at"), F.desc("id"))
        .offset(offset)
        .limit(limit)
    )


def dlq_total(table: DataFrame, status: str = PENDING) -> DataFrame:
    return table.where(F.col("status") == status).agg(F.count("*").alias("total"))


def dlq_get(table: DataFrame, letter_id: object) -> DataFrame:
    return table.where(F.col("id") == letter_id)


def _pending(letters: DataFrame, log: DataFrame, ids: DataFrame) -> DataFrame:
    """The requested dead letters that are still pending, with their last seq."""
    current = dlq_current(log).where(F.col("status") == PENDING).select("id", "seq")
    return letters.join(ids.select("id").distinct(), "id", "left_semi").join(current, "id")


def dlq_retry(letters: DataFrame, log: DataFrame, ids: DataFrame) -> DataFrame:
    """Messages to send again: topic, key, value, headers, with `id` and `seq`.

    Only pending letters are sent. Send the result, then append
    `retry_entries` of it to the status log.
    """
    return _pending(letters, log, ids).select(
        "id",
        "seq",
        F.col("original_topic").alias("topic"),
        F.col("original_key").alias("key"),
        F.col("original_value").alias("value"),
        header_map(F.col("original_headers")).alias("headers"),
    )


def retry_entries(messages: DataFrame, at: Column, error: Column | None = None) -> DataFrame:
    """Status entries of a replay: retried, or pending again with the error."""
    failed = F.lit(None).cast("string") if error is None else error
    outcome = F.when(failed.isNull(), F.lit(RETRIED)).otherwise(F.lit(PENDING))
    steps = F.array(
        F.struct(
            (F.col("seq") + 1).alias("seq"),
            F.lit(RETRYING).alias("status"),
            F.lit(None).cast("string").alias("last_error"),
        ),
        F.struct(
            (F.col("seq") + 2).alias("seq"), outcome.alias("status"), failed.alias("last_error")
        ),
    )
    return messages.select("id", F.inline(steps)).withColumn("at", at)


def dlq_discard(log: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Status entries that discard the requested letters that are pending."""
    current = dlq_current(log).where(F.col("status") == PENDING)
    return current.join(ids.select("id").distinct(), "id", "left_semi").select(
        "id",
        (F.col("seq") + 1).alias("seq"),
        F.lit(DISCARDED).alias("status"),
        F.lit(None).cast("string").alias("last_error"),
        at.alias("at"),
    )


def dlq_reasons(table: DataFrame) -> DataFrame:
    """Dead letters per class of reason, original topic and status."""
    return table.groupBy(
        F.regexp_extract("reason", "^([^:]*)", 1).alias("reason_class"),
        "original_topic",
        "status",
    ).agg(F.count("*").alias("letters"))
