"""Checks on events: the fixed envelope and the rules of each project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import clock
from eventloom.functions import json_values as jv

# Envelope fields in their declared order, expected kind, and
# whether the field must be there.
ENVELOPE = (
    ("event", "string", True),
    ("projectId", "string", True),
    ("properties", "record", False),
    ("timestamp", "number", True),
    ("userId", "string", False),
)

ISSUES = "array<struct<expected:string,code:string,path:array<string>,message:string>>"

# First words of the two rejection reasons.
ENVELOPE_REASON = "Schema validation failed: "
RULE_REASON = "Project schema validation failed: "


def parse_event(messages: DataFrame, value_col: str = "value") -> DataFrame:
    """Add `raw` (VARIANT) and `is_malformed`: not JSON, or JSON null."""
    raw = F.try_parse_json(value_col)
    return messages.withColumn("raw", raw).withColumn("is_malformed", jv.is_nothing(F.col("raw")))


def _issue(expected: Column, path: Column, received: Column) -> Column:
    return F.struct(
        expected.alias("expected"),
        F.lit("invalid_type").alias("code"),
        path.alias("path"),
        F.concat(
            F.lit("Invalid input: expected "), expected, F.lit(", received "), received
        ).alias("message"),
    )


def with_envelope_issues(
    messages: DataFrame, raw_col: str = "raw", properties_col: str | None = None
) -> DataFrame:
    """Add `issues`: what is wrong with an event, in field order.

    Nothing is coerced: "1" is no number, and null is not the same as absent.
    `properties_col` stands in for the event's own property object if given.
    """
    raw = F.col(raw_col)
    types = {}
    for name, _, _ in ENVELOPE:
        value = jv.field(raw, name)
        if name == "properties" and properties_col is not None:
            value = F.col(properties_col)
        types[name] = F.schema_of_variant(value).alias(name)

    all_fit, checks = F.lit(True), []
    for name, expected, required in ENVELOPE:
        shape = F.col(f"_types.{name}")
        wanted = "object" if expected == "record" else expected
        fits = F.coalesce(jv.type_fits(shape, wanted), F.lit(not required))
        all_fit = all_fit & fits
        issue = _issue(F.lit(expected), F.array(F.lit(name)), jv.kind_of_type(shape))
        checks.append(F.when(~fits, issue))
    found = F.filter(F.array(*checks), lambda issue: issue.isNotNull())
    nowhere = F.array().cast("array<string>")
    no_object = F.array(_issue(F.lit("object"), nowhere, jv.kind(raw)))
    # Types are a column of their own, each looked up once; only an event with
    # something wrong gets its issues spelled out.
    return (
        messages.withColumn("_types", F.struct(*types.values()))
        .withColumn(
            "issues",
            F.when(all_fit, F.array().cast(ISSUES))
            .when(jv.as_map(raw).isNotNull(), found)
            .otherwise(no_object),
        )
        .drop("_types")
    )


def validate_envelope(messages: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Add `issues`; an empty array means that the envelope is right."""
    return with_envelope_issues(messages, raw_col)


def out_of_range(raw: Column) -> Column:
    """Whether a numeric timestamp is no instant on the calendar."""
    ms = jv.field(raw, "timestamp").try_cast("double")
    return ~F.coalesce(ms.between(clock.MIN_EPOCH_MS, clock.MAX_EPOCH_MS), F.lit(False))


def strip_unknown(messages: DataFrame, raw_col: str = "raw", *keep: str) -> DataFrame:
    """The declared fields as columns; everything else in the event is dropped."""
    raw = F.col(raw_col)
    return messages.select(
        *keep,
        jv.text(jv.field(raw, "event")).alias("event"),
        jv.text(jv.field(raw, "projectId")).alias("project_id"),
        jv.field(raw, "properties").alias("properties"),
        # Fractions of a millisecond are cut.
        jv.field(raw, "timestamp").try_cast("bigint").alias("ts_ms"),
        jv.text(jv.field(raw, "userId")).alias("user_id"),
        jv.text(jv.field(raw, "traceId")).alias("trace_id"),
    )


def compile_rules(rules: DataFrame) -> DataFrame:
    """Property rules as arrays: `required` names and `typed` (field, type).

    One row per (project, event), the latest version where a registry has
    several, so that joining them never multiplies or regroups events. Declared
    order is kept.
    """
    version = F.col("version") if "version" in rules.columns else F.lit(0)
    latest = F.max(F.struct(version.alias("version"), "schema"))["schema"]
    rules = rules.groupBy("project_id", "event").agg(latest.alias("schema"))
    shape = "required ARRAY<STRING>, properties MAP<STRING,STRING>"
    parsed = F.from_json("schema", shape)
    declared = F.transform(
        F.map_entries(F.coalesce(parsed["properties"], F.create_map().cast("map<string,string>"))),
        lambda e: F.struct(
            e["key"].alias("field"),
            jv.text(jv.field(F.try_parse_json(e["value"]), "type")).alias("type"),
        ),
    )
    return rules.select(
        "project_id",
        "event",
        F.coalesce(parsed["required"], F.array().cast("array<string>")).alias("required"),
        F.filter(declared, lambda d: d["type"].isNotNull()).alias("typed"),
    )


def property_errors(entries: Column, required: Column, typed: Column) -> Column:
    """Errors of a property map: missing names first, then wrong types.

    A null value counts as present and fits no checked type. Declared types
    other than string, number, integer and boolean are not checked, and
    integer accepts every number. The texts are fixed values.
    """
    has = lambda name: F.coalesce(F.map_contains_key(entries, name), F.lit(False))
    missing = F.transform(
        F.filter(required, lambda name: ~has(name)),
        lambda name: F.concat(F.lit("Missing required property: "), name),
    )

    def wrong(rule: Column) -> Column:
        want = F.when(rule["type"] == "integer", F.lit("number")).otherwise(rule["type"])
        checked = want.isin("string", "number", "boolean")
        return has(rule["field"]) & checked & (jv.kind(entries[rule["field"]]) != want)

    mismatched = F.transform(
        F.filter(typed, wrong),
        lambda rule: F.concat(
            F.lit("Field "),
            rule["field"],
            F.lit(" should be a "),
            F.when(rule["type"] == "integer", F.lit("number")).otherwise(rule["type"]),
        ),
    )
    return F.concat(missing, mismatched)


def validate_properties(
    events: DataFrame, rules: DataFrame, properties_col: str = "properties"
) -> DataFrame:
    """Add `errors`, an array of texts; events without a rule have none.

    `properties_col` is a VARIANT. Rules join once per event and are checked
    inside the row, so the only data movement is that one join.
    """
    ruled = events.join(compile_rules(rules), ["project_id", "event"], "left")
    # The map is a column of its own: it is looked into once per name.
    opened = ruled.withColumn(
        "entries", F.when(F.col("required").isNotNull(), jv.as_map(F.col(properties_col)))
    )
    errors = property_errors(F.col("entries"), F.col("required"), F.col("typed"))
    return opened.withColumn(
        "errors", F.coalesce(errors, F.array().cast("array<string>"))
    ).drop("required", "typed", "entries")


def upsert_schema(changes: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Current rule per (project, event): a registry with a log of changes applied.

    Every change replaces the rule and adds one to its version; `created_at`
    stays. Rules without a change stay as they are.
    """
    rule = ["project_id", "event"]
    latest = changes.groupBy(*rule).agg(
        F.max_by("schema", "seq").alias("schema"),
        F.count("*").alias("version"),
        F.min("changed_at").alias("created_at"),
        F.max_by("changed_at", "seq").alias("updated_at"),
    )
    if registry is None:
        return latest
    new, old = latest.alias("new"), registry.alias("old")
    same = (F.col("new.project_id") == F.col("old.project_id")) & (
        F.col("new.event") == F.col("old.event")
    )
    return old.join(new, same, "full_outer").select(
        *[F.coalesce(f"new.{name}", f"old.{name}").alias(name) for name in [*rule, "schema"]],
        (
            F.coalesce("old.version", F.lit(0)) + F.coalesce("new.version", F.lit(0))
        ).alias("version"),
        F.coalesce("old.created_at", "new.created_at").alias("created_at"),
        F.coalesce("new.updated_at", "old.updated_at").alias("updated_at"),
    )


def judge(messages: DataFrame, rules: DataFrame, value_col: str = "value") -> DataFrame:
    """Parse messages and add the event's columns and `reason`.

    `reason` is NULL for a good event; otherwise it is the text for the dead
    letter. Malformed messages and impossible timestamps get one as well.
    """
    parsed = validate_envelope(parse_event(messages, value_col))
    columns = strip_unknown(parsed, "raw", *messages.columns, "raw", "is_malformed", "issues")
    checked = validate_properties(columns, rules)
    reason = (
        F.when(F.col("is_malformed"), F.lit("Malformed message"))
        .when(F.size("issues") > 0, F.concat(F.lit(ENVELOPE_REASON), F.to_json("issues")))
        .when(F.size("errors") > 0, F.concat(F.lit(RULE_REASON), F.to_json("errors")))
        .when(out_of_range(F.col("raw")), F.lit("Invalid time value"))
    )
    return checked.withColumn("reason", reason).drop("raw", "is_malformed", "issues", "errors")


def route_valid_rejected(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good events, and rejected messages with their reason.

    Both sides read `judged`: materialise it first, or messages are judged for
    each side.
    """
    return (
        judged.where(F.col("reason").isNull()).drop("reason"),
        judged.where(F.col("reason").isNotNull()),
    )
