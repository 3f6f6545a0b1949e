"""JSON values held as VARIANT: reading them without coercion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(value: Column, name: str) -> Column:
    """The value under an object key; NULL when absent or not an object."""
    return F.try_variant_get(value, f"$.{name}", "variant")


# First word of a VARIANT's type, and the JSON kind it stands for.
# Every other type is a number.
KINDS = {
    "VOID": "null",
    "STRING": "string",
    "BOOLEAN": "boolean",
    "ARRAY": "array",
    "OBJECT": "object",
}


def kind(value: Column) -> Column:
    """JSON kind by name: the words a validator would use.

    NULL input (an absent value) is ``undefined``. Numbers of every width are
    ``number``.
    """
    return kind_of_type(F.schema_of_variant(value))


def kind_of_type(shape: Column) -> Column:
    """`kind` from the type text of a VARIANT, worked out once."""
    names = F.create_map(*[F.lit(word) for pair in KINDS.items() for word in pair])
    head = F.substring_index(F.substring_index(shape, "<", 1), "(", 1)
    other = F.when(shape.isNull(), F.lit("undefined")).otherwise(F.lit("number"))
    return F.coalesce(F.try_element_at(names, head), other)


def type_fits(shape: Column, expected: str) -> Column:
    """Whether a type text stands for a kind: string, number or object."""
    if expected == "string":
        return shape == "STRING"
    if expected == "object":
        return shape.startswith("OBJECT")
    return shape.isin("BIGINT", "DOUBLE") | shape.startswith("DECIMAL")


def is_nothing(value: Column) -> Column:
    """Absent or JSON null."""
    return value.isNull() | F.is_variant_null(value)


def as_map(value: Column) -> Column:
    """Object as MAP<STRING, VARIANT>; NULL for everything else."""
    return value.try_cast("map<string,variant>")


def text(value: Column) -> Column:
    """The text of a JSON string, NULL for other kinds."""
    return F.when(F.schema_of_variant(value) == "STRING", value.try_cast("string"))


def truthy(value: Column) -> Column:
    """Whether a JSON value counts as set: not absent, null, '', 0 or false."""
    empty = F.to_json(value).isin('""', "0", "0.0", "-0.0", "false")
    return ~is_nothing(value) & ~F.coalesce(empty, F.lit(False))
