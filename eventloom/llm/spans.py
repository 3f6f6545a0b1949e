"""Where patterns match in a text, as column expressions.

`split` and `regexp_extract_all` walk a text with the same matcher: the first
gives what lies between the matches, the second the matches. Lengths in code
points, summed up, give the places.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points to a piece where parts of a long text are taken.
PIECE = 1024


@dataclass(frozen=True)
class Kind:
    """A pattern, a cheap test that every text with a match passes, and the parts
    of a match that are checked (group 0 is all of it)."""

    name: str
    pattern: str
    hint: Callable[[Column], Column]
    check: Callable[[Column], Column]
    group: int = 0


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then(value)` with the value computed once, also where `then` uses it in a lambda."""
    return F.transform(F.array(value), then)[0]


def before_each(values: Column, zero: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """All elements before each one, combined from `zero` on; and at last all of them.

    `combine` is associative, `zero` its neutral element; the result has one element
    more than the values. Arrays are cut into about as many chunks as a chunk has
    elements, so that appending copies n * sqrt(n) numbers, not n * n.
    """

    def appended(part: Column) -> Column:
        """`zero`, then each prefix."""
        return F.aggregate(
            part,
            F.array(zero),
            lambda done, x: F.array_append(done, combine(F.element_at(done, -1), x)),
        )

    def chunked(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v))), F.lit(1)).cast("int")

        def cut(w: Column) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), w)
            return F.transform(starts, lambda c: F.slice(v, c, w))

        def shifted(chunks: Column) -> Column:
            totals = F.transform(chunks, lambda c: F.aggregate(c, zero, combine))
            return let(
                appended(totals),
                lambda heads: F.array_append(
                    F.flatten(
                        F.transform(
                            chunks,
                            lambda c, i: F.transform(
                                F.slice(appended(c), F.lit(1), F.size(c)),
                                lambda x: combine(F.get(heads, i), x),
                            ),
                        )
                    ),
                    F.element_at(heads, -1),
                ),
            )

        return let(width, lambda w: let(cut(w), shifted))

    return let(values, chunked)


def with_matches(df: DataFrame, text: str, kind: Kind, name: str) -> DataFrame:
    """Adds `name`: the matches of a kind that pass its check.

    An array of (kind, start, stop, value), start and stop in code points, stop
    exclusive; leftmost matches that do not overlap.
    """
    literal = F.lit(kind.pattern)

    def matches(group: int) -> Column:
        return F.regexp_extract_all(text, literal, F.lit(group))

    def placed(found: Column) -> Column:
        checked = matches(kind.group) if kind.group else F.transform(found, lambda m: m)
        gaps = F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(found))
        parts = F.transform(
            F.arrays_zip(found.alias("m"), gaps.alias("gap"), checked.alias("c")),
            lambda p: F.struct(
                p["m"].alias("m"),
                F.length(p["gap"]).cast("long").alias("gap"),
                F.length(p["m"]).cast("long").alias("size"),
                kind.check(p["c"]).alias("good"),
            ),
        )
        return let(parts, located)

    def located(parts: Column) -> Column:
        steps = F.transform(parts, lambda p: p["gap"] + p["size"])
        return let(
            before_each(steps, F.lit(0).cast("long"), lambda a, b: a + b),
            lambda sums: F.transform(
                F.filter(
                    F.transform(
                        parts,
                        lambda p, i: F.struct(
                            (F.get(sums, i) + p["gap"]).alias("start"),
                            F.get(sums, i + 1).alias("stop"),
                            p["m"].alias("value"),
                            p["good"].alias("good"),
                        ),
                    ),
                    lambda s: s["good"],
                ),
                lambda s: F.struct(F.lit(kind.name).alias("kind"), s["start"], s["stop"], s["value"]),
            ),
        )

    none = F.array().cast("array<struct<kind:string,start:bigint,stop:bigint,value:string>>")
    hits = F.when(kind.hint(F.col(text)), let(matches(0), placed))
    return df.withColumn(name, F.coalesce(hits, none))


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others, by start. Spans are never empty.

    Both are sorted together. What lies before a span must stop before it, what
    follows must start behind it; overlaps among the others do not matter.
    """
    far = (1 << 62)

    def marked(side: Column, mine: bool) -> Column:
        return F.transform(
            side,
            lambda s: F.struct(
                s["start"].alias("start"),
                F.lit(mine).alias("mine"),
                s["stop"].alias("stop"),
                (s["value"] if mine else F.lit(None).cast("string")).alias("value"),
                (s["kind"] if mine else F.lit(None).cast("string")).alias("kind"),
            ),
        )

    def checked(both: Column) -> Column:
        stops = F.transform(both, lambda s: F.when(s["mine"], F.lit(0)).otherwise(s["stop"]).cast("long"))
        starts = F.reverse(
            F.transform(both, lambda s: F.when(s["mine"], F.lit(far)).otherwise(s["start"]).cast("long"))
        )
        reached = before_each(stops, F.lit(0).cast("long"), lambda a, b: F.greatest(a, b))
        following = F.reverse(
            before_each(starts, F.lit(far).cast("long"), lambda a, b: F.least(a, b))
        )
        return let(
            reached,
            lambda behind: let(
                following,
                lambda ahead: F.filter(
                    both,
                    lambda s, i: s["mine"]
                    & (F.get(behind, i) <= s["start"])
                    & (F.get(ahead, i + 1) >= s["stop"]),
                ),
            ),
        )

    kept = let(F.array_sort(F.concat(marked(spans, True), marked(others, False))), checked)
    plain = F.transform(kept, lambda s: F.struct(s["kind"], s["start"], s["stop"], s["value"]))
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), plain).otherwise(spans)


def replaced(text: str, spans: Column) -> Column:
    """The text with spans (start, stop, mark), by start, replaced by their marks.

    Overlapping spans leave the first mark.
    """

    def part(pieces: Column, start: Column, stop: Column) -> Column:
        """Code points from start to stop; only the pieces they lie in are walked."""
        first = F.floor(start / PIECE).cast("int")
        last = F.floor((stop - 1) / PIECE).cast("int")
        some = F.array_join(F.slice(pieces, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
        return F.substring(some, (start % PIECE + 1).cast("int"), (stop - start).cast("int"))

    def filled(s: Column, done: Column, pieces: Column) -> Column:
        kept = F.transform(
            s,
            lambda x, i: let(
                F.get(done, i),
                lambda d: F.when(
                    x["start"] >= d, F.concat(part(pieces, d, x["start"]), x["mark"])
                ).otherwise(""),
            ),
        )
        rest = part(pieces, F.element_at(done, -1), F.length(text).cast("long"))
        return F.concat(F.array_join(kept, ""), rest)

    def clean(s: Column) -> Column:
        stops = F.transform(s, lambda x: x["stop"])
        return let(
            before_each(stops, F.lit(0).cast("long"), lambda a, b: F.greatest(a, b)),
            lambda done: let(
                F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)),
                lambda pieces: filled(s, done, pieces),
            ),
        )

    return F.when(F.size(spans) > 0, let(spans, clean)).otherwise(F.col(text))


def joined(spans: Column) -> Column:
    """`kind:start:end`, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")
            ),
        ),
        ",",
    )


def by_start(spans: Column, kinds: list[str]) -> Column:
    """Spans by start, then by kind as listed."""
    listed = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.array_position(listed, s["kind"]).alias("place"),
            s["stop"].alias("stop"),
            s["kind"].alias("kind"),
            s["value"].alias("value"),
        ),
    )
    return F.transform(
        F.array_sort(keyed), lambda s: F.struct(s["kind"], s["start"], s["stop"], s["value"])
    )
