"""Secrets in text: known forms, and strings that look random.

Known forms are patterns. Other long strings are judged by a battery of tests on
the alphabet their characters suggest: are all symbols equally frequent, do they
cross the middle as often as chance would, is a symbol independent of the one
before? Fisher's method joins the three p-values. Keys and tokens pass; words,
names and counters do not.

Which p-values count as passing follows from all different strings of a corpus;
copies of a string say nothing about others. Among strings of one alphabet and similar length the p-values of random ones are
spread evenly, those of others lie near 0. Twice the number above one half thus
estimates how many are random, and each threshold has an expected share of false
finds. The lowest threshold at which it stays below a limit is used, by alphabet
and length, as short strings are harder to tell apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import whole_text
from eventloom.llm.spans import Kind, apart, by_start, joined, let, with_matches
from eventloom.session import materialise

#: Expected share of false finds that is accepted, and steps of the thresholds.
FALSE_SHARE, STEPS = 0.1, 20
LEAST_LENGTH = 20

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
#: Alphabets from narrow to wide, as a character class and in the order of their values.
ENCODINGS = [
    ("hex_lower", "0-9a-f", _DIGITS + "abcdef"),
    ("hex_upper", "0-9A-F", _DIGITS + "ABCDEF"),
    ("base32", "A-Z2-7", _UPPER + "234567"),
    ("lower36", "0-9a-z", _DIGITS + _LOWER),
    ("upper36", "0-9A-Z", _DIGITS + _UPPER),
    ("base62", "A-Za-z0-9", _DIGITS + _UPPER + _LOWER),
    ("base64", "A-Za-z0-9+/", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", "A-Za-z0-9_-", _UPPER + _LOWER + _DIGITS + "-_"),
]

_KEYWORDS = "password|passwd|secret|token|api_?key"

KINDS = [
    Kind(
        "assign",
        rf"(?i:{_KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        lambda t: t.rlike(rf"(?i:{_KEYWORDS})[\"'\x20:=]"),
        lambda value: F.length(value) >= 8,
        group=1,
    ),
    # A run that is too short fails as a whole, so the least length stands in the pattern.
    Kind("access", r"AKIA[A-Z0-9]{12,}", lambda t: t.contains("AKIA"), lambda m: F.lit(True)),
    Kind("hex", r"[0-9a-f]{32,}", lambda t: t.rlike(r"[0-9a-f]{32}"), lambda m: F.lit(True)),
]
BASE = [k.name for k in KINDS]
RANDOM = "random"

_STRING = "[A-Za-z0-9+/_-]"
_STRINGS = Kind(
    RANDOM,
    rf"(?<!{_STRING}){_STRING}{{{LEAST_LENGTH},}}+",
    lambda t: t.rlike(rf"{_STRING}{{{LEAST_LENGTH}}}"),
    lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"),
)


def _below(z: Column) -> Column:
    """Normal distribution function, to three digits."""
    return 1 / (1 + F.exp(-1.5976 * z - 0.07056 * z * z * z))


def _both_sides(z: Column) -> Column:
    return 2 * (1 - _below(F.abs(z)))


def battery(x: Column, k: int) -> Column:
    """Joint p-value of the tests for an array of symbols 1..k: near 0 if not random."""
    n = F.size(x).cast("double")
    ordered = F.aggregate(
        F.array_sort(x),
        F.struct(F.lit(0).alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("squares")),
        lambda a, s: let(
            F.when(s == a["last"], a["run"] + 1).otherwise(1),
            lambda run: F.struct(
                s.alias("last"),
                run.alias("run"),
                # Counts squared, as the sum of odd numbers up to each count.
                (a["squares"] + 2 * run - 1).cast("double").alias("squares"),
            ),
        ),
    )["squares"]
    free = k - 1
    spread = ordered * k / n - n
    cube = F.pow(F.greatest(spread, F.lit(0.0)) / free, F.lit(1 / 3))
    uniform = 1 - _below((cube - (1 - 2 / (9 * free))) / (2 / (9 * free)) ** 0.5)
    middle, variance = (k + 1) / 2, (k * k - 1) / 12
    pairs = F.arrays_zip(
        F.slice(x, F.lit(1), F.size(x) - 1).alias("a"), F.slice(x, F.lit(2), F.size(x) - 1).alias("b")
    )
    walked = F.aggregate(
        pairs,
        F.struct(F.lit(0.0).alias("crossed"), F.lit(0.0).alias("product")),
        lambda a, p: F.struct(
            (a["crossed"] + F.when((p["a"] > middle) != (p["b"] > middle), 1.0).otherwise(0.0)).alias(
                "crossed"
            ),
            (a["product"] + (p["a"] - middle) * (p["b"] - middle)).alias("product"),
        ),
    )
    runs = let(
        walked,
        lambda w: F.struct(
            _both_sides((w["crossed"] - (n - 1) / 2) / F.sqrt((n - 1) / 4)).alias("runs"),
            _both_sides(w["product"] / (variance * F.sqrt(n - 1))).alias("serial"),
        ),
    )

    def fisher(r: Column) -> Column:
        least = F.lit(1e-12)
        half = -(
            F.log(F.greatest(uniform, least))
            + F.log(F.greatest(r["runs"], least))
            + F.log(F.greatest(r["serial"], least))
        )
        return let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))

    return let(runs, fisher)


def _symbols(value: Column, alphabet: str) -> Column:
    """Places of the characters in an alphabet, from 1."""
    places = F.map_from_arrays(
        F.array(*[F.lit(c) for c in alphabet]),
        F.array(*[F.lit(i + 1) for i in range(len(alphabet))]),
    )
    characters = F.filter(F.split(value, ""), lambda c: c != "")
    return F.transform(characters, lambda c: F.element_at(places, c))


def _p_value(value: Column, alphabet: str) -> Column:
    return let(_symbols(value, alphabet), lambda x: battery(x, len(alphabet)))


def judged(span: Column) -> Column:
    """A string with its stratum (alphabet and length class) and its p-value."""
    value = span["value"]
    length = F.floor(2 * F.log2(F.length(value).cast("double"))).cast("string")
    stratum, p = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, letters, alphabet in reversed(ENCODINGS):
        fits = value.rlike(f"^[{letters}]+$")
        stratum = F.when(fits, F.concat(F.lit(f"{name}:"), length)).otherwise(stratum)
        p = F.when(fits, _p_value(value, alphabet)).otherwise(p)
    return F.struct(
        span["kind"].alias("kind"),
        span["start"].alias("start"),
        span["stop"].alias("stop"),
        value.alias("value"),
        stratum.alias("stratum"),
        p.alias("p"),
    )


def least_p(strings: DataFrame, false_share: float = FALSE_SHARE) -> dict[str, float]:
    """By stratum, the lowest p-value that counts as random.

    `strings` has `stratum, value, p`, a row per string of the corpus, of which
    each different one counts once. Only counts per stratum and step, of which
    there is a bounded number, reach the driver.
    """
    step = F.least(F.floor(F.col("p") * STEPS), F.lit(STEPS - 1)).cast("int")
    counts = (
        strings.where("p is not null")
        .select("stratum", "value", step.alias("step"))
        .distinct()
        .groupBy("stratum", "step")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    by_stratum: dict[str, list[int]] = {}
    for row in counts:
        by_stratum.setdefault(row["stratum"], [0] * STEPS)[row["step"]] = row["n"]
    found = {}
    for stratum, bins in by_stratum.items():
        random = 2 * sum(bins[STEPS // 2 :])
        for low in range(STEPS):
            taken = sum(bins[low:])
            expected = min(taken, random * (1 - low / STEPS))
            if taken and (taken - expected) / taken <= false_share:
                found[stratum] = low / STEPS
                break
    return found


def find_secrets(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """`doc_id`, counts `n_assign, n_access, n_hex`, `base_sha256`, `spans` for every row.

    `spans` has the base spans and those of random strings (kind 'random'), which
    never overlap a base span, by start, then kind. Missing texts count as empty
    and have no spans. Rows are independent but for the thresholds, which follow
    from all of them. Other columns are not read.
    """
    df = docs.select("doc_id", whole_text().alias("text"))
    for kind in [*KINDS, _STRINGS]:
        df = with_matches(df, "text", kind, f"m_{kind.name}")
    df = df.withColumn("base", F.concat(*[f"m_{k}" for k in BASE]))
    found = materialise(
        df.withColumn("apart", apart(F.col(f"m_{RANDOM}"), F.col("base"))).select(
            "doc_id", by_start(F.col("base"), BASE).alias("base"), F.transform("apart", judged).alias("strings")
        )
    )
    strings = found.select(F.explode("strings").alias("s")).select("s.stratum", "s.value", "s.p")
    limits = least_p(strings, false_share)
    if limits:
        known = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
        random = F.filter("strings", lambda s: s["p"] >= F.element_at(known, s["stratum"]))
    else:
        random = F.filter("strings", lambda s: F.lit(False))
    plain = F.transform(random, lambda s: F.struct(s["kind"], s["start"], s["stop"], s["value"]))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(by_start(F.concat("base", plain), [*BASE, RANDOM])).alias("spans"),
    )
