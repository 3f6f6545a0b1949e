"""Mix sources to target weights with thresholds on a hash.

Every document has a hash that does not depend on the mix. A source with budget
B takes all documents whose hash is below a threshold: the largest one at which
the sizes below do not exceed B. A larger budget keeps what a smaller one took.
The threshold is found without sorting documents: sizes are summed up per source
and hash bucket, the bucket in which the budget ends is cut into finer buckets,
and so on. Each step counts only the documents of the boundary bucket, and sums
at most 4096 buckets per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import with_rank
from eventloom.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60
BUCKET_BITS = 12


def size_of(text: Column) -> Column:
    """Words of a text; 0 if it is missing."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column, text: Column) -> Column:
    """60 bits of an MD5 over the id and the text; equal rows agree."""
    key = F.concat(
        F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit(""))
    )
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def source_targets(
    sized: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: tuple[int, int] = (3, 2),
    most: int = 2,
) -> DataFrame:
    """`source, source_size, above, below`: a source's target is above / below words.

    Sources in code point order (missing last) weigh `weights`, repeating. They
    share `share` of all words; no target exceeds `most` times its source, and
    what is left over goes to the others by weight, until none is above. Only
    four sums per round reach the driver. `sized` has `source` and `size`.
    """
    numerator, denominator = share
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.col("source").asc_nulls_last()
    repeated = F.array(*[F.lit(w) for w in weights])
    ranked = materialise(
        with_rank(totals, order).select(
            "source",
            "source_size",
            F.element_at(repeated, (F.col("rank") % len(weights) + 1).cast("int"))
            .cast("long")
            .alias("weight"),
        )
    )
    ceiling = F.lit(most) * F.col("source_size")
    above, below, capped = 0, 1, -1
    while True:
        # A source is full when its part by weight reaches its ceiling.
        full = F.lit(False) if capped < 0 else F.col("weight") * above >= ceiling * below
        total, fixed, open_weight, n_full = ranked.agg(
            F.sum("source_size"),
            F.sum(F.when(full, ceiling).otherwise(0)),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))),
            F.sum(full.cast("int")),
        ).first()
        if total is None or n_full == capped or not open_weight:
            break
        capped = n_full
        above = numerator * total - denominator * fixed
        below = denominator * open_weight
    full = F.col("weight") * above >= ceiling * below
    return ranked.select(
        "source",
        "source_size",
        F.when(full, ceiling).otherwise(F.col("weight") * above).alias("above"),
        F.when(full, F.lit(1)).otherwise(F.lit(below)).cast("long").alias("below"),
    )


def thresholds(hashed: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets with `passes`, whole turns of the source, and `threshold`.

    A document is taken `passes` times, and once more if its hash is below the
    threshold. `hashed` has `source, size, hash`. The document at which the
    budget ends is taken when at least half of it fits.
    """
    whole = F.when(
        F.col("source_size") > 0, F.expr("above div (below * source_size)")
    ).otherwise(F.lit(0))
    plan = (
        targets.withColumn("passes", whole)
        .withColumn("budget", F.expr("above div below - passes * source_size"))
        .withColumn("prefix", F.lit(0).cast("long"))
    )
    filled = hashed.where("size > 0").select(F.col("source").alias("s"), "size", "hash")
    for left in range(HASH_BITS - BUCKET_BITS, -1, -BUCKET_BITS):
        bucket = F.shiftright("hash", left)
        boundary = plan.select("source", "budget", "prefix")
        sums = (
            filled.withColumn("bucket", bucket)
            .join(
                boundary,
                F.col("s").eqNullSafe(F.col("source"))
                & (F.shiftright("bucket", BUCKET_BITS) == F.col("prefix")),
            )
            .groupBy("source", "bucket", "budget")
            .agg(F.sum("size").alias("inside"))
        )
        until = Window.partitionBy("source").orderBy("bucket")
        ends = (
            sums.withColumn("until", F.sum("inside").over(until))
            .where("until > budget")
            .groupBy("source")
            .agg(
                F.min(F.struct("bucket", "until", "inside")).alias("end"),
            )
            .select(
                F.col("source").alias("s"),
                F.col("end.bucket").alias("bucket"),
                F.expr("end.until - end.inside").alias("before"),
                F.col("end.inside").alias("inside"),
            )
        )
        plan = materialise(
            plan.drop("inside").join(ends, F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source",
                "source_size",
                "above",
                "below",
                "passes",
                F.expr("budget - coalesce(before, 0)").alias("budget"),
                F.coalesce("bucket", F.lit(0)).alias("prefix"),
                F.coalesce("inside", F.lit(0)).alias("inside"),
            )
        )
    last = F.when(F.expr("inside > 0 and 2 * budget >= inside"), 1).otherwise(0)
    return plan.select(
        "source",
        "source_size",
        (F.col("above") / F.col("below")).alias("target"),
        "passes",
        (F.col("prefix") + last).alias("threshold"),
    )


def mix(hashed: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows with their source's plan and `copies`, how often the mix takes them."""
    plan = plan.withColumnRenamed("source", "plan_source")
    return (
        hashed.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
        .withColumn(
            "copies",
            F.col("passes") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0),
        )
        .drop("plan_source")
    )


def mix_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: tuple[int, int] = (3, 2),
    most: int = 2,
) -> DataFrame:
    """`doc_id, source, size, source_size, target, taken` for every row.

    `taken` counts words with repeats. Empty and missing texts have size 0 and
    take nothing; a missing source is a source of its own; rows equal in id and
    text are taken alike; without any word every target is 0. Other columns are
    not read.
    """
    sized = materialise(
        docs.select(
            "doc_id",
            "source",
            size_of(F.col("text")).alias("size"),
            hash_of(F.col("doc_id"), F.col("text")).alias("hash"),
        )
    )
    plan = thresholds(sized, source_targets(sized, weights, share, most))
    return mix(sized, plan).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


def mixed_corpus(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: tuple[int, int] = (3, 2),
    most: int = 2,
) -> DataFrame:
    """The documents of the mix, all columns, each as often as it is taken.

    A document without words is in the mix as often as one of its source with
    the same hash.
    """
    own = docs.columns
    hashed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"),
        F.col("source"),
        hash_of(F.col("doc_id"), F.col("text")).alias("hash"),
    )
    sized = materialise(
        docs.select(
            "source",
            size_of(F.col("text")).alias("size"),
            hash_of(F.col("doc_id"), F.col("text")).alias("hash"),
        )
    )
    plan = thresholds(sized, source_targets(sized, weights, share, most))
    return (
        mix(hashed, plan)
        .where("copies > 0")
        .withColumn("copy", F.explode(F.expr("sequence(1, cast(copies as int))")))
        .select("row.*")
    )
