"""Fingerprints by spot signatures.

A spot signature is a common word with the content words that follow it. Common
words stand everywhere in running prose but seldom in menus and boilerplate, so
the set of a text's signatures tells what it says. Sets are compared by Jaccard
similarity; sets of very different length cannot be alike, so each carries the
class of its length, and pairs of distant classes are settled without comparing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import in_blocks, whole_text

#: Common words of the languages at hand; content words are all others.
COMMON = (
    "a an and are as at be by for from had has he in is it of on or that the this to was with "
    "au avec ce dans de des du elle en est et il la le les ne on ou par pas pour que qui se sur un une "
    "auf aus bei das dem den der die ein eine er es im ist mit nicht sich sie und von war zu "
    "al con del el era esta las lo los no para por se sin su una y"
).split()
#: Content words in a signature.
CHAIN = 2
#: Lengths of one class differ by less than this factor: sets two classes apart
#: have a similarity below it.
CLASS_FACTOR = 0.8
OFFSET = 1 << 31
_WORD = r"[\p{L}\p{N}]+"


def signatures(text: Column) -> Column:
    """Sorted distinct signatures of a text: CRC-32 values less 2^31, to fit in an INT.

    Where a text has no common word, each of its words counts as one, so that
    every text with words has signatures. Chains at the end are shorter.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))
    tagged = F.transform(
        words, lambda w: F.struct(w.alias("word"), w.isin(COMMON).alias("common"))
    )

    def chained(tagged: Column) -> Column:
        spots = F.filter(
            F.transform(
                tagged,
                lambda t, i: F.struct(
                    t["word"].alias("word"), t["common"].alias("common"), i.alias("at")
                ),
            ),
            lambda t: t["common"],
        )
        content = F.transform(F.filter(tagged, lambda t: ~t["common"]), lambda t: t["word"])
        return _let(
            F.struct(spots.alias("spots"), content.alias("content")),
            # Before the m-th common word, at place i, stand i - m content words.
            lambda s: F.when(
                F.size(s["spots"]) > 0,
                F.transform(
                    s["spots"],
                    lambda t, m: _signature(
                        t["word"], F.slice(s["content"], t["at"] - m + 1, F.lit(CHAIN))
                    ),
                ),
            ).otherwise(
                F.transform(
                    s["content"],
                    lambda w, i: _signature(w, F.slice(s["content"], i + 2, F.lit(CHAIN))),
                )
            ),
        )

    return F.sort_array(F.array_distinct(_let(tagged, chained)))


def _let(value: Column, then) -> Column:
    return F.transform(F.array(value), then)[0]


def _signature(word: Column, chain: Column) -> Column:
    return (F.crc32(F.concat_ws(" ", word, chain)) - OFFSET).cast("int")


def fingerprint(spots: Column) -> Column:
    """All signatures of a set, 8 hex digits each; equal for equal sets only."""
    unsigned = F.transform(spots, lambda s: s.cast("bigint") + OFFSET)
    return F.array_join(F.transform(unsigned, lambda s: F.lower(F.lpad(F.hex(s), 8, "0"))), "")


def length_class(spots: Column) -> Column:
    """Classes by the logarithm of a set's length; -1 for the empty set."""
    size = F.size(spots).cast("double")
    return F.when(F.size(spots) == 0, -1).otherwise(
        F.floor(F.log(size) / F.log(F.lit(1 / CLASS_FACTOR))).cast("int")
    )


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; two empty sets are alike.

    Pairs whose lengths alone keep them below `least` get 0 without comparing.
    """
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return (
        F.when(large == 0, 1.0)
        .when((small == 0) | (small < large * least), 0.0)
        .otherwise(
            _let(
                F.size(F.array_intersect(a, b)).cast("double"),
                lambda both: both / (F.size(a) + F.size(b) - both),
            )
        )
    )


_KEY = ["no_id", "id", "text_key"]


def _successors(keyed: DataFrame) -> DataFrame:
    """Each different row with the key of the next one, and of the first for the last.

    Rows are numbered inside ranges of the order; only the first key of each
    range crosses from one range to another.
    """
    rows = in_blocks(keyed.select(*_KEY, "n_chars").distinct(), *map(F.col, _KEY))
    key = F.struct(*_KEY)
    firsts = rows.groupBy("block").agg(F.min(key).alias("first"))
    every = Window.orderBy("block")
    after = firsts.select(
        "block",
        F.coalesce(
            F.lead("first").over(every),
            F.min("first").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).alias("after"),
    )
    inside = Window.partitionBy("block").orderBy(*_KEY)
    return (
        rows.withColumn("next", F.lead(key).over(inside))
        .join(after, "block")
        .select(
            *[F.col(k).alias(f"of_{k}") for k in _KEY],
            F.floor(F.col("n_chars") / 4).cast("int").alias("moved"),
            *[F.coalesce("next", "after")[k].alias(f"next_{k}") for k in _KEY],
        )
    )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """`doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, n_spots, length_class` for every row of `docs`.

    The edited text ends in the beginning of the next document in place of its
    own last quarter. Documents follow each other by doc_id, missing ones last,
    and by a hash of the text where ids are equal; rows equal in both count as
    one document and are returned as often as they are there. Missing texts
    count as empty. Texts without words have an empty fingerprint. Other columns
    are not read.
    """
    text = whole_text()
    keyed = docs.select(
        "doc_id",
        text.alias("text"),
        F.col("doc_id").isNull().alias("no_id"),
        F.coalesce(F.col("doc_id"), F.lit(0)).alias("id"),
        F.xxhash64(text).alias("text_key"),
    )
    after = _successors(keyed.withColumn("n_chars", F.length("text")))
    # Both joins shuffle this table by its key and need the same columns of it, so
    # Spark makes that exchange once.
    texts = keyed.select(*_KEY, "text")
    heads = (
        texts.join(after, [F.col(k) == F.col(f"next_{k}") for k in _KEY])
        .select(
            *[f"of_{k}" for k in _KEY],
            "moved",
            F.expr("substring(text, 1, moved)").alias("head"),
            signatures(F.col("text")).alias("next_spots"),
        )
        .dropDuplicates([f"of_{k}" for k in _KEY])
    )
    joined = (
        texts.join(heads, [F.col(k) == F.col(f"of_{k}") for k in _KEY])
        .withColumn("doc_id", F.when(~F.col("no_id"), F.col("id")))
        .withColumn("spots", signatures(F.col("text")))
    )
    edited = F.expr("concat(substring(text, 1, length(text) - moved), head)")
    return (
        joined.withColumn("edited", edited)
        .withColumn("edited_spots", signatures(F.col("edited")))
        .select(
            "doc_id",
            F.length("text").cast("long").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            fingerprint(F.col("spots")).alias("fingerprint"),
            fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
            likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
            likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
            F.size("spots").alias("n_spots"),
            length_class(F.col("spots")).alias("length_class"),
        )
    )
