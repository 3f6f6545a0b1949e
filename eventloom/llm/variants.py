"""Spelling variants of words, found with pivotal grams.

Two words that differ in one code point share a bigram that the difference does not
touch. Bigrams are ordered from rare to common. The prefix of a word is its three
rarest bigrams (with all that are as common as the third), its pivots are two of
them that do not overlap and are rare together. Of two near words, the one whose
prefix ends with the rarer bigram has a pivot that is in the other one's prefix.

The difference lies behind that bigram or before it. So the bigram is at the same
place counted from the front, and all up to it is equal; or at the same place counted
from the back, and all from it on is equal. Pivots and prefixes are joined on a hash
of the equal part, which holds the bigram and its place, and pairs are verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import whole_text
from eventloom.session import materialise, ship_package

#: Code points and occurrences a word needs, and how much commoner its form must be.
LEAST_LENGTH, LEAST_COUNT, COMMONER = 7, 2, 10
# One run in so many loses a code point.
DAMAGE = 31
#: Bigrams that one difference may touch, and one more.
PREFIX = 3
#: Longest word that is carried along with its entries.
CARRIED = 64
#: Bytes of a text that are cut into words at once, and words counted before they are handed on.
PART_BYTES, COUNTED_WORDS = 1 << 20, 200_000

# Letters A-Z and a-z in lower case, and U+00C0 to U+00FF, in UTF-8.
_LETTER = rb"(?:[a-z]|\xc3[\x80-\xbf])"
_RUN = re.compile(_LETTER + rb"{%d,}" % LEAST_LENGTH)
_OTHER = re.compile(rb"[^a-z\xc3\x80-\xbf]")


def _parts(data: bytes) -> Iterator[bytes]:
    """A text in parts that end outside of words."""
    start = 0
    while len(data) - start > PART_BYTES:
        found = _OTHER.search(data, start + PART_BYTES)
        if not found:
            break
        yield data[start : found.start()]
        start = found.start()
    yield data[start:]


def damaged(doc_id: str, run: bytes) -> str:
    """A lower-case run, without one code point where the hash of document and run says so."""
    word = run.decode()
    found = zlib.crc32(f"{doc_id}:{word}".encode())
    if found % DAMAGE == 0:
        place = found % len(word)
        word = word[:place] + word[place + 1 :]
    return word


def count_words(docs: DataFrame) -> DataFrame:
    """`word, n`: damaged words of whole texts that are long and frequent enough.

    Only A-Z become lower-case. A missing doc_id counts as an empty string.
    """
    ship_package(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for part in _parts(text.as_py().encode().lower()):
                    for run, n in Counter(_RUN.findall(part)).items():
                        found[damaged(doc_id, run)] += n
                    if len(found) >= COUNTED_WORDS:
                        yield _counts(found)
                        found.clear()
        yield _counts(found)

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), whole_text().alias("text"))
    return (
        texts.mapInArrow(counted, "word string, n bigint")
        .where(F.length("word") >= LEAST_LENGTH)
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= LEAST_COUNT)
    )


def _counts(found: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"]
    )


def gram_ranks(words: DataFrame) -> dict[str, int]:
    """Words per bigram. There are 90 letters, so at most 8100 bigrams reach the driver."""
    places = F.explode(F.expr("sequence(1, length(word) - 1)"))
    grams = words.select("word", places.alias("place")).select(F.substring("word", F.col("place"), F.lit(2)).alias("gram"))
    return {r["gram"]: r["n"] for r in grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}


def prefix_and_pivots(word: str, count: dict[str, int]) -> tuple[list[int], tuple[int, int], tuple[int, str]]:
    """Places of a word's rarest bigrams, two of them that do not overlap, and the last in order."""
    order = sorted((count[word[i : i + 2]], word[i : i + 2], i) for i in range(len(word) - 1))
    last = order[min(PREFIX, len(order)) - 1][:2]
    places = sorted(i for n, gram, i in order if (n, gram) <= last)
    # Least cost of one bigram so far, and of two: the second begins behind the first.
    one: list[tuple[int, int]] = []
    two = None
    for k, i in enumerate(places):
        cost = count[word[i : i + 2]]
        free = k - 1 if k and places[k - 1] == i - 1 else k
        if free:
            before = one[free - 1]
            two = min(filter(None, (two, (before[0] + cost, before[1], i))))
        one.append(min([(cost, i), *one[-1:]]))
    return places, two[1:], last


def keys_of(word: str, places: list[int]) -> list[tuple[int, int]]:
    """Hashes of all up to the bigram at each place, and of all from it on, read backwards."""
    ahead, behind = xxhash.xxh64(seed=0), xxhash.xxh64(seed=1)
    fronts, backs = [], []
    at, back, end = 0, word[::-1], 0
    for i in places:
        ahead.update(word[at : i + 2].encode())
        at = i + 2
        fronts.append(ahead.intdigest())
    for i in reversed(places):
        behind.update(back[end : len(word) - i].encode())
        end = len(word) - i
        backs.append(behind.intdigest())
    return list(zip(fronts, reversed(backs), strict=True))


def index_words(words: DataFrame, count: dict[str, int]) -> DataFrame:
    """`role, key, word, n, id, length, letters, last`: two entries per pivot (role 0) and prefix bigram (1).

    `word` is missing if it is longer than `CARRIED`, `id` is a hash of it, `letters` has a bit for each letter that is there an
    odd number of times, `last` is the place of the prefix's last bigram in their order.
    """
    ship_package(words.sparkSession)
    order = {gram: k for k, (_, gram) in enumerate(sorted((n, gram) for gram, n in count.items()))}

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for word, n, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                places, pivots, last = prefix_and_pivots(word, count)
                letters = 0
                for c in word:
                    letters ^= 1 << ord(c) % 63
                rest = (word if len(word) <= CARRIED else None, n, name, len(word), letters, order[last[1]])
                for i, sides in zip(places, keys_of(word, places), strict=True):
                    found += [(1, key, *rest) for key in sides]
                    if i in pivots:
                        found += [(0, key, *rest) for key in sides]
                if len(found) >= COUNTED_WORDS:
                    yield _entries(found)
                    found = []
            yield _entries(found)

    return words.select("word", "n", F.xxhash64("word")).mapInArrow(
        entries, "role tinyint, key bigint, word string, n bigint, id bigint, length int, letters bigint, last int"
    )


def _entries(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [()] * 8
    keys = pa.array(columns[1], pa.uint64()).view(pa.int64())
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
    others = [pa.array(c, kind) for c, kind in zip(columns[2:], kinds, strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int8()), keys, *others],
        ["role", "key", "word", "n", "id", "length", "letters", "last"],
    )


def near_words(words: DataFrame) -> DataFrame:
    """`a, a_n, b, b_n`: each pair of words that differ in one code point, once."""
    index = materialise(index_words(words, gram_ranks(words)))
    # Words of usual length come with their entries, so that a pair is verified where it meets.
    near = F.levenshtein("p", "q", 1) == 1
    short = _meetings(index.where(F.col("length") <= CARRIED), "word", "n").where(near)
    first = F.col("p") < F.col("q")
    ends = {"a": ("p", "q"), "a_n": ("p_n", "q_n"), "b": ("q", "p"), "b_n": ("q_n", "p_n")}
    either = [F.when(first, F.col(x)).otherwise(F.col(y)).alias(name) for name, (x, y) in ends.items()]
    # Longer ones meet by a hash; words that share it all come back, and are told apart here.
    ids = _meetings(index.where(F.col("length") >= CARRIED), "id", "length")
    ids = ids.where(F.greatest("p_length", "q_length") > CARRIED).select(
        F.least("p", "q").alias("a_id"), F.greatest("p", "q").alias("b_id")
    )
    of = lambda p: words.where(F.length("word") >= CARRIED).select(
        F.xxhash64("word").alias(f"{p}_id"), F.col("word").alias(p), F.col("n").alias(f"{p}_n")
    )
    long = ids.distinct().join(of("a"), "a_id").join(of("b"), "b_id").select(*ends).mapInArrow(
        _one_apart, "a string, a_n bigint, b string, b_n bigint"
    )
    return short.select(*either).distinct().unionByName(long)


def one_apart(a: str, b: str) -> bool:
    """Whether two words differ in one code point, in time that grows with their length."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    same, end = 0, len(a)
    while same < end:
        middle = (same + end + 1) // 2
        if a[same:middle] == b[same:middle]:
            same = middle
        else:
            end = middle - 1
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def _one_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("a"), batch.column("b"), strict=True)
        yield batch.filter(pa.array([one_apart(a.as_py(), b.as_py()) for a, b in pairs], pa.bool_()))


def _meetings(index: DataFrame, name: str, more: str) -> DataFrame:
    """`p, q`, the words (by a column of the index) of each pivot and each prefix that it meets.

    `p_{more}` and `q_{more}` come with them.
    """
    side = lambda role, p: index.where(F.col("role") == role).select(
        "key",
        F.col(name).alias(p),
        *[F.col(c).alias(f"{p}_{c}") for c in dict.fromkeys((more, "length", "letters", "last"))],
    )
    # One code point more, less or other changes one or two letters' bits.
    likely = (
        (F.col("p_last") <= F.col("q_last"))
        & (F.col("p") != F.col("q"))
        & (F.abs(F.col("p_length") - F.col("q_length")) <= 1)
        & (F.bit_count(F.col("p_letters").bitwiseXOR(F.col("q_letters"))) <= 2)
    )
    return side(0, "p").join(side(1, "q"), "key").where(likely)


def follow(links: DataFrame) -> DataFrame:
    """`word, root` of `word, form` links that lead to ever commoner words.

    Each round doubles the steps; a chain has as many as the counts have digits.
    """
    current = materialise(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = materialise(
            current.join(ahead, "root", "left").select(
                "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")
            )
        )
        current = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return current


def spelling_variants(docs: DataFrame) -> DataFrame:
    """`word, form, root, n, n_near, form_n` of every word of the texts.

    The form of a word is the commonest word that differs in one code point (ties: the
    smallest), if it is ten times as common; the root is the last of its forms, or the
    word itself. Missing and empty texts have no words, repeated rows count again, an
    empty table gives no rows; other columns are not read.
    """
    words = materialise(count_words(docs))
    # Both directions of a pair from one row, so that the pairs are made once.
    ways = [F.struct(F.col(x).alias("word"), F.col(y).alias("near"), F.col(f"{y}_n").alias("near_n")) for x, y in ("ab", "ba")]
    both = near_words(words).select(F.inline(F.array(*ways)))
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    common = F.coalesce(-F.col("best.less") >= COMMONER * F.col("n"), F.lit(False))
    named = materialise(
        words.join(best, "word", "left").select(
            "word",
            F.when(common, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(common, -F.col("best.less")).alias("form_n"),
        )
    )
    roots = follow(named.where("form is not null"))
    return named.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
