"""How many tokens a public tokenizer's library gives for every text.

Only lengths leave the Python workers. A text is cut where the library's result
is known not to depend on the other side, so that counts add up:

* Tokenizers that drop white space: at every blank, tab and line end. White space
  is never part of a token, it ends special strings, and no character composes
  with the one behind it. Plain Latin texts are cut into words as the tokenizer
  does. Words come again and again, so their counts are kept per worker.
* Byte-level tokenizers that keep the blank before a word, and SentencePiece models
  whose pieces have blanks in front only: texts over `LONG` characters are cut at
  single blanks between two ASCII letters. SentencePiece puts that blank back itself.
* Other tokenizers get whole texts.

What is left to encode is handed to the library in batches of about `BATCH_BYTES`.
A stretch of ASCII letters that is still very long is encoded in windows that overlap.
Tokens are those that merging gives if merging each two neighbours gives them again,
so two windows may be put together at any token that both have.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import whole_text
from eventloom.session import ship_package

#: Tokens a text may have before it is over the limit.
LIMIT = 2048
#: Bytes the library is handed at once, and characters from which a text is cut.
BATCH_BYTES = 1 << 20
LONG = 1 << 16
#: Characters that two windows of one stretch of letters share.
OVERLAP = 1 << 10
#: Counts kept per worker, and the longest stretch that is kept.
CACHE_UNITS, CACHE_LENGTH = 400_000, 64
BLANK = "▁"

# Texts of these characters are composed already and split by the next pattern, once in
# lower case. A special string would begin with "<|".
_LATIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*\Z")
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t\n\v\f\ra-zß-öø-ÿ0-9]+")
_STRETCH = re.compile(r"[^ \t\n\r]+")
# Digits are tokens by themselves; Han characters end at these full stops and commas.
_INSIDE = re.compile(r"(?<=[0-9])(?=[0-9A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[一-鿿])(?=[、。，！？])")
_LETTERS = re.compile(r"[A-Za-z]+\Z")
_BLANK = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")

# The splitting of the tokenizer that drops white space.
WORDS_AND_DIGITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cut(text: str, places: re.Pattern, drop: int = 0) -> Iterator[str]:
    """The text in parts of at least `LONG` characters, cut at the given places.

    `drop` characters after each place belong to no part.
    """
    start = 0
    while len(text) - start > LONG:
        found = places.search(text, start + LONG)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start() + drop
    yield text[start:]


def in_batches(texts: list[str], encode: Callable[[list[str]], list[int]]) -> list[int]:
    """Counts of texts that are encoded whole, about `BATCH_BYTES` at once."""
    counts: list[int] = []
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text) if text.isascii() else len(text.encode())
        if size >= BATCH_BYTES or i + 1 == len(texts):
            counts.extend(encode(texts[start : i + 1]))
            start, size = i + 1, 0
    return counts


def in_parts(texts: list[str], places: re.Pattern, drop: int, encode) -> list[int]:
    """Counts of texts that are encoded in parts."""
    parts = [list(cut(text, places, drop)) for text in texts]
    flat = iter(in_batches([part for text in parts for part in text], encode))
    return [sum(next(flat) for _ in text) for text in parts]


class JsonCounter:
    """Counts of a `tokenizers` file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            shape = json.load(file)
        safe = shape["model"]["type"] == "BPE" and not any(
            t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])
            for t in shape["added_tokens"]
        )
        self.drops_blanks = safe and _drops_blanks(shape)
        self.keeps_blank = safe and _keeps_blank(shape)
        self.known: dict[str, int] = {}

    def encode(self, texts: list[str]) -> list[int]:
        return list(map(len, self.library.encode_batch_fast(texts, add_special_tokens=False)))

    def counts(self, texts: list[str]) -> list[int]:
        if self.drops_blanks:
            return self.by_stretch(texts)
        if self.keeps_blank:
            return in_parts(texts, _BLANK, 0, self.encode)
        return in_batches(texts, self.encode)

    def by_stretch(self, texts: list[str]) -> list[int]:
        """Counts of texts whose words, or stretches between white space, are counted once."""
        known = self.known
        if len(known) >= CACHE_UNITS:
            known.clear()
        stretches = [
            _WORD.findall(text.lower())
            if _LATIN.match(text) and "<|" not in text
            else _STRETCH.findall(text)
            for text in texts
        ]
        new = list({s for text in stretches for s in text if s not in known})
        short = [s for s in new if len(s) <= LONG]
        fresh = dict(zip(short, in_batches(short, self.encode), strict=True))
        fresh.update((s, self.long_stretch(s)) for s in new if len(s) > LONG)
        known.update((s, n) for s, n in fresh.items() if len(s) <= CACHE_LENGTH)
        return [
            sum(fresh[s] if (n := known.get(s)) is None else n for s in text) for text in stretches
        ]

    def long_stretch(self, stretch: str) -> int:
        parts = list(cut(stretch, _INSIDE))
        words = [p for p in parts if len(p) > 2 * LONG and _LETTERS.match(p)]
        others = [p for p in parts if not (len(p) > 2 * LONG and _LETTERS.match(p))]
        return sum(map(self.letters, words)) + sum(in_batches(others, self.encode))

    def letters(self, word: str) -> int:
        """Count of one very long stretch of ASCII letters, window by window."""
        total, at = 0, 0
        spans = self.spans(word, at)
        while at + LONG + OVERLAP < len(word):
            at += LONG
            following = self.spans(word, at)
            # The last token of a window ends a word, others do not.
            here = {span: i for i, span in enumerate(spans[:-1])}
            common = next((i for i, span in enumerate(following) if span in here), None)
            if common is None:
                return self.encode([word])[0]
            total += here[following[common]]
            spans = following[common:]
        return total + len(spans)

    def spans(self, word: str, at: int) -> list[tuple[int, int]]:
        """Tokens of a window as places in the word."""
        found = self.library.encode(word[at : at + LONG + OVERLAP], add_special_tokens=False)
        return [(at + a, at + b) for a, b in found.offsets]


def _drops_blanks(shape: dict) -> bool:
    """Whether a tokenizer splits into words, single digits and signs, without white space."""
    norm, split = shape["normalizer"], shape["pre_tokenizer"]
    steps = (norm or {}).get("normalizers", [])
    first, *later = (split or {}).get("pretokenizers", [{}])
    return (
        [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
        and steps[1]["pattern"] == {"Regex": "\\s+"}
        and steps[1]["content"] == " "
        and first.get("pattern") == {"Regex": WORDS_AND_DIGITS}
        and first["behavior"] == "Removed"
        and first["invert"]
        and [(s["type"], s["add_prefix_space"], s["use_regex"]) for s in later] == [("ByteLevel", False, False)]
    )


def _keeps_blank(shape: dict) -> bool:
    """Whether a tokenizer takes bytes, and the one blank before a word with the word."""
    split = shape["pre_tokenizer"]
    return (
        shape["normalizer"] is None
        and split is not None
        and (split["type"], split.get("add_prefix_space"), split.get("use_regex")) == ("ByteLevel", False, True)
    )


class ModelCounter:
    """Counts of a `sentencepiece` file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm = model.normalizer_spec
        self.blank_in_front = (
            model.trainer_spec.model_type == 2
            and norm.add_dummy_prefix
            and norm.escape_whitespaces
            and not norm.remove_extra_whitespaces
            and not norm.precompiled_charsmap
            and not any(BLANK in p.piece.lstrip(BLANK) or " " in p.piece for p in model.pieces)
        )

    def encode(self, texts: list[str]) -> list[int]:
        return list(map(len, self.library.encode(texts, num_threads=1)))

    def counts(self, texts: list[str]) -> list[int]:
        if self.blank_in_front:
            return in_parts(texts, _BLANK, 1, self.encode)
        return in_batches(texts, self.encode)


@lru_cache(maxsize=2)
def counter(path: str) -> JsonCounter | ModelCounter:
    """One counter per worker and file, so that its counts are kept."""
    return ModelCounter(path) if path.endswith(".model") else JsonCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """`doc_id, n_bytes, n_tokens, over_limit` of every row.

    `path` is a `.json` file of tokenizers or a `.model` file of sentencepiece,
    present on every machine; without begin, end or other added tokens, special
    strings in a text as the library takes them. A missing text counts as empty,
    with 0 of both. Rows are independent: repeated rows repeat their result, a
    missing doc_id stays missing, an empty table gives none; other columns are
    not read.
    """
    ship_package(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(path)
        for batch in batches:
            texts = batch.column(1)
            # A few texts at once, by bytes: their stretches are all in memory.
            ends = batch.column(2).to_numpy().cumsum() // BATCH_BYTES
            counts: list[int] = []
            while len(counts) < len(ends):
                size = int((ends[len(counts) :] == ends[len(counts)]).sum())
                counts.extend(model.counts(texts.slice(len(counts), size).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", whole_text().alias("text"))
    counts = texts.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(
        counted, f"doc_id {kind}, n_bytes bigint, n_tokens bigint"
    )
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
