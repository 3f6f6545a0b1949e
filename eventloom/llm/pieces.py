"""Encode and decode with a merge-type (BPE) SentencePiece model.

Encoding does not replay merges. Aho-Corasick finds the pieces that start at
each position; the encoder walks from left to right with the longest piece, and
accepts it if it can stand beside the piece before it: re-merging the text of
both must give these two pieces again. If nothing fits, it steps back, tries the
next shorter piece, and marks the position as failed, so that no position is
left twice. A sequence in which all neighbours fit is the one that merging gives.

This rests on scores that order all merges. Runs of blanks are the exception:
their pieces share one lowest score, merge last and from the left, and come from
a table made by merging.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import whole_text
from eventloom.session import ship_package

BLANK = "▁"
#: Cached units (blank and word) and the longest one kept, per Python worker.
CACHE_UNITS = 400_000
CACHE_LENGTH = 64
_UNITS = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")


class MergeEncoder:
    """A model read from its file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm, kinds = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        if (
            model.trainer_spec.model_type != 2
            or not model.trainer_spec.byte_fallback
            or norm.precompiled_charsmap
            or norm.remove_extra_whitespaces
            or not (norm.add_dummy_prefix and norm.escape_whitespaces)
        ):
            raise ValueError("a BPE model with byte fallback and plain normalisation is needed")
        self.ids: dict[str, int] = {}
        self.score: list[float] = []
        self.surface: list[bytes] = []
        self.is_normal = [False] * len(model.pieces)
        self.byte_id = [0] * 256
        self.begin = self.end = -1
        for i, piece in enumerate(model.pieces):
            self.score.append(piece.score)
            self.surface.append(b"")
            if piece.type == kinds.NORMAL:
                self.ids[piece.piece] = i
                self.is_normal[i] = True
                self.surface[i] = piece.piece.replace(BLANK, " ").encode()
            elif piece.type == kinds.BYTE:
                value = int(piece.piece[3:5], 16)
                self.byte_id[value] = i
                self.surface[i] = bytes([value])
            elif piece.type == kinds.UNKNOWN:
                self.surface[i] = (model.trainer_spec.unk_surface or " ⁇ ").encode()
            elif piece.type == kinds.CONTROL:
                if piece.piece == (model.trainer_spec.bos_piece or "<s>"):
                    self.begin = i
                elif piece.piece == (model.trainer_spec.eos_piece or "</s>"):
                    self.end = i
            else:
                raise ValueError(f"pieces of type {piece.type} are not supported")
        words = [p for p in self.ids if p.strip(BLANK)]
        if (
            len({self.score[self.ids[p]] for p in words}) < len(words)
            or any(BLANK in p.lstrip(BLANK) or p.startswith(BLANK * 2) for p in words)
            or any(c not in self.ids for p in words for c in p)
            or len({self.score[self.ids[p]] for p in self.ids if not p.strip(BLANK)}) > 1
        ):
            raise ValueError("pieces must merge in one order, and blanks stand first")
        self.characters = frozenset(p for p in self.ids if len(p) == 1)
        longest = max(len(p) for p in self.ids if not p.strip(BLANK))
        runs = [[self.ids[p] for p in self.merged(BLANK * n)] for n in range(3 * longest)]
        self.blank_runs = runs[:longest]
        if any(ids != self.run_of_blanks(n) for n, ids in enumerate(runs)):
            raise ValueError("long runs of blanks must begin with the longest piece")
        self.trie = ahocorasick.Automaton()
        for piece in words:
            # A piece that merging its own characters does not give is never used.
            if len(piece) == 1 or self.merged(piece) == [piece]:
                self.trie.add_word(piece, len(piece))
        self.trie.add_word(BLANK, 1)
        self.trie.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.units: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by its definition: best score first, then leftmost."""
        parts = list(text)
        while True:
            best = None
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best[0]):
                    best = (self.score[i], k)
            if best is None:
                return parts
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def fits(self, left: str, right: str) -> bool:
        """Whether two pieces stay apart when their text is merged again."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= CACHE_UNITS:
                self.pairs.clear()
            known = self.merged(left + right) == [left, right]
            self.pairs[left, right] = known
        return known

    def backtrack(self, text: str) -> list[str]:
        """Pieces of a text all of whose characters are pieces."""
        starts: list[list[int]] = [[] for _ in text]
        for end, length in self.trie.iter(text):
            starts[end - length + 1].append(length)
        # Matches of one start are found by ascending length.
        failed = bytearray(len(text) + 1)
        found: list[str] = []
        left: list[int] = []  # per accepted piece, how many shorter ones are untried
        at, untried = 0, len(starts[0])
        while at < len(text):
            before = found[-1] if found else None
            piece = None
            while untried:
                untried -= 1
                length = starts[at][untried]
                if not failed[at + length]:
                    piece = text[at : at + length]
                    if before is None or self.fits(before, piece):
                        break
                    piece = None
            if piece is not None:
                found.append(piece)
                left.append(untried)
                at += len(piece)
                untried = len(starts[at]) if at < len(text) else 0
            else:
                if not found:
                    raise ValueError(f"no encoding of {text[:50]!r}")
                failed[at] = 1
                at -= len(found.pop())
                untried = left.pop()
        return found

    def unit(self, unit: str) -> bytes:
        """The ids of one unit, as little-endian 32-bit values."""
        ids: list[int] = []
        word = unit.lstrip(BLANK)
        n = len(unit) - len(word)
        run: list[str] = []
        stretches: list[str | int] = []
        if word and self.characters.issuperset(word):
            stretches.append(word)
            word = ""
        for char in word:
            if char in self.characters:
                run.append(char)
            else:
                if run:
                    stretches.append("".join(run))
                    run = []
                stretches.extend(self.byte_id[b] for b in char.encode())
        if run:
            stretches.append("".join(run))
        if n:
            # Words merge before blanks do, so the last blank belongs to the word first.
            if stretches and isinstance(stretches[0], str):
                pieces = self.backtrack(BLANK + stretches[0])
                n -= pieces[0] != BLANK
                ids.extend(self.run_of_blanks(n))
                ids.extend(self.ids[p] for p in pieces[pieces[0] == BLANK :])
                stretches = stretches[1:]
            else:
                ids.extend(self.run_of_blanks(n))
        for part in stretches:
            if isinstance(part, str):
                ids.extend(self.ids[p] for p in self.backtrack(part))
            else:
                ids.append(part)
        return array("I", ids).tobytes()

    def run_of_blanks(self, n: int) -> list[int]:
        """Ids of n blanks: the longest piece again and again, then what merging gives."""
        full, rest = divmod(n, len(self.blank_runs))
        longest = self.ids[BLANK * len(self.blank_runs)]
        return [longest] * full + self.blank_runs[rest]

    def encode(self, text: str) -> bytes:
        """All ids with begin and end, as little-endian 32-bit values."""
        parts = [array("I", [self.begin]).tobytes()]
        if text:
            known, units = self.units, _UNITS.findall((" " + text).replace(" ", BLANK))
            for unit in units:
                ids = known.get(unit)
                if ids is None:
                    ids = self.unit(unit)
                    if len(unit) <= CACHE_LENGTH:
                        if len(known) >= CACHE_UNITS:
                            known.clear()
                        known[unit] = ids
                parts.append(ids)
        parts.append(array("I", [self.end]).tobytes())
        return b"".join(parts)

    def decode(self, ids: array | list[int]) -> str:
        """The text of ids. The blank put before the text goes, bytes that are not
        UTF-8 become U+FFFD each."""
        data = b"".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if self.surface[i]), None)
        if first is not None and self.is_normal[first] and data.startswith(b" "):
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return data.decode(errors="one_by_one")


def _one_by_one(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


@lru_cache(maxsize=2)
def encoder(path: str) -> MergeEncoder:
    """One encoder per worker and model, so that its caches live on."""
    import codecs

    codecs.register_error("one_by_one", _one_by_one)
    return MergeEncoder(path)


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """`doc_id, n_tokens, ids_sha256, decoded_sha256` of every row; `keep_ids` adds `ids`.

    `path` is the model file, present on every machine. Missing texts count as
    empty: an empty text has the begin and the end id only. Rows are independent,
    so repeated rows repeat their result; other columns are not read.
    """
    ship_package(docs.sparkSession)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                counts, hashes, texts, kept = [], [], [], []
                for text in part.column(1):
                    data = model.encode(text.as_py())
                    ids = array("I", data)
                    counts.append(len(ids))
                    hashes.append(hashlib.sha256(data).hexdigest())
                    texts.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
                    if keep_ids:
                        kept.append(ids)
                columns = [
                    part.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(hashes, pa.string()),
                    pa.array(texts, pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(
        encoded, schema + (", ids array<bigint>" if keep_ids else "")
    )
