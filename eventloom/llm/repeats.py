"""Passages that repeat across a corpus, found on suffixes and removed byte by byte.

A window of 200 bytes has an anchor: the place in it whose 32 bytes have the
smallest hash. Equal windows have equal anchors, so only suffixes that begin at
anchors are sorted, about one in 84, and only those whose 32 bytes occur twice.
Each brings the text its windows span, cut at the anchor into a left and a right
part.

Suffixes with one anchor are sorted by their right parts. With the lengths their
neighbours share they form an enhanced suffix array; a scan with a stack walks
its tree of common-prefix intervals. The members of an interval share r bytes to
the right. Sorted by what stands to their left they show how far they agree
there, l bytes: where the left extensions differ a repeat of l + r bytes is
maximal, and all members that agree are its occurrences. Those of 200 bytes and
more are removed wherever they stand.

An anchor with very many occurrences is not brought together. The windows of its
different texts are counted by hash, which splits at will.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import whole_text
from eventloom.session import materialise, ship_package

LENGTH = 200
ANCHOR = 32
#: Occurrences of one anchor that are sorted together: some tens of megabytes in a task.
TOGETHER = 65_536
#: Suffixes handled at once by a task.
BLOCK = 16_384

_TABLE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * 2 + 1
_BASE = 0x9E3779B97F4A7C15
_WRAP = 2**64


def _anchor_hashes(data: np.ndarray, width: int = ANCHOR) -> np.ndarray:
    """A hash of the `width` (a power of two) bytes at every place."""
    hashes, span = _TABLE[data], 1
    while span < width:
        factor = np.uint64(pow(_BASE, span, _WRAP))
        hashes = hashes[:-span] * factor + hashes[span:]
        span *= 2
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(32)
    return hashes


def anchors(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(hash, place, first, last): anchors and the starts of the windows they stand for."""
    if len(data) < length:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    hashes = _anchor_hashes(np.frombuffer(data, dtype=np.uint8))
    reach = length - ANCHOR + 1
    least, span = hashes, 1
    while span * 2 <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < reach:
        rest = reach - span
        least = np.minimum(least[:-rest], least[rest:])
    # A new anchor: the old one has left the window, or a smaller one has come in.
    gone = hashes[: len(least) - 1] == least[:-1]
    first = np.concatenate([[0], np.nonzero(gone | (least[1:] != least[:-1]))[0] + 1])
    last = np.concatenate([first[1:], [len(least)]]) - 1
    place = np.empty(len(first), dtype=np.int64)
    for i in range(0, len(first), 512):
        rows = first[i : i + 512]
        inside = hashes[rows[:, None] + np.arange(reach)] == least[rows][:, None]
        place[i : i + 512] = rows + inside.argmax(axis=1)
    return hashes[place], place, first, last


def _all_anchors(texts: DataFrame, length: int) -> DataFrame:
    """`anchor, text_key, place`: the place is packed with the two window bounds."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                hashes, keys, places = [], [], []
                part = batch.slice(start, 256)
                for text, key in zip(part.column(0), part.column(1).to_numpy(), strict=True):
                    value, place, first, last = anchors(text.as_buffer().to_pybytes(), length)
                    hashes.append(value)
                    keys.append(np.full(len(value), key, dtype=np.int64))
                    places.append(place << 20 | (place - first) << 10 | (place - last))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(hashes).view(np.int64)),
                        pa.array(np.concatenate(keys)),
                        pa.array(np.concatenate(places)),
                    ],
                    ["anchor", "text_key", "place"],
                )

    return (
        texts.select("text", "text_key")
        .where(F.octet_length("text") >= length)
        .mapInArrow(found, "anchor bigint, text_key bigint, place bigint")
    )


def _shared(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Bytes that the rows of two matrices have in common at their beginning."""
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(first, np.minimum(size_a, size_b))


class _Least:
    """Smallest value between two places of an array, by a table of powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        span = 1
        while span * 2 <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-span], last[span:]))
            span *= 2

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Over low..high, both included."""
        level = np.log2(high - low + 1).astype(np.int64)
        found = np.empty(len(low), dtype=np.int64)
        for k in np.unique(level):
            at = level == k
            values = self.levels[k]
            found[at] = np.minimum(values[low[at]], values[high[at] + 1 - (1 << int(k))])
        return found


def _rows(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(-1, width)


class SuffixBlock:
    """Suffixes of whole anchor groups, in order of their right parts."""

    def __init__(self, group: np.ndarray, left: list[bytes], right: list[bytes]):
        n = len(group)
        self.n = n
        self.left_size = np.fromiter(map(len, left), np.int64, n)
        right_size = np.fromiter(map(len, right), np.int64, n)
        same = group[1:] == group[:-1]
        rights = _rows(right, max(1, int(right_size.max())))
        shared = _shared(rights[1:], rights[:-1], right_size[1:], right_size[:-1])
        #: Bytes shared with the suffix before; -1 at the start of a group.
        self.lcp = np.concatenate([[-1], np.where(same, shared, -1)])
        lefts = _rows([p[::-1] for p in left], max(1, int(self.left_size.max())))
        text = np.ascontiguousarray(lefts).view(f"S{lefts.shape[1]}").ravel()
        number = np.concatenate([[0], np.cumsum(~same)])
        order = np.lexsort((self.left_size, text, number))
        self.rank = np.empty(n, dtype=np.int64)
        self.rank[order] = np.arange(n)
        self.by_rank = order
        size = self.left_size[order]
        alike = _shared(lefts[order[1:]], lefts[order[:-1]], size[1:], size[:-1])
        alike = np.where(number[order[1:]] == number[order[:-1]], alike, -1)
        #: Bytes to the left shared by suffixes of neighbouring rank.
        self.lcs = _Least(np.concatenate([alike, [-1]]))

    def intervals(self) -> Iterator[tuple[int, int, int]]:
        """(depth, first, last) of the common-prefix intervals, inner ones first."""
        stack: list[tuple[int, int]] = []
        for i, depth in enumerate([*self.lcp.tolist()[1:], -1], start=1):
            start = i - 1
            while stack and stack[-1][0] > depth:
                inner, start = stack.pop()
                yield inner, start, i - 1
            if depth >= 0 and (not stack or stack[-1][0] < depth):
                stack.append((depth, start))

    def agreeing(self, depth: int, first: int, last: int, length: int):
        """Members of an interval by left order, and the left bytes each pair of neighbours
        shares; None if no two share enough for a repeat of `length`."""
        ranks = np.sort(self.rank[first : last + 1])
        alike = self.lcs.between(ranks[:-1], ranks[1:] - 1)
        if alike.max() + depth < length:
            return None
        return self.by_rank[ranks], alike

    def covered(self, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(members, left bytes, right bytes) of maximal repeats of at least `length` bytes.

        Per interval, each member with the longest repeat it is part of; what a
        deeper interval covers already is left out.
        """
        best = np.full(self.n, -1, dtype=np.int64)
        for depth, first, last in self.intervals():
            found = self.agreeing(depth, first, last, length)
            if found is None:
                continue
            members, alike = found
            reach = np.maximum(np.append(alike, -1), np.insert(alike, 0, -1))
            new = (reach + depth >= length) & (reach > best[members])
            if new.any():
                members, reach = members[new], reach[new]
                best[members] = reach
                yield members, reach, depth

    def groups(self, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(left bytes, right bytes, members) of every maximal repeat: all its occurrences.

        Left extensions are tested by a second scan over the members in left
        order. A repeat whose members all lie in one inner interval is longer
        there, and reported there.
        """
        lcp = _Least(self.lcp)
        for depth, first, last in self.intervals():
            found = self.agreeing(depth, first, last, length)
            if found is None:
                continue
            members, alike = found
            stack: list[tuple[int, int]] = []
            for i, left in enumerate([*alike.tolist(), -1], start=1):
                start = i - 1
                while stack and stack[-1][0] > left:
                    inner, start = stack.pop()
                    group = np.sort(members[start:i])
                    shared = lcp.between(group[:1] + 1, group[-1:])[0]
                    if inner + depth >= length and shared == depth:
                        yield inner, depth, group
                if left >= 0 and (not stack or stack[-1][0] < left):
                    stack.append((left, start))


_SUFFIX = "anchor bigint, text_key bigint, start bigint, split int, passage binary"


def _suffix_blocks(batches: Iterator[pa.RecordBatch]):
    """Blocks of whole anchor groups, with text key and anchor place of each suffix."""
    held: list[pa.RecordBatch] = []
    count = 0

    def block(rows: pa.Table):
        split = rows["split"].to_numpy()
        passage = rows["passage"].to_pylist()
        left = [p[:s] for p, s in zip(passage, split, strict=True)]
        right = [p[s:] for p, s in zip(passage, split, strict=True)]
        place = rows["start"].to_numpy() + split
        return SuffixBlock(rows["anchor"].to_numpy(), left, right), rows["text_key"].to_numpy(), place

    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= BLOCK:
            rows = pa.Table.from_batches(held)
            anchor = rows["anchor"].to_numpy()
            # Rows are sorted by anchor: the last group may go on in the next batch.
            cut = len(anchor) - int((anchor == anchor[-1]).sum())
            if cut:
                yield block(rows.slice(0, cut).combine_chunks())
            held = rows.slice(cut).combine_chunks().to_batches()
            count = len(anchor) - cut
    if count:
        yield block(pa.Table.from_batches(held).combine_chunks())


def _sorted_suffixes(suffixes: DataFrame) -> DataFrame:
    """One anchor's suffixes in one task, in suffix order."""
    return suffixes.repartition("anchor").sortWithinPartitions(
        "anchor", F.expr("substring(passage, split + 1)")
    )


def _covered_together(suffixes: DataFrame, length: int) -> DataFrame:
    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, keys, place in _suffix_blocks(batches):
            found = list(block.covered(length))
            if found:
                members = np.concatenate([m for m, _, _ in found])
                left = np.concatenate([x for _, x, _ in found])
                right = np.concatenate([np.full(len(m), r) for m, _, r in found])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[members]),
                        pa.array(place[members] - left),
                        pa.array(place[members] + right),
                    ],
                    ["text_key", "start", "stop"],
                )

    return _sorted_suffixes(suffixes).mapInArrow(
        covered, "text_key bigint, start bigint, stop bigint"
    )


def _covered_apart(suffixes: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many occurrences: windows are counted by hash.

    Equal passages are one row first. A window is known by its anchor and a hash
    of all its bytes, 128 bits together.
    """
    name = ["anchor", "passage_key"]
    keyed = suffixes.withColumn("passage_key", F.xxhash64("passage"))
    distinct = keyed.groupBy(*name, "passage").agg(F.count(F.lit(1)).alias("copies"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows, hashes, places = [], [], []
                for i, passage in enumerate(part.column("passage").to_pylist()):
                    n = len(passage) - length + 1
                    hashes.extend(
                        xxhash.xxh64_intdigest(passage[k : k + length]) for k in range(n)
                    )
                    rows.append(np.full(n, i))
                    places.append(np.arange(n))
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("anchor").take(take),
                        part.column("passage_key").take(take),
                        part.column("copies").take(take),
                        pa.array(np.array(hashes, dtype=np.uint64).view(np.int64)),
                        pa.array(np.concatenate(places)),
                    ],
                    ["anchor", "passage_key", "copies", "window", "offset"],
                )

    cut = distinct.mapInArrow(
        windows,
        "anchor bigint, passage_key bigint, copies bigint, window bigint, offset bigint",
    )
    often = cut.groupBy("anchor", "window").agg(F.sum("copies").alias("n")).where("n > 1").drop("n")
    runs = (
        cut.join(often, ["anchor", "window"])
        .groupBy(*name)
        .agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
    )
    return keyed.join(runs, name).select(
        "text_key",
        F.explode("offsets").alias("offset"),
        F.col("start").alias("from"),
    ).select(
        "text_key",
        (F.col("from") + F.col("offset")).alias("start"),
        (F.col("from") + F.col("offset") + length).alias("stop"),
    )


def _keyed(docs: DataFrame) -> DataFrame:
    text = whole_text()
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_key"))


def _suffixes(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Suffixes at anchors that occur twice, and the number of each different text's copies.

    Copies of a text bring their suffixes once.
    """
    keyed = _keyed(docs)
    ship_package(docs.sparkSession)
    found = _all_anchors(keyed, length)
    place = F.xxhash64("text_key", "place")
    counts = (
        found.groupBy(F.col("anchor").alias("same"))
        .agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count(F.lit(1)).alias("n"))
        .where("low <> high")
        .select("same", (F.col("n") > TOGETHER).alias("many"))
    )
    repeated = materialise(
        found.join(counts, F.col("anchor") == F.col("same"))
        .select("text_key", "anchor", "place", "many")
        .distinct()
    )
    texts = keyed.groupBy("text_key", F.xxhash64(F.lit(1), "text").alias("check")).agg(
        F.min("doc_id").alias("one"), F.count(F.lit(1)).alias("copies")
    )
    texts = materialise(texts)
    listed = (
        repeated.groupBy(F.col("text_key").alias("of_text"))
        .agg(F.collect_list(F.struct("anchor", "place", "many")).alias("anchors"))
        .join(texts.select(F.col("text_key").alias("of_text"), "one"), "of_text")
    )
    suffixes = (
        keyed.join(listed, F.col("text_key") == F.col("of_text"))
        .where(F.col("doc_id").eqNullSafe(F.col("one")))
        .select("text_key", "text", F.explode("anchors").alias("a"))
        .select(
            "text_key",
            "a.anchor",
            "a.many",
            F.expr("cast(shiftright(a.place, 10) & 1023 as int)").alias("split"),
            F.expr("shiftright(a.place, 20) - (shiftright(a.place, 10) & 1023)").alias("start"),
            F.expr("cast((shiftright(a.place, 10) & 1023) - (a.place & 1023) as int)").alias("more"),
            "text",
        )
        .select(
            "anchor",
            "text_key",
            "start",
            "split",
            "many",
            F.expr(
                f"substring(cast(text as binary), cast(start as int) + 1, {length} + more)"
            ).alias("passage"),
        )
    )
    many = not repeated.where("many").isEmpty()
    return suffixes if many else suffixes.withColumn("many", F.lit(False)), texts


def repeat_groups(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """`group, length, text_key, start`: maximal repeats with all their occurrences.

    Repeats of at least `length` bytes, as seen around one anchor: at most 168
    bytes to the left and 200 to the right of it. Equal texts occur once here.
    Anchors with more than TOGETHER occurrences are not listed; `remove_repeats`
    covers them.
    """
    suffixes, _ = _suffixes(docs, length)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, keys, place in _suffix_blocks(batches):
            for left, right, members in block.groups(length):
                text, start = keys[members], place[members] - left
                order = np.lexsort((start, text))
                name = f"{text[order[0]]}:{start[order[0]]}:{left + right}"
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(members)),
                        pa.array(np.full(len(members), left + right)),
                        pa.array(text),
                        pa.array(start),
                    ],
                    ["group", "length", "text_key", "start"],
                )

    return _sorted_suffixes(suffixes.where("not many")).mapInArrow(
        listed, "group string, length bigint, text_key bigint, start bigint"
    )


def _runs(size: int, start: np.ndarray, stop: np.ndarray, length: int):
    """Maximal removed runs of a text of `size` bytes: their starts and stops."""
    stop = np.minimum(stop, size)
    good = stop - start >= length
    start, stop = start[good], stop[good]
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    first = np.concatenate([[True], start[1:] > stop[:-1]])[: len(start)]
    last = np.concatenate([first[1:], [True]])[: len(start)]
    return start[first], stop[last]


def _rest(data: bytes, starts: np.ndarray, stops: np.ndarray) -> list[bytes]:
    """The stretches between the runs."""
    edges = [0, *np.stack([starts, stops], axis=1).ravel().tolist(), len(data)]
    return [data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """`doc_id, n_bytes, n_removed, n_spans, kept_sha256` for every row; `keep_text` adds
    `kept`, the bytes that stay.

    Each byte goes that lies in a string of `length` bytes which starts anywhere
    else, too: in another text, a copy, or elsewhere in the same text. Missing
    texts count as empty; shorter ones than `length` stay whole. Repeated rows
    are copies of each other. Other columns are not read.
    """
    suffixes, texts = _suffixes(docs, length)
    spans = _covered_together(suffixes.where("not many"), length).unionByName(
        _covered_apart(suffixes.where("many"), length)
    )
    # All of a text goes if it has a copy.
    copied = texts.where("copies > 1").select(
        "text_key", F.lit(0).cast("long").alias("start"), F.lit(2**62).alias("stop")
    )
    listed = (
        spans.unionByName(copied)
        .groupBy(F.col("text_key").alias("of_text"))
        .agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy()
            start = lists.values.field("start").to_numpy(zero_copy_only=False)
            stop = lists.values.field("stop").to_numpy(zero_copy_only=False)
            present = lists.is_valid().to_numpy(zero_copy_only=False)
            sizes, removed, runs, digests, kept = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                data = text.as_buffer().to_pybytes()
                part = slice(offsets[i], offsets[i + 1])
                spans = (start[part], stop[part]) if present[i] else (none, none)
                starts, stops = _runs(len(data), *spans, length)
                rest = _rest(data, starts, stops)
                digest = hashlib.sha256()
                for stretch in rest:
                    digest.update(stretch)
                sizes.append(len(data))
                removed.append(int((stops - starts).sum()))
                runs.append(len(starts))
                digests.append(digest.hexdigest())
                if keep_text:
                    kept.append(b"".join(rest))
            columns = [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(runs, pa.int64()),
                pa.array(digests, pa.string()),
            ]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                columns.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    keyed = _keyed(docs)
    return (
        keyed.join(listed, F.col("text_key") == F.col("of_text"), "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(cut, schema + (", kept binary" if keep_text else ""))
    )

