"""SimHash fingerprints and their near-duplicate groups, found with vantage-point trees.

Two fingerprints that differ in at most 3 bits differ in at most one bit of
their upper or of their lower half. Each half has a vantage-point tree of its
own, searched with radius 1, and each pair found is checked on all 64 bits. The
trees are built on the driver from a bounded sample of fingerprints and only
decide which shard a fingerprint lives in; every fingerprint is then placed in
one shard per half, and copied to each further shard that the triangle
inequality does not rule out. With the whole fingerprint and radius 3 most
branches would overlap: distances to a vantage point are spread by 4 bits only.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import whole_text
from eventloom.llm.components import components
from eventloom.session import materialise, ship_package

SEED = 42
SHINGLE = 3
RADIUS = 3
HALF_RADIUS = RADIUS // 2
#: Fingerprints a shard should have, and those the trees are built from at most.
SHARD_ROWS = 4096
SAMPLE_ROWS = 65_536
LEAF_ROWS = 256
#: Least similarity of near texts in the pipeline: shared shingles of all their shingles.
LEAST_LIKE = 0.8
#: Independent fingerprints where recall matters more than one exact distance, and the
#: bits of all of them that candidates differ in at most. Texts with 0.8 of their shingles
#: in common differ in 155 on average with a deviation of 11.5: 99 % of such pairs lie inside.
PRINTS, NEAR_BITS = 16, 184
#: Ways to put the bytes of all fingerprints together to 32-bit bands. Two bands of
#: different ways share one byte at most. Shards of bands are larger, as there are many.
BAND_WAYS, BAND_SHARD_ROWS = 4, 65_536
#: Bands of the waves before the last: a few join most of a large family, which meets in all.
FIRST_BANDS = (6, 24)
#: Members of one group of halves that are compared in one task, and those of small
#: groups that share a task.
BLOCK_ROWS, TASK_ROWS = 8192, 32_768
#: Shingles of one block of a family, and those of small families that share a task.
BLOCK_SHINGLES, TASK_SHINGLES = 2_000_000, 4_000_000
#: Groups up to this size are compared whole, many of them at once.
TINY_ROWS = 8
#: Shingles whose bits are counted at once.
STRIDE = 65_536


def fingerprints_of(text: str, shingle: int = SHINGLE, prints: int = 1) -> list[int]:
    """64-bit SimHashes of a text by independent hashes; 0 without words.

    Lower-cases A-Z; words end at ASCII white space, as in `bytes.split`. The
    first hash is XXH64, the others are mixed from it.
    """
    return _signs(shingle_hashes(text, shingle), prints)


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    words = text.encode().lower().split()
    if len(words) < shingle:
        parts = [b" ".join(words)] if words else []
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(p, SEED) for p in parts), dtype="<u8")


def _signs(hashes: np.ndarray, prints: int) -> list[int]:
    """Fingerprints of hashes: bits that more than half of them have."""
    found = []
    for number in range(prints):
        counts = np.zeros(64, dtype=np.int64)
        for start in range(0, len(hashes), STRIDE):
            block = _remixed(hashes[start : start + STRIDE], number).view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
        found.append(int(bits.view("<u8")[0]))
    return found


def _remixed(hashes: np.ndarray, number: int) -> np.ndarray:
    if not number:
        return hashes
    mixed = hashes + np.uint64(number * 0x9E3779B97F4A7C15 % 2**64)
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return mixed ^ (mixed >> np.uint64(31))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, prints: int = 1) -> DataFrame:
    """`doc_id, fingerprints` (BIGINTs, the bits of the unsigned values) for every row."""
    ship_package(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fingerprints_of(t.as_py(), shingle, prints) for t in batch.column(1)]
            values = np.array(rows, dtype=np.uint64).ravel().view(np.int64)
            starts = pa.array(np.arange(0, len(values) + 1, prints, dtype=np.int32))
            lists = pa.ListArray.from_arrays(starts, pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "fingerprints"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(
        hashed, f"doc_id {kind}, fingerprints array<bigint>"
    )


class VantageTree:
    """Nodes of a tree over 32-bit values, as arrays.

    A value goes left when its distance to the node's vantage point is at most
    the node's radius. Children below zero are leaves, numbered -1, -2, ...
    """

    def __init__(self, sample: np.ndarray, leaves: int):
        self.point: list[int] = []
        self.radius: list[int] = []
        self.children: list[tuple[int, int]] = []
        self.leaves = 0
        self.root = self._grow(sample, max(1, int(np.ceil(np.log2(max(1, leaves))))))

    def _grow(self, sample: np.ndarray, depth: int) -> int:
        # Where the sample is too thin to tell the sides apart, the shard stays whole.
        if depth and len(sample) >= 8:
            point = sample[len(sample) // 2]
            distance = np.bitwise_count(sample ^ point)
            radius = int(np.median(distance))
            left = distance <= radius
            if left.all():
                radius -= 1
                left = distance <= radius
            if left.any() and not left.all():
                node = len(self.point)
                self.point.append(int(point))
                self.radius.append(radius)
                self.children.append((0, 0))
                pair = (self._grow(sample[left], depth - 1), self._grow(sample[~left], depth - 1))
                self.children[node] = pair
                return node
        self.leaves += 1
        return -self.leaves

    def place(self, values: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(leaf, rows, home): each row once at home, and as a guest where a partner may live.

        Of two values on the two sides of a radius, the left one is the guest.
        """
        nothing = np.zeros(0, dtype=np.int64)
        stack = [(self.root, np.arange(len(values)), nothing)]
        while stack:
            node, homes, guests = stack.pop()
            if node < 0:
                yield -node - 1, homes, True
                yield -node - 1, guests, False
                continue
            point, radius = np.uint32(self.point[node]), self.radius[node]
            near = np.bitwise_count(values[homes] ^ point).astype(np.int64)
            far = np.bitwise_count(values[guests] ^ point).astype(np.int64)
            left, right = self.children[node]
            crossing = (near <= radius) & (near + reach > radius)
            stack.append((left, homes[near <= radius], guests[far - reach <= radius]))
            over = np.concatenate([guests[far + reach > radius], homes[crossing]])
            stack.append((right, homes[near > radius], over))


class Groups:
    """Union-find over rows 0..n-1 in numpy; the root is the smallest row."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, rows: np.ndarray) -> np.ndarray:
        root = self.parent[rows]
        while True:
            above = self.parent[root]
            if (above == root).all():
                return root
            root = above

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.find(a), self.find(b)
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))


class Crossings(Groups):
    """Joins the pairs only whose rows may be of different groups; `met` marks these rows."""

    def __init__(self, group: np.ndarray, mixed: np.ndarray) -> None:
        super().__init__(len(group))
        self.group, self.mixed = group, mixed
        self.met = np.zeros(len(group), dtype=bool)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = (self.group[a] != self.group[b]) | self.mixed[a] | self.mixed[b]
        a, b = a[apart], b[apart]
        self.met[a] = self.met[b] = True
        super().join(a, b)


def _link(
    values: np.ndarray,
    half: np.ndarray,
    homes: np.ndarray,
    queries: np.ndarray,
    groups: Groups,
    reach: int,
    most: int,
) -> None:
    """Join all pairs of a home and a query that differ in at most `most` bits.

    Goes down a local tree over the halves, of which `reach` bits may differ.
    """
    if not len(homes) or not len(queries):
        return
    if len(homes) > LEAF_ROWS:
        point = half[homes[len(homes) // 2]]
        near = np.bitwise_count(half[homes] ^ point).astype(np.int64)
        radius = int(np.median(near))
        radius -= int((near <= radius).all())
        left = near <= radius
        if left.any() and not left.all():
            far = np.bitwise_count(half[queries] ^ point).astype(np.int64)
            near_side, far_side = queries[far - reach <= radius], queries[far + reach > radius]
            _link(values, half, homes[left], near_side, groups, reach, most)
            _link(values, half, homes[~left], far_side, groups, reach, most)
            return
    for i in range(0, len(homes), LEAF_ROWS):
        block = homes[i : i + LEAF_ROWS]
        for j in range(0, len(queries), 16 * LEAF_ROWS):
            other = queries[j : j + 16 * LEAF_ROWS]
            close = np.bitwise_count(values[block][:, None] ^ values[other][None, :]) <= most
            a, b = np.nonzero(close)
            groups.join(block[a], other[b])


def shard_links(
    values: np.ndarray, homes: int, shift: int, reach: int = HALF_RADIUS, most: int = RADIUS
) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what a shard's links join; the first `homes` values live there.

    At most one edge per value: to the root of its group.
    """
    half = (values >> np.uint64(shift)).astype(np.uint32)
    groups = Groups(len(values))
    _link(values, half, np.arange(homes), np.arange(len(values)), groups, reach, most)
    rows = np.arange(len(values))
    roots = groups.find(rows)
    moved = rows != roots
    return values[rows[moved]], values[roots[moved]]


def near_links(
    distinct: DataFrame,
    shifts: tuple[int, ...] = (0, 32),
    reach: int = HALF_RADIUS,
    most: int = RADIUS,
    shard_rows: int | None = None,
) -> DataFrame:
    """Edges `number, a, b` that connect fingerprints exactly as links within `most` bits do.

    `distinct` has every `fingerprint` once, as BIGINT; where it has `number` as
    well, only fingerprints of one number are compared. Linked fingerprints must
    differ in at most `reach` bits in one of the 32-bit parts at `shifts`.
    """
    spark = distinct.sparkSession
    ship_package(spark)
    if "number" not in distinct.columns:
        distinct = distinct.withColumn("number", F.lit(0))
    n = distinct.count()
    every = max(1, n // SAMPLE_ROWS)
    # The sample only places the shards; its size is bounded for any input.
    rows = distinct.where(F.pmod(F.xxhash64("fingerprint"), F.lit(every)) == 0).limit(2 * SAMPLE_ROWS)
    sample = np.array([r[0] for r in rows.collect()], dtype=np.int64).view(np.uint64)
    sample = np.sort(sample)
    np.random.default_rng(SEED).shuffle(sample)
    numbers = (distinct.agg(F.max("number")).first()[0] or 0) + 1
    leaves = min(-(-n // numbers // (shard_rows or SHARD_ROWS)), max(1, len(sample) // 8))
    trees = [
        (shift, VantageTree((sample >> np.uint64(shift)).astype(np.uint32), leaves))
        for shift in shifts
    ]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            number = batch.column(1).to_numpy()
            for shift, tree in trees:
                half = (values >> np.uint64(shift)).astype(np.uint32)
                for leaf, found, home in tree.place(half, reach):
                    if len(found):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(found), 2 * leaf + (shift > 0), np.int32)),
                                pa.array(number[found]),
                                pa.array(np.full(len(found), home)),
                                pa.array(values[found].view(np.int64)),
                            ],
                            ["shard", "number", "home", "value"],
                        )

    def linked(shard: pa.Table) -> pa.Table:
        shift = 32 * (shard["shard"][0].as_py() % 2)
        home = shard["home"].to_numpy()
        values = shard["value"].to_numpy().view(np.uint64)
        values = np.concatenate([values[home], values[~home]])
        a, b = shard_links(values, int(home.sum()), shift, reach, most)
        number = np.full(len(a), shard["number"][0].as_py(), np.int32)
        return pa.table({"number": number, "a": a.view(np.int64), "b": b.view(np.int64)})

    return (
        distinct.select("fingerprint", F.col("number").cast("int"))
        .mapInArrow(placed, "shard int, number int, home boolean, value bigint")
        .groupBy("shard", "number")
        .applyInArrow(linked, "number int, a bigint, b bigint")
    )


def near_groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """`doc_id, fingerprint, component_id` for every row of `docs`.

    `fingerprint` is 16 lowercase hex digits; documents are linked when their
    fingerprints differ in at most 3 bits, and `component_id` is the smallest
    doc_id in reach. Missing and empty texts have fingerprint 0 and are linked
    like any other. Repeated rows keep their number. A missing doc_id stays
    missing and never names a component, unless the component has no other.
    Other columns are not read.
    """
    marked = materialise(
        fingerprints(docs, shingle).select("doc_id", F.col("fingerprints")[0].alias("fingerprint"))
    )
    distinct = materialise(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    roots = components(near_links(distinct).select("a", "b"))
    known = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    named = known.join(least, "root").select("fingerprint", "component_id")
    return marked.join(named, "fingerprint").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def _join_near(
    prints: np.ndarray, label: np.ndarray, groups: Groups, a: np.ndarray, b: np.ndarray, most: int
) -> None:
    """Join the labels of the pairs (a, b) that differ in at most `most` bits of all prints."""
    for i in range(0, len(a), STRIDE):
        x, y = a[i : i + STRIDE], b[i : i + STRIDE]
        apart = groups.find(label[x]) != groups.find(label[y])
        x, y = x[apart], y[apart]
        close = np.bitwise_count(prints[x] ^ prints[y]).sum(axis=1, dtype=np.int64) <= most
        groups.join(label[x[close]], label[y[close]])


def block_links(
    run: np.ndarray,
    home: np.ndarray,
    guest: np.ndarray,
    half: np.ndarray,
    group: np.ndarray,
    prints: np.ndarray,
    reach: int,
    most: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Edges between groups that join what the links of these rows join.

    Rows with one `run` are compared, homes with guests: they are linked when
    their halves differ in at most `reach` bits and all their prints in at most
    `most`. At most one edge per group, to the root of what it is joined to.
    """
    names, label = np.unique(group, return_inverse=True)
    groups = Groups(len(names))
    order = np.argsort(run, kind="stable")
    run = run[order]
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    sizes = np.diff(np.r_[starts, len(run)])
    tiny = np.repeat(sizes <= TINY_ROWS, sizes)
    for step in range(1, TINY_ROWS):
        at = np.flatnonzero((run[step:] == run[:-step]) & tiny[step:])
        a, b = order[at], order[at + step]
        met = (home[a] & guest[b]) | (guest[a] & home[b])
        met &= np.bitwise_count(half[a] ^ half[b]) <= reach
        _join_near(prints, label, groups, a[met], b[met], most)
    for start, size in zip(starts[sizes > TINY_ROWS], sizes[sizes > TINY_ROWS], strict=True):
        rows = order[start : start + size]
        homes, guests = rows[home[rows]], rows[guest[rows]]
        for i in range(0, len(homes), LEAF_ROWS):
            block = homes[i : i + LEAF_ROWS]
            close = np.bitwise_count(half[block][:, None] ^ half[guests][None, :]) <= reach
            close &= groups.find(label[block])[:, None] != groups.find(label[guests])[None, :]
            a, b = np.nonzero(close)
            _join_near(prints, label, groups, block[a], guests[b], most)
    rows = np.arange(len(names))
    roots = groups.find(rows)
    moved = rows != roots
    return names[rows[moved]], names[roots[moved]]


def bands_of(prints: np.ndarray) -> np.ndarray:
    """32-bit bands of rows of 64-bit fingerprints: way by way, as many as there are halves.

    Byte k of a band comes from byte k of some half. The first way are the halves themselves.
    """
    halves = np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), -1, 4)
    n = halves.shape[1]
    place, byte = np.arange(n)[:, None], np.arange(4)[None, :]
    ways = [halves[:, (place + way * byte) % n, byte] for way in range(BAND_WAYS)]
    whole = np.ascontiguousarray(np.concatenate(ways, axis=1))
    return whole.view(np.uint32).reshape(len(prints), -1)


def shingle_sets(docs: DataFrame, shingle: int, prints: int) -> DataFrame:
    """`doc_id, row, node, size, fingerprints, shingles` of every row of `docs`.

    Here each different shingle counts once: `shingles` has 32 bits of each, `size` is
    their number, `node` names the set, `row` the document with its text.
    """
    ship_package(docs.sparkSession)
    names = ["doc_id", "row", "node", "size", "fingerprints", "shingles"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                nodes, signs, sets = [], [], []
                for text in part.column(2):
                    hashes = np.unique(shingle_hashes(text.as_py(), shingle))
                    nodes.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
                    signs.append(_signs(hashes, prints))
                    sets.append(np.unique((hashes >> np.uint64(32)).astype(np.uint32)).view(np.int32))
                sizes = np.array([len(s) for s in sets], dtype=np.int32)
                starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int32)]).astype(np.int32)
                flat = np.array(signs, dtype=np.uint64).ravel().view(np.int64)
                ways = np.arange(0, len(flat) + 1, prints, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(ways), pa.array(flat)),
                        pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate([*sets, []]).astype(np.int32))),
                    ],
                    names,
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _row(), whole_text().alias("text")).mapInArrow(
        hashed,
        f"doc_id {kind}, row bigint, node bigint, size int, fingerprints array<bigint>, shingles array<int>",
    )


def _row():
    return F.xxhash64("doc_id", whole_text()).alias("row")


def bands(nodes: DataFrame, numbers: tuple[int, int]) -> DataFrame:
    """`node, group, number, half`: some bands of every node's fingerprints."""
    ship_package(nodes.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            found = bands_of(lists.flatten().to_numpy().view(np.uint64).reshape(len(lists), -1))
            found = found[:, slice(*numbers)]
            number = np.tile(np.arange(found.shape[1], dtype=np.int32) + numbers[0], len(lists))
            names = [np.repeat(batch.column(i).to_numpy(), found.shape[1]) for i in range(2)]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, names), pa.array(number), pa.array(found.ravel().view(np.int32))],
                ["node", "group", "number", "half"],
            )

    return nodes.select("node", "group", "fingerprints").mapInArrow(
        cut, "node bigint, group bigint, number int, half int"
    )


def meetings(distinct: DataFrame) -> DataFrame:
    """`number, half, company, members`: halves that nodes of different groups meet at.

    `distinct` has `number, half, n, group`: how many nodes have the half, and their group,
    missing where there are several. Halves of one number that differ in at most one bit, and
    whose nodes are of different groups, are in a company together, found in the shards of a
    vantage-point tree; a half may be in several, but each two that are so near are in one.
    Halves that meet their own group only are left out, however many others of it do not.
    """
    ship_package(distinct.sparkSession)
    rows, numbers = distinct.agg(F.count(F.lit(1)), F.count_distinct("number")).first()
    every = max(1, rows // SAMPLE_ROWS)
    # The sample only places the shards; its size is bounded for any input.
    some = distinct.where(F.pmod(F.xxhash64("number", "half"), F.lit(every)) == 0)
    sample = some.select("half").limit(2 * SAMPLE_ROWS).toArrow()["half"].to_numpy().view(np.uint32)
    sample = np.sort(sample)
    np.random.default_rng(SEED).shuffle(sample)
    leaves = min(-(-rows // max(1, numbers) // BAND_SHARD_ROWS), max(1, len(sample) // 8))
    tree = VantageTree(sample, leaves)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("half").to_numpy().view(np.uint32)
            for leaf, found, home in tree.place(values, HALF_RADIUS):
                if len(found):
                    part = batch.take(pa.array(found))
                    yield part.append_column(
                        "shard", pa.array(np.full(len(found), leaf, np.int32))
                    ).append_column("home", pa.array(np.full(len(found), home)))

    def met(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("home", "descending")])
        home = shard["home"].to_numpy()
        values = shard["half"].to_numpy().view(np.uint32)
        mixed = shard["group"].is_null().to_numpy()
        companies = Crossings(shard["group"].fill_null(0).to_numpy(), mixed)
        _link(values, values, np.arange(home.sum()), np.arange(len(values)), companies, HALF_RADIUS, HALF_RADIUS)
        kept = np.flatnonzero(companies.met)
        roots, company = np.unique(companies.find(kept), return_inverse=True)
        members = np.bincount(company, shard["n"].to_numpy()[kept], len(roots)).astype(np.int64)
        columns = shard.select(["number", "half", "shard"]).take(pa.array(kept))
        return columns.append_column("root", pa.array(values[roots[company]].view(np.int32))).append_column(
            "members", pa.array(members[company])
        )

    return (
        distinct.select("number", "half", "n", "group")
        .mapInArrow(placed, "number int, half int, n bigint, group bigint, shard int, home boolean")
        .groupBy("shard", "number")
        .applyInArrow(met, "number int, half int, shard int, root int, members bigint")
        .select("number", "half", F.xxhash64("number", "shard", "root").alias("company"), "members")
    )


def _blocks(df: DataFrame, of: str, task: Column) -> DataFrame:
    """Rows dealt out as pairs of blocks; `of` has `blocks` of them.

    Adds `run`, whose rows are to be compared, `home` with `guest`, and `task`: the
    given one where there is one block only.
    """
    pair = F.xxhash64(of, F.least("own", "other"), F.greatest("own", "other"))
    single = F.col("blocks") == 1
    return (
        df.withColumn("own", F.expr(f"pmod(xxhash64({of}, node), blocks)"))
        .withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
        .withColumns(
            {
                "run": F.when(single, F.col(of)).otherwise(pair),
                "task": F.when(single, task).otherwise(pair),
                "home": F.col("own") <= F.col("other"),
                "guest": F.col("own") >= F.col("other"),
            }
        )
        .drop("own", "other", "blocks")
    )


def _prints(rows: pa.Table) -> np.ndarray:
    lists = rows["fingerprints"].combine_chunks()
    return lists.flatten().to_numpy().view(np.uint64).reshape(len(lists), -1)


def _wave(nodes: DataFrame, numbers: tuple[int, int], near_bits: int) -> DataFrame:
    """Nodes with `group` joined where candidates of some bands connect groups."""
    halves = bands(nodes, numbers)
    distinct = materialise(
        halves.groupBy("number", "half")
        .agg(F.count(F.lit(1)).alias("n"), F.min("group").alias("low"), F.max("group").alias("high"))
        .select("number", "half", "n", F.when(F.col("low") == F.col("high"), F.col("low")).alias("group"))
    )
    open_ = meetings(distinct)
    members = materialise(
        halves.join(open_, ["number", "half"]).select("node", "group", "half", "company", "members")
    )
    tasks = -(-members.count() // TASK_ROWS) or 1
    dealt = _blocks(
        members.withColumn("blocks", F.expr(f"(members + {BLOCK_ROWS} - 1) div {BLOCK_ROWS}")),
        "company",
        F.pmod("company", F.lit(tasks)),
    )
    # A node meets others in many bands; its fingerprints go to each task once.
    met = F.collect_list(F.struct("run", "home", "guest", "half")).alias("met")
    once = dealt.groupBy("task", "node", "group").agg(met)

    def compared(rows: pa.Table) -> pa.Table:
        lists = rows["met"].combine_chunks()
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        run, home, guest, half = (
            c.to_numpy(zero_copy_only=False) for c in lists.values.flatten()
        )
        group, prints = rows["group"].to_numpy()[row], _prints(rows)
        a, b = block_links(
            run, home, guest, half.view(np.uint32), group, prints[row], HALF_RADIUS, near_bits
        )
        return pa.table({"a": a, "b": b})

    links = (
        once.join(nodes.select("node", "fingerprints"), "node")
        .select("task", "group", "met", "fingerprints")
        .groupBy("task")
        .applyInArrow(compared, "a bigint, b bigint")
    )
    joined = _with_root(nodes, "group", components(links), "joined")
    return materialise(joined.drop("group").withColumnRenamed("joined", "group"))


def like_links(
    run: np.ndarray,
    home: np.ndarray,
    guest: np.ndarray,
    node: np.ndarray,
    prints: np.ndarray,
    shingles: pa.ListArray,
    most: int,
    least: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Edges between nodes that join what the near pairs of these rows join.

    Rows of one `run` are compared, homes with guests. Those whose prints differ in at
    most `most` bits are near when they share `least` of all their shingles. At most one
    edge per node.
    """
    names, label = np.unique(node, return_inverse=True)
    groups = Groups(len(names))
    starts, parts = shingles.offsets.to_numpy(), shingles.values.to_numpy()
    order = np.argsort(run, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(run[order])) + 1):
        homes, guests = rows[home[rows]], rows[guest[rows]]
        # Shingles are numbered inside the run, so that sets are compared by a table.
        values, code = np.unique(np.concatenate([parts[starts[r] : starts[r + 1]] for r in rows]), return_inverse=True)
        sizes = starts[rows + 1] - starts[rows]
        first = dict(zip(rows.tolist(), (np.cumsum(sizes) - sizes).tolist(), strict=True))
        size = lambda r: int(starts[r + 1] - starts[r])
        table = np.zeros(len(values), dtype=bool)
        for i in range(0, len(homes), LEAF_ROWS):
            block = homes[i : i + LEAF_ROWS]
            bits = np.zeros((len(block), len(guests)), dtype=np.uint16)
            for k in range(prints.shape[1]):
                bits += np.bitwise_count(prints[block, k][:, None] ^ prints[guests, k][None, :])
            # Near ones first: what they join need not be compared again.
            for x, close in zip(block, bits, strict=True):
                others = guests[close <= most]
                others = others[np.argsort(close[close <= most], kind="stable")]
                others = others[groups.find(label[others]) != groups.find(label[[x]])]
                if not len(others):
                    continue
                mine = code[first[x] : first[x] + size(x)]
                table[mine] = True
                for y in others:
                    if groups.find(label[[x]])[0] == groups.find(label[[y]])[0]:
                        continue
                    n, m = size(x), size(y)
                    if min(n, m) < least * max(n, m):
                        continue
                    same = int(np.count_nonzero(table[code[first[y] : first[y] + m]]))
                    if same >= least * (n + m - same):
                        groups.join(label[[x]], label[[y]])
                table[mine] = False
    rows = np.arange(len(names))
    roots = groups.find(rows)
    moved = rows != roots
    return names[rows[moved]], names[roots[moved]]


def near_roots(
    docs: DataFrame, shingle: int = 5, prints: int = PRINTS, near_bits: int = NEAR_BITS, least: float = LEAST_LIKE
) -> DataFrame:
    """`doc_id, row, root`: rows with one root are connected by near pairs.

    Near are texts that share `least` of all their different shingles. One fingerprint of 64
    bits would miss most such pairs: they differ in ten of its bits. With `prints`
    independent ones a pair is a candidate when any 32-bit band differs in at most one bit, by
    vantage-point trees, and all bits together in at most `near_bits` places. Bands are the
    halves, and bytes of several halves put together. What candidates connect is a family;
    a few halves come first and join most of it, so that the other bands have few groups left
    to connect. Inside a family all pairs within `near_bits` are verified on the shingles
    themselves, in tasks of bounded size, and only near ones connect.
    """
    marked = materialise(shingle_sets(docs, shingle, prints))
    nodes = materialise(
        marked.select("node", "fingerprints", "size").where("size > 0").dropDuplicates(["node"])
    ).withColumn("group", F.col("node"))
    whole = 2 * prints * BAND_WAYS
    for numbers in itertools.pairwise((0, *FIRST_BANDS, whole)):
        nodes = _wave(nodes, numbers, near_bits)
    families = nodes.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
    blocks = F.expr(
        f"greatest((n + {BLOCK_ROWS} - 1) div {BLOCK_ROWS}, (shingles + {BLOCK_SHINGLES} - 1) div {BLOCK_SHINGLES})"
    )
    families = families.where("n > 1").select("group", blocks.alias("blocks"), "shingles")
    members = materialise(nodes.select("node", "group").join(families, "group").drop("shingles"))
    total = marked.join(members, "node", "left_semi").agg(F.sum("size")).first()[0] or 0
    tasks = -(-total // TASK_SHINGLES) or 1
    sets = marked.select("node", "fingerprints", "shingles").join(members, "node").dropDuplicates(["node"])
    dealt = _blocks(sets, "group", F.pmod("group", F.lit(tasks)))

    def verified(rows: pa.Table) -> pa.Table:
        run, home, guest, node = (rows[n].to_numpy() for n in ("run", "home", "guest", "node"))
        a, b = like_links(
            run, home, guest, node, _prints(rows), rows["shingles"].combine_chunks(), near_bits, least
        )
        return pa.table({"a": a, "b": b})

    links = (
        dealt.select("task", "run", "home", "guest", "node", "fingerprints", "shingles")
        .groupBy("task")
        .applyInArrow(verified, "a bigint, b bigint")
    )
    return _with_root(marked.select("doc_id", "row", "node"), "node", components(links), "root").drop("node")


def near_groups_by_several(docs: DataFrame, shingle: int = 5, prints: int = PRINTS) -> DataFrame:
    """`doc_id, component_id`: the smallest doc_id that near pairs lead to, see `near_roots`."""
    named = materialise(near_roots(docs, shingle, prints))
    first = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(first, "root").select("doc_id", "component_id")


def _with_root(rows: DataFrame, column: str, roots: DataFrame, name: str) -> DataFrame:
    """The rows with `name`: the root of a column's value, or the value where it has none."""
    roots = roots.select(F.col("node").alias("of"), F.col("root").alias("of_root"))
    joined = rows.join(roots, F.col(column) == F.col("of"), "left")
    return joined.withColumn(name, F.coalesce("of_root", column)).drop("of", "of_root")


def one_of_each(docs: DataFrame, shingle: int = 5, prints: int = PRINTS) -> DataFrame:
    """One document of every near group, that with the smallest doc_id, with all columns.

    Of rows with one doc_id and different texts, a hash of the text decides; rows without
    doc_id come last. Of rows equal in both, any one stays. Texts without words are one group.
    """
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    kept = near_roots(docs, shingle, prints).groupBy("root").agg(F.min_by("row", order).alias("_near_row"))
    rows = docs.withColumn("_near_row", F.xxhash64("doc_id", whole_text()))
    return (
        rows.join(kept.select("_near_row"), "_near_row", "left_semi")
        .dropDuplicates(["_near_row"])
        .drop("_near_row")
    )
