"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Inner product search becomes search by direction when each vector gets one more
value that brings all vectors to the same length. Every inner node of a tree
splits space by the plane between two sample vectors. A query walks all trees
through one priority queue, nearest cells first, and ends after a number of
leaves that the sample shows to be enough. What shares a leaf with the query is
compared exactly, block by block; what scores below the k-th best of a few seed
vectors cannot be an answer and goes no further.

Equal vectors are one entry of the index with their smallest ids, as many as any
answer can use, so copies neither fill leaves nor multiply comparisons.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.session import materialise, ship_package

TREES = 4
#: Vectors the forest is built from at most, and values they may have together.
SAMPLE_ROWS, SAMPLE_VALUES = 16_384, 4_000_000
LEAF_ROWS, MOST_LEAVES = 384, 128
#: Entries of one block of a leaf; larger leaves are dealt over several blocks.
BLOCK_ROWS = 16_384
#: Share of true neighbours in the sample that the walk must reach, and queries measured.
REACHED, MEASURED = 0.96, 128
#: Sample vectors that every query is compared with first.
SEEDS = 1024
#: Entries kept per query and block beyond those asked for: equal scores may round apart.
SPARE = 4


class Forest:
    """Planes of all trees in flat arrays; children below zero are leaves -1, -2, ..."""

    def __init__(self, sample: np.ndarray, leaves: int, trees: int = TREES):
        self.random = np.random.default_rng(7)
        self.sample = sample
        self.normals: list[np.ndarray] = []
        self.offsets: list[float] = []
        self.children: list[tuple[int, int]] = []
        self.leaves = 0
        depth = int(np.floor(np.log2(max(1, leaves))))
        self.roots = [self._grow(np.arange(len(sample)), depth) for _ in range(trees)]
        self.planes = np.array(self.normals).reshape(len(self.normals), sample.shape[1])
        self.shifts = np.array(self.offsets)
        del self.sample, self.normals, self.offsets, self.random

    def _grow(self, rows: np.ndarray, depth: int) -> int:
        if depth and len(rows) >= 8:
            a, b = self.random.choice(rows, 2, replace=False)
            normal = self.sample[a] - self.sample[b]
            length = np.linalg.norm(normal)
            if length > 0:
                normal = normal / length
                places = self.sample[rows] @ normal
                offset = float(np.median(places))
                left = places <= offset
                if left.any() and not left.all():
                    node = len(self.normals)
                    self.normals.append(normal)
                    self.offsets.append(offset)
                    self.children.append((0, 0))
                    pair = (self._grow(rows[left], depth - 1), self._grow(rows[~left], depth - 1))
                    self.children[node] = pair
                    return node
        self.leaves += 1
        return -self.leaves

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree, one row per tree."""
        found = np.empty((len(self.roots), len(vectors)), dtype=np.int64)
        for tree, root in enumerate(self.roots):
            stack = [(root, np.arange(len(vectors)))]
            while stack:
                node, rows = stack.pop()
                if node < 0:
                    found[tree, rows] = -node - 1
                elif len(rows):
                    left = vectors[rows] @ self.planes[node] <= self.shifts[node]
                    stack.append((self.children[node][0], rows[left]))
                    stack.append((self.children[node][1], rows[~left]))
        return found

    def walk(self, margins: np.ndarray) -> Iterator[int]:
        """Leaves of all trees, nearest first; `margins` are the query's sides of all planes.

        The distance to a cell is taken from the planes crossed on the way to it.
        """
        queue = [(0.0, node) for node in self.roots]
        heapq.heapify(queue)
        while queue:
            distance, node = heapq.heappop(queue)
            while node >= 0:
                margin = margins[node]
                left, right = self.children[node]
                near, far = (left, right) if margin <= 0 else (right, left)
                heapq.heappush(queue, (distance + margin * margin, far))
                node = near
            yield -node - 1

    def margins(self, queries: np.ndarray) -> np.ndarray:
        return queries @ self.planes.T - self.shifts

    def enough(self, vectors: np.ndarray, queries: np.ndarray, k: int) -> int:
        """Leaves to visit so that REACHED of the k nearest sample vectors are met."""
        if not len(self.planes):
            return self.leaves
        cells = self.cells(vectors)
        best = np.argsort(-(queries @ vectors.T), axis=1)[:, 1 : k + 1]
        needed = []
        for margins, near in zip(self.margins(queries), best, strict=True):
            order = np.empty(self.leaves, dtype=np.int64)
            for place, leaf in enumerate(self.walk(margins)):
                order[leaf] = place
            needed.append(order[cells[:, near]].min(axis=0))
        return int(np.quantile(np.concatenate(needed), REACHED)) + 1


def usable(vector: str) -> Column:
    """Vectors with values that are all finite, and not all zero."""
    infinite = F.lit(float("inf"))
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)
    )
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def nearest(
    vectors: DataFrame, k: int = 20, is_query: Column | None = None, trees: int = TREES
) -> DataFrame:
    """`query_id, rank, vec_id, score`: the k nearest found of each query, nearest first.

    `vectors` has `vec_id` and `embedding`; `is_query` selects the queries, by
    default each twentieth id. Nearness is the inner product in double
    precision, ties go to the smaller vec_id. Null and zero vectors and those
    with null or non-finite values take no part, nor do rows without vec_id or
    vectors of another length than most have. Rows that repeat id and vector
    count once; a query never finds rows with its own id. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    query = F.col("vec_id") % 20 == 0 if is_query is None else is_query
    clean = vectors.where(usable("embedding") & F.col("vec_id").isNotNull()).select(
        "vec_id", F.col("embedding").alias("v"), query.alias("asks")
    )
    width = clean.agg(F.mode(F.size("v"), True)).first()[0]
    if width is None:
        return _ranked(spark.createDataFrame([], "asker bigint, ids array<bigint>, score double"), k)
    # Two hashes with different seeds stand for the vector; entries carry the vector itself.
    key = F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"))
    clean = clean.where(F.size("v") == width).withColumn("key", key).distinct()
    smallest = Window.partitionBy("key").orderBy("vec_id")
    entries = materialise(
        clean.groupBy("key", "v", "vec_id")
        .agg(F.max("asks").alias("asks"))
        .withColumn("place", F.row_number().over(smallest))
        .where(F.col("place") <= k + 1)
        .groupBy("key")
        .agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .join(
            clean.where("asks").select(F.col("key").alias("asked")).distinct(),
            F.col("key") == F.col("asked"),
            "left",
        )
        .select("key", "v", "ids", F.col("asked").isNotNull().alias("asks"))
    )
    n, longest = entries.agg(
        F.count(F.lit(1)),
        F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)),
    ).first()
    rows = max(8, min(SAMPLE_ROWS, SAMPLE_VALUES // width))
    every = max(1, n // rows)
    drawn = (
        entries.where(F.pmod(F.col("key.a"), F.lit(every)) == 0)
        .select("v", F.col("ids").cast("array<bigint>").alias("ids"))
        .limit(2 * rows)
        .toArrow()
    )
    # Entries with smaller ids first, as equal scores are ordered.
    drawn = drawn.take(pa.array(np.argsort([i[0] for i in drawn["ids"].to_pylist()])))
    sample, sample_ids = _matrix(drawn["v"], width), drawn["ids"].combine_chunks()

    def lifted(values: np.ndarray) -> np.ndarray:
        """One more value, so that all vectors are equally long."""
        rest = np.sqrt(np.maximum(0.0, longest - (values**2).sum(axis=1)))
        return np.concatenate([values, rest[:, None]], axis=1)

    def asked(values: np.ndarray) -> np.ndarray:
        scale = np.sqrt(longest) / np.linalg.norm(values, axis=1)
        return np.concatenate([values * scale[:, None], np.zeros((len(values), 1))], axis=1)

    points = lifted(sample)
    forest = Forest(points, min(MOST_LEAVES, max(1, n // LEAF_ROWS)), trees)
    chosen = np.arange(0, len(sample), max(1, len(sample) // SEEDS))
    seeds, seed_ids = sample[chosen], sample_ids.take(pa.array(chosen))
    known = seeds.astype(np.float32)
    measured = asked(sample[:: max(1, len(sample) // MEASURED)])
    probes = forest.enough(points, measured, k)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = forest.cells(lifted(_matrix(batch.column(0), width)))
                cell, rows = np.unique(cells, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), pa.array(rows)], ["cell", "n"]
                )

    # One row per leaf, of which the forest has a bounded number.
    sizes = np.zeros(forest.leaves, dtype=np.int64)
    leaf_sizes = entries.select("v").mapInArrow(counted, "cell int, n bigint")
    for row in leaf_sizes.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        sizes[row["cell"]] = row["n"]
    blocks = np.maximum(1, -(-sizes // BLOCK_ROWS))

    def floors(values: np.ndarray) -> np.ndarray:
        """Scores that the k nearest reach at least: one sample vector may be the query's own."""
        if len(known) <= k:
            return np.full(len(values), -np.inf)
        scores = values.astype(np.float32) @ known.T
        best = np.partition(scores, -k - 1, axis=1)[:, -k - 1].astype(np.float64)
        return best - _slack(values, known)

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with its nearest seeds, which may be all that it finds."""
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                values = _matrix(part.column(1), width)
                q, e, exact = _nearest_rows(values, seeds, known, k + 1 + SPARE)
                yield _listed(part.column(0), seed_ids, q, e, exact)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each entry in a block of its leaf in every tree; each query in all blocks of its leaves."""
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                values = _matrix(part.column("v"), width)
                keys = part.column("a").to_numpy()
                cells = forest.cells(lifted(values)).ravel()
                rows = np.tile(np.arange(len(values)), len(forest.roots))
                floor = np.full(len(values), -np.inf)
                yield _dealt(part, rows, cells, (keys[rows] % blocks[cells]), floor, False)
                asks = np.nonzero(part.column("asks").to_numpy(zero_copy_only=False))[0]
                if len(asks):
                    rows, cells, parts = [], [], []
                    floor[asks] = floors(values[asks])
                    for row, margins in zip(asks, forest.margins(asked(values[asks])), strict=True):
                        for _, leaf in zip(range(probes), forest.walk(margins), strict=False):
                            for block in range(blocks[leaf]):
                                rows.append(row)
                                cells.append(leaf)
                                parts.append(block)
                    for i in range(0, len(rows), 20_000):
                        cut = slice(i, i + 20_000)
                        where = (np.array(x[cut]) for x in (rows, cells, parts))
                        yield _dealt(part, *where, floor, True)

    def compared(block: pa.Table) -> pa.Table:
        """The best entries of a block for each of its queries."""
        asks = block["asks"].to_numpy()
        entries_, queries = block.filter(pa.array(~asks)), block.filter(pa.array(asks))
        if not len(entries_) or not len(queries):
            return _FOUND.empty_table()
        values, wanted = _matrix(entries_["v"], width), _matrix(queries["v"], width)
        least = np.array([i[0] for i in entries_["ids"].to_pylist()])
        order = np.argsort(least, kind="stable")  # equal scores: smaller ids first
        values = values[order]
        floor, quick = queries["floor"].to_numpy(), values.astype(np.float32)
        found = [
            _nearest_rows(wanted[i : i + 64], values, quick, k + 1 + SPARE, floor[i : i + 64], i)
            for i in range(0, len(wanted), 64)
        ]
        q, e, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        e = order[e]
        keys = queries["key"].combine_chunks()
        ids = entries_["ids"].combine_chunks()
        return pa.Table.from_batches([_listed(keys, ids, q, e, scores)])

    keyed = "struct<a: bigint, b: bigint>"
    vector = clean.schema["v"].dataType.simpleString()
    ids = f"array<{vectors.schema['vec_id'].dataType.simpleString()}>"
    from_spark = entries.select("key", F.col("key.a").alias("a"), "v", "ids", "asks")
    dealt = from_spark.mapInArrow(
        placed,
        f"cell int, block int, asks boolean, floor double, key {keyed}, v {vector}, ids {ids}",
    )
    schema = f"key {keyed}, near array<struct<score: double, ids: array<bigint>>>"
    found = (
        dealt.groupBy("cell", "block")
        .applyInArrow(compared, schema)
        .unionByName(entries.where("asks").select("key", "v").mapInArrow(seeded, schema))
    )
    # What the blocks of a query found, without what several trees found; best first.
    lists = found.groupBy("key").agg(F.flatten(F.collect_list("near")).alias("near"))
    ranked = F.array_sort(
        F.transform("near", lambda x: F.struct((-x["score"]).alias("back"), x["ids"].alias("ids")))
    )
    new = F.filter("ranked", lambda x, i: (i == 0) | (x != F.get("ranked", i - 1)))
    lists = lists.select("key", ranked.alias("ranked")).select("key", F.slice(new, 1, k + 1).alias("best"))
    best = lists.select("key", F.explode("best").alias("x")).select(
        "key", F.col("x.ids").alias("ids"), (-F.col("x.back")).alias("score")
    )
    askers = clean.where("asks").select(F.col("key").alias("asked"), F.col("vec_id").alias("asker"))
    return _ranked(
        best.join(askers.distinct(), F.col("key") == F.col("asked")).select("asker", "ids", "score"), k
    )


_NEAR = pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int64()))])
_FOUND = pa.schema(
    [
        ("key", pa.struct([("a", pa.int64()), ("b", pa.int64())])),
        ("near", pa.list_(_NEAR)),
    ]
)


def _listed(keys: pa.Array, ids: pa.Array, q: np.ndarray, e: np.ndarray, scores: np.ndarray):
    """One row per query with all it found; `q` ascends."""
    queries, first = np.unique(q, return_index=True)
    near = pa.StructArray.from_arrays(
        [pa.array(scores), ids.take(pa.array(e)).cast(_NEAR["ids"].type)], fields=list(_NEAR)
    )
    offsets = pa.array(np.append(first, len(q)).astype(np.int32))
    lists = pa.ListArray.from_arrays(offsets, near)
    return pa.RecordBatch.from_arrays(
        [keys.take(pa.array(queries)).cast(_FOUND.field("key").type), lists.cast(_FOUND.field("near").type)], schema=_FOUND
    )


def _nearest_rows(
    wanted: np.ndarray,
    values: np.ndarray,
    quick: np.ndarray,
    most: int,
    floor: np.ndarray | None = None,
    first: int = 0,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, entry, score) of the best entries of each query, those below its floor left out.

    Single precision (`quick`) chooses; what is near the last one chosen is
    compared exactly, and may be ahead of it. Of equal scores the first entries stay.
    """
    most = min(most, len(values))
    rough = wanted.astype(np.float32) @ quick.T
    last = np.partition(rough, len(values) - most, axis=1)[:, len(values) - most]
    least = last - _slack(wanted, quick)
    if floor is not None:
        least = np.maximum(least, floor)
    q, e = np.nonzero(rough >= least[:, None])
    step = 65_536
    parts = [
        (wanted[q[j : j + step]] * values[e[j : j + step]]).sum(axis=1)
        for j in range(0, len(q) + 1, step)
    ]
    exact = np.concatenate(parts)
    rank = np.lexsort((e, -exact, q))
    q, e, exact = q[rank], e[rank], exact[rank]
    keep = np.arange(len(q)) - np.searchsorted(q, np.arange(len(wanted)))[q] < most
    return q[keep] + first, e[keep], exact[keep]


def _slack(values: np.ndarray, others: np.ndarray) -> np.ndarray:
    """More than products of these rows can be off in single precision."""
    longest = float(np.sqrt((others.astype(np.float64) ** 2).sum(axis=1).max()))
    return 1e-7 * (values.shape[1] + 16) * np.linalg.norm(values, axis=1) * longest


def _dealt(
    part: pa.RecordBatch,
    rows: np.ndarray,
    cells: np.ndarray,
    blocks: np.ndarray,
    floor: np.ndarray,
    asks: bool,
) -> pa.RecordBatch:
    take = pa.array(rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(cells.astype(np.int32)),
            pa.array(blocks.astype(np.int32)),
            pa.array(np.full(len(rows), asks)),
            pa.array(floor[rows]),
            part.column("key").take(take),
            part.column("v").take(take),
            part.column("ids").take(take),
        ],
        ["cell", "block", "asks", "floor", "key", "v", "ids"],
    )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.select(F.col("asker").alias("query_id"), F.explode("ids").alias("vec_id"), "score")
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
