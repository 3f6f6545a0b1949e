"""A quality classifier: histogram gradient-boosted trees over statistics of a text.

The trees are fitted on the driver from a bounded sample of labelled rows. They
are complete binary trees held in flat arrays, so that a batch of documents is
scored by stepping all its rows down one tree at a time in numpy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.common import whole_text
from eventloom.session import ship_package

#: Labelled rows the trees are fitted on at most, chosen by a hash of their id.
SAMPLE_LABELS = 20_000
ROUNDS, DEPTH, BINS, RATE = 80, 5, 64, 0.15
RIDGE, LEAST_WEIGHT = 1.0, 2.0
THRESHOLD = 0.3

_MARKS = b"|%*$#&!<>{}[]\\=_@~^;:?.,'\"-/()"
_CLASSES = np.zeros((256, 6), dtype=np.int64)
_CLASSES[ord("a") : ord("z") + 1, 0] = 1
_CLASSES[ord("A") : ord("Z") + 1, 1] = 1
_CLASSES[ord("0") : ord("9") + 1, 2] = 1
_CLASSES[[32, 9, 11, 12, 13], 3] = 1
_CLASSES[10, 4] = 1
_CLASSES[128:, 5] = 1
STATISTICS = 6 + len(_MARKS) + 15


def statistics_of(text: str) -> list[float]:
    """Shares and lengths that describe a text, whatever its language; zeros for an empty one."""
    data = text.encode()
    if not data:
        return [0.0] * STATISTICS
    size = len(data)
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    present = counts[counts > 0] / size
    words = data.split()
    lowered = data.lower().split()
    n = len(words)
    often = Counter(lowered)
    pairs = len(set(zip(lowered, lowered[1:], strict=False)))
    lines = [line for line in data.split(b"\n") if line.strip()]
    line_counts = Counter(lines)
    repeated = sum(len(k) * (c - 1) for k, c in line_counts.items())
    top = often.most_common(8)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n) if n else np.zeros(1)
    upper = sum(map(bytes.isupper, words))
    title = sum(map(bytes.istitle, words))
    return [
        *(counts @ _CLASSES / size),
        *(counts[list(_MARKS)] / size),
        np.log1p(size),
        float(-(present * np.log2(present)).sum()),
        np.log1p(n),
        float(lengths.mean()),
        float(lengths.std()),
        float(lengths.max()),
        len(often) / max(1, n),
        pairs / max(1, n - 1),
        top[0][1] / n if n else 0.0,
        sum(c for _, c in top) / max(1, n),
        upper / max(1, n),
        title / max(1, n),
        len(lines) / max(1, n),
        len(line_counts) / max(1, len(lines)),
        repeated / size,
    ]


@dataclass
class Trees:
    """`feature` and `edge` by tree and inner node, `leaf` by tree and leaf."""

    base: float
    feature: np.ndarray
    edge: np.ndarray
    leaf: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        total = np.full(len(rows), self.base)
        each = np.arange(len(rows))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for feature, edge, leaf in zip(self.feature, self.edge, self.leaf, strict=True):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (rows[each, feature[node]] > edge[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(rows: np.ndarray, labels: np.ndarray) -> Trees:
    """Boosted trees for labels 0 and 1; a constant where only one label, or none, is seen."""
    empty = np.zeros((0, 2**DEPTH - 1))
    positive = float(labels.sum())
    base = np.log((positive + 0.5) / (len(labels) - positive + 0.5))
    if not 0 < positive < len(labels):
        return Trees(base, empty.astype(np.int64), empty, empty)
    n, width = rows.shape
    quantiles = np.quantile(rows, np.linspace(0, 1, BINS + 1)[1:-1], axis=0)
    edges = [np.unique(quantiles[:, f]) for f in range(width)]
    bins = np.stack(
        [np.searchsorted(edges[f], rows[:, f], side="left") for f in range(width)], axis=1
    )
    slots = bins + np.arange(width) * BINS
    margin = np.full(n, base)
    inner = 2**DEPTH - 1
    features, thresholds, leaves = [], [], []
    for _ in range(ROUNDS):
        chance = 1 / (1 + np.exp(-margin))
        gradient, weight = chance - labels, chance * (1 - chance)
        feature = np.zeros(inner, dtype=np.int64)
        edge = np.full(inner, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(DEPTH):
            first, width_nodes = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (width * BINS) + slots).ravel()
            shape = (width_nodes, width, BINS)
            size = width_nodes * width * BINS
            g = np.bincount(cell, np.repeat(gradient, width), size).reshape(shape).cumsum(axis=2)
            h = np.bincount(cell, np.repeat(weight, width), size).reshape(shape).cumsum(axis=2)
            all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
            gain = (
                g**2 / (h + RIDGE)
                + (all_g - g) ** 2 / (all_h - h + RIDGE)
                - all_g**2 / (all_h + RIDGE)
            )
            gain[(h < LEAST_WEIGHT) | (all_h - h < LEAST_WEIGHT)] = 0
            best = gain.reshape(width_nodes, -1).argmax(axis=1)
            for k in range(width_nodes):
                f, b = divmod(int(best[k]), BINS)
                # A node without a gain sends all its rows to the left.
                if gain[k, f, b] > 1e-9 and b < len(edges[f]):
                    feature[first + k], edge[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (rows[np.arange(n), feature[node]] > edge[node])
        leaf_g = np.bincount(node - inner, gradient, 2**DEPTH)
        leaf_h = np.bincount(node - inner, weight, 2**DEPTH)
        leaf = -RATE * leaf_g / (leaf_h + RIDGE)
        margin += leaf[node - inner]
        features.append(feature)
        thresholds.append(edge)
        leaves.append(leaf)
    return Trees(base, np.array(features), np.array(thresholds), np.array(leaves))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from; a missing id is one of them."""
    fold = F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5))
    return F.coalesce(fold == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_LABELS) -> Trees:
    """Fit on at most `sample` labelled rows outside the held-out fold.

    Of several labels or texts with one doc_id the smallest counts (texts by their
    statistics), so reruns learn the same.
    """
    ship_package(docs.sparkSession)
    chosen = (
        labels.where(~held_out() & F.col("quality").isin(0, 1))
        .groupBy(F.col("doc_id").alias("labelled"))
        .agg(F.min("quality").alias("label"))
        .orderBy(F.xxhash64("labelled"), "labelled")
        .limit(sample)
    )

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics_of(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))],
                ["labelled", "label", "row"],
            )

    kind = labels.schema["doc_id"].dataType.simpleString()
    found = (
        docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["labelled"])
        .select("labelled", F.col("label").cast("int"), whole_text().alias("text"))
        .mapInArrow(measured, f"labelled {kind}, label int, row array<double>")
        .groupBy("labelled")
        .agg(F.min(F.struct("label", "row")).alias("least"))
        .select("labelled", "least.label", "least.row")
        .toArrow()
    )
    rows = np.array(found["row"].to_pylist(), dtype=float).reshape(-1, STATISTICS)
    order = np.argsort(found["labelled"].to_numpy(), kind="stable")
    return fit(rows[order], found["label"].to_numpy()[order].astype(float))


def with_score(docs: DataFrame, trees: Trees, name: str = "score") -> DataFrame:
    """The rows with their score; texts that are missing count as empty."""
    ship_package(docs.sparkSession)
    text = docs.columns.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics_of(t.as_py() or "") for t in batch.column(text)]
            score = trees.score(np.array(rows, dtype=float).reshape(-1, STATISTICS))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score)], [*batch.schema.names, name]
            )

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(scored, schema)


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_LABELS) -> DataFrame:
    """`doc_id, held_out, score, predicted` for every row of `docs`.

    Scores depend on the text alone. Labels other than 0 and 1 are left out;
    without usable labels every score is 0.5. A missing doc_id is held out.
    Repeated rows are scored each; other columns are not read.
    """
    trees = learn(docs, labels, sample)
    return with_score(docs.select("doc_id", "text"), trees).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def good_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_LABELS) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    mark = "_" + "_".join(docs.columns)  # differs from every column
    scored = with_score(docs, learn(docs, labels, sample), mark)
    return scored.where(F.col(mark) >= THRESHOLD).select(*docs.columns)
