"""Fixed-expiry anchors: the state behind sessions and duplicate removal.

The first event of a key sets its anchor. The anchor holds for `ttl` and is
never renewed; the first event at or after its end sets the next one. Each
anchor depends on the one before, so no window expression gives the answer.

Time is cut into blocks of exactly `ttl`. Two facts carry the plan:

* A block of a key holds at most one anchor, and an event in block b belongs to
  an anchor in block b or b - 1. The answer is therefore one small row per
  (key, block), joined back to the events.
* A gap of `ttl` or more always ends an anchor, and it can be seen from the
  first and last event of neighbouring blocks alone. Such gaps cut a key into
  islands that do not depend on each other.

Islands are solved in three ways:

* shorter than `ttl`: the first event is the only anchor, nothing to read again;
* a bounded number of instants: one fold over a sorted array;
* anything larger (one key may hold a third of all rows): blocks are combined
  in a tree. A block is a step function from "when the running anchor ends" to
  "the anchor left behind"; neighbouring functions are composed level by level,
  then start values are handed back down. A task sees the distinct instants of
  FAN_IN blocks at most, however long the island is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions import clock
from eventloom.session import materialise, ship_package

MICROS = 1_000_000

# Instants of one island folded as an array; larger islands use the tree.
FOLD_LIMIT = 4096
# Children composed at once. There are as many levels as an island needs for
# its root to have no more children than that.
FAN_IN = 16

BEFORE_ALL = -(2**62)


def anchor_table(
    instants: DataFrame,
    keys: Sequence[str],
    ttl_seconds: int,
    fold_limit: int = FOLD_LIMIT,
    fan_in: int = FAN_IN,
    levels: int | None = None,
) -> DataFrame:
    """Anchors per (keys, block).

    `instants` holds the key columns (not NULL), `us`, epoch microseconds, and
    optionally `tie`, which orders events of one key at the same instant.
    The result adds `block`, `own_us` (the anchor set in this block, if any),
    `carry_us` (the anchor of the previous block that may reach into it) and
    `own_tie`, the tie of the event that set `own_us`.
    """
    ttl = ttl_seconds * MICROS
    keys = list(keys)
    placed = instants.withColumn("block", clock.slot(F.col("us"), ttl))
    # Read several times below, and the choice of plan depends on it. Writing it
    # once costs less than the two shuffles that make it.
    blocks = materialise(_islands(placed, keys, ttl))

    first = F.col("block") == F.col("first_block")
    solved = blocks.where(F.col("is_short")).select(
        *keys,
        "block",
        F.when(first, F.col("island_lo")).alias("own_us"),
        F.when(first, F.col("tie")).alias("own_tie"),
        F.when(~first, F.col("island_lo")).alias("carry_us"),
    )
    longer = blocks.where(~F.col("is_short"))
    largest = longer.agg(F.max("island_n")).first()[0]
    if largest is None:
        return solved

    heavy = F.col("island_n") > fold_limit
    found = _folded(placed, longer.where(~heavy), keys, ttl)
    if largest > fold_limit:
        found = found.unionByName(_treed(placed, longer.where(heavy), keys, ttl, fan_in, levels))
    # Each anchor reports to its own block and to the next one.
    reports = (
        found.withColumn("home", clock.slot(F.col("anchor_us"), ttl))
        .select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("step"))
        .groupBy(*keys, (F.col("home") + F.col("step")).alias("block"))
        .agg(
            F.max(F.when(F.col("step") == 0, F.col("anchor_us"))).alias("own_us"),
            F.max(F.when(F.col("step") == 1, F.col("anchor_us"))).alias("carry_us"),
        )
    )
    if "tie" in instants.columns:
        firsts = (
            _instants_of(placed, longer, keys)
            .groupBy(*keys, "block", F.col("us").alias("own_us"))
            .agg(F.min("tie").alias("own_tie"))
        )
        reports = reports.join(firsts, [*keys, "block", "own_us"], "left")
    else:
        reports = reports.withColumn("own_tie", F.lit(None).cast("bigint"))
    # A report beyond the end of an island meets no event there: the next
    # island, if it starts in that block, brings a row of its own.
    known = longer.select(*keys, "block")
    return solved.unionByName(reports.join(known, [*keys, "block"], "left_semi"))


# Events of a key that are solved as one array in a single shuffle.
LIGHT_EVENTS = 256


def attach_anchors(
    events: DataFrame,
    keys: Sequence[str],
    ts_col: str,
    ttl_seconds: int,
    tie_col: str | None = None,
    light_events: int = LIGHT_EVENTS,
    **options: int,
) -> DataFrame:
    """Add `anchor_us` to every event; NULL where a key column or the time is NULL.

    `ts_col` is a timestamp, or a BIGINT of epoch microseconds.
    With `tie_col`, which orders the events of a key at one instant,
    `sets_anchor` marks the one event that set each anchor.

    Events are counted per key, before the shuffle. Keys with few events, as
    nearly all are, are solved as arrays in one shuffle; only the others take
    the way that splits keys of any size.
    """
    keys = list(keys)
    given_us = dict(events.dtypes)[ts_col] == "bigint"
    us = F.col(ts_col) if given_us else clock.micros(F.col(ts_col))
    own = events.columns
    timed = events.withColumn("_us", us)
    known = F.col("_us").isNotNull()
    for name in keys:
        known = known & F.col(name).isNotNull()
    usable = timed.where(known)
    heavy = materialise(
        usable.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > light_events)
        .select(*keys)
    )
    result = [*own, "anchor_us", *(["sets_anchor"] if tie_col else [])]
    nothing = timed.where(~F.coalesce(known, F.lit(False))).withColumns(
        {"anchor_us": F.lit(None).cast("bigint"), "sets_anchor": F.lit(False)}
    )
    if heavy.isEmpty():
        solved = _light(usable, keys, own, ttl_seconds * MICROS, tie_col)
        return solved.select(*result).unionByName(nothing.select(*result))
    light = _light(
        usable.join(heavy, keys, "left_anti"), keys, own, ttl_seconds * MICROS, tie_col
    )
    # Rows get a number of their own, which settles ties that `tie_col` leaves.
    large = materialise(
        usable.join(heavy, keys, "left_semi").withColumn("_row", F.monotonically_increasing_id())
    )
    tie = F.struct(F.col(tie_col), F.col("_row")) if tie_col else None
    found = _heavy(large, keys, ttl_seconds, tie, **options)
    return (
        light.select(*result)
        .unionByName(found.select(*result))
        .unionByName(nothing.select(*result))
    )


def _light(
    events: DataFrame, keys: list[str], own: list[str], ttl: int, tie_col: str | None
) -> DataFrame:
    """Keys with few events: one sorted array each, one greedy pass, and back to rows."""
    rows = F.collect_list(F.struct(*[F.col(f"`{c}`") for c in own], "_us"))
    grouped = events.groupBy(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)]).agg(
        rows.alias("_rows")
    )
    order = F.array_sort(
        F.transform(
            "_rows",
            lambda r, i: F.struct(
                r["_us"].alias("us"), *([r[tie_col].alias("tie")] if tie_col else []), i.alias("i")
            ),
        )
    )
    alone = F.size("_rows") == 1
    anchors = F.when(alone, F.array(F.get("_rows", F.lit(0))["_us"])).otherwise(
        _greedy(F.transform("_order", lambda o: o["us"]), ttl)
    )
    # The first of the order at an anchor's instant has set it.
    setters = F.when(alone, F.array(F.lit(0))).otherwise(
        F.transform(
            "_anchors",
            lambda a: F.filter("_order", lambda o: o["us"] == a)[0]["i"],
        )
    )
    return (
        grouped.withColumn("_order", F.when(~alone, order))
        .withColumn("_anchors", anchors)
        .withColumn("_setters", setters)
        .select("_anchors", "_setters", F.posexplode("_rows").alias("_i", "_r"))
        .select(
            *[F.col(f"_r.`{c}`").alias(c) for c in own],
            F.array_max(F.filter("_anchors", lambda a: a <= F.col("_r._us"))).alias("anchor_us"),
            F.array_contains("_setters", F.col("_i")).alias("sets_anchor"),
        )
    )


def _heavy(
    events: DataFrame, keys: list[str], ttl_seconds: int, tie: Column | None, **options: int
) -> DataFrame:
    ties = [tie.alias("tie")] if tie is not None else []
    anchors = anchor_table(
        events.select(*keys, F.col("_us").alias("us"), *ties), keys, ttl_seconds, **options
    ).select(
        *keys,
        F.col("block").alias("_block"),
        F.struct("own_us", "carry_us", "own_tie").alias("_found"),
    )
    joined = events.withColumn("_block", clock.slot(F.col("_us"), ttl_seconds * MICROS)).join(
        anchors, [*keys, "_block"], "left"
    )
    own = F.col("_found.own_us")
    if tie is not None:
        sets = (F.col("_us") == own) & (tie == F.col("_found.own_tie"))
        joined = joined.withColumn("sets_anchor", F.coalesce(sets, F.lit(False)))
    holding = F.when(own <= F.col("_us"), own).otherwise(F.col("_found.carry_us"))
    return joined.withColumn("anchor_us", holding)


def _islands(placed: DataFrame, keys: list[str], ttl: int) -> DataFrame:
    """One row per (keys, block) with the extent of the island it lies in.

    The windows run over blocks, not events: a key has at most one row per
    `ttl` of recorded time.
    """
    if "tie" in placed.columns:
        first = F.min(F.struct("us", "tie"))
        lo, tie = first["us"], first["tie"]
    else:
        lo, tie = F.min("us"), F.lit(None).cast("bigint")
    blocks = placed.groupBy(*keys, "block").agg(
        lo.alias("lo"), tie.alias("tie"), F.max("us").alias("hi"), F.count("*").alias("n")
    )
    in_time = Window.partitionBy(*keys).orderBy("block")
    gap = F.col("lo") - F.lag("hi").over(in_time)
    numbered = blocks.withColumn(
        "starts", F.when(gap.isNull() | (gap >= ttl), F.lit(1)).otherwise(F.lit(0))
    ).withColumn("island", F.sum("starts").over(in_time))
    whole = Window.partitionBy(*keys, "island")
    island_lo, island_hi = F.min("lo").over(whole), F.max("hi").over(whole)
    return numbered.select(
        *keys,
        "block",
        "island",
        "tie",
        island_lo.alias("island_lo"),
        (island_hi - island_lo < ttl).alias("is_short"),
        F.sum("n").over(whole).alias("island_n"),
        F.min("block").over(whole).alias("first_block"),
    )


def _instants_of(placed: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """The instants inside the given blocks."""
    wanted = blocks.select(*keys, "block", "island", "first_block")
    return placed.join(wanted, [*keys, "block"])


def _folded(placed: DataFrame, blocks: DataFrame, keys: list[str], ttl: int) -> DataFrame:
    """Greedy pass over the sorted instants of an island of bounded size."""
    islands = (
        _instants_of(placed, blocks, keys)
        .groupBy(*keys, "island")
        .agg(F.sort_array(F.collect_set("us")).alias("instants"))
    )
    anchors = _greedy(F.col("instants"), ttl)
    return islands.select(*keys, F.explode(anchors).alias("anchor_us"))


def _greedy(instants: Column, ttl: int) -> Column:
    """Anchors of a sorted array of instants."""
    step = F.lit(ttl).cast("bigint")
    start = F.struct(
        F.lit(BEFORE_ALL).cast("bigint").alias("last"),
        F.array().cast("array<bigint>").alias("found"),
    )

    def take(state: Column, us: Column) -> Column:
        moved = F.struct(us.alias("last"), F.array_append(state["found"], us).alias("found"))
        return F.when(us >= state["last"] + step, moved).otherwise(state)

    return F.aggregate(instants, start, take, lambda state: state["found"])


# --- islands of any size -----------------------------------------------------
#
# A node covers neighbouring blocks of an island and is stored as rows (x, y):
# an anchor that ends in (previous x, x] leaves y as the last anchor set inside
# the node. An anchor that ends after the largest x passes through unchanged.


def _treed(
    placed: DataFrame,
    blocks: DataFrame,
    keys: list[str],
    ttl: int,
    fan_in: int,
    levels: int | None,
) -> DataFrame:
    ship_package(placed.sparkSession)
    group = [*keys, "island"]
    instants = _instants_of(placed, blocks, keys).select(
        *group, (F.col("block") - F.col("first_block")).alias("node"), F.col("us").alias("x")
    )
    leaves = instants.distinct().withColumn("y", F.col("x"))
    # Every level is read by the one above and again on the way down; the
    # tables shrink by the fan-in from level to level.
    tree = [materialise(leaves)]
    if levels is None:
        span, levels = tree[0].agg(F.max("node")).first()[0] + 1, 1
        while fan_in**levels < span:
            levels += 1
    for _ in range(levels - 1):
        tree.append(materialise(_composed(tree[-1], group, ttl, fan_in)))

    roots = tree[-1].select(*group).distinct()
    entries = roots.select(
        *group, F.lit(0).cast("bigint").alias("parent"), F.lit(BEFORE_ALL).alias("ends")
    )
    for level in range(levels - 1, 0, -1):
        top = level == levels - 1
        entries = _handed_down(tree[level], entries, group, ttl, fan_in, top)
    if levels == 1:
        return _anchors_of(tree[0], entries, group, ttl, None)
    return _anchors_of(tree[0], entries, group, ttl, fan_in)


def _with_parent(nodes: DataFrame, fan_in: int | None) -> DataFrame:
    parent = F.lit(0).cast("bigint") if fan_in is None else clock.slot(F.col("node"), fan_in)
    return nodes.withColumn("parent", parent)


# Rows that are handed back together.
OUTPUT_ROWS = 10_000


def _per_node(
    rows: DataFrame, keys: list[str], step: Callable[[tuple, pa.Table], pa.Table], schema: T.StructType
) -> DataFrame:
    """`step` of the rows of every node.

    Nodes are many and most are small, so they are read from sorted partitions: a call for
    each would cost far more than its work. A task holds one node at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, size = [], 0
        for node in whole_nodes(batches, keys):
            done.append(step(tuple(node.column(k)[0] for k in keys), node))
            size += done[-1].num_rows
            if size >= OUTPUT_ROWS:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
                done, size = [], 0
        if size:
            yield from pa.concat_tables(done).combine_chunks().to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def whole_nodes(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows that follow each other and have the same keys, however they are cut into batches."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        before = [held[-1].slice(held[-1].num_rows - 1)] if held else []
        seen = pa.concat_tables([*before, table])
        changed = np.zeros(seen.num_rows - 1, dtype=bool)
        for key in keys:
            codes = seen.column(key).combine_chunks().dictionary_encode().indices
            changed |= np.diff(codes.to_numpy(zero_copy_only=False)) != 0
        start = 0
        for edge in (np.flatnonzero(changed) + 1 - len(before)).tolist():
            yield pa.concat_tables([*held, table.slice(start, edge - start)])
            held, start = [], edge
        held.append(table.slice(start))
    if held:
        yield pa.concat_tables(held)


def _composed(nodes: DataFrame, group: list[str], ttl: int, fan_in: int) -> DataFrame:
    """Functions of the parents from the functions of their children."""
    schema = T.StructType(
        [nodes.schema[name] for name in [*group, "node"]]
        + [T.StructField("x", T.LongType()), T.StructField("y", T.LongType())]
    )

    def compose(key: tuple, rows: pa.Table) -> pa.Table:
        xs, ys = compose_steps(_children(rows), ttl)
        return _filled(key, schema, {"x": xs, "y": ys})

    return _per_node(_with_parent(nodes, fan_in), [*group, "parent"], compose, schema)


def _handed_down(
    nodes: DataFrame, entries: DataFrame, group: list[str], ttl: int, fan_in: int, top: bool
) -> DataFrame:
    """Where the running anchor ends at the start of every child."""
    schema = T.StructType(
        [nodes.schema[name] for name in group]
        + [T.StructField("parent", T.LongType()), T.StructField("ends", T.LongType())]
    )

    def descend(key: tuple, rows: pa.Table) -> pa.Table:
        ends = rows.column("ends")[0].as_py()
        numbers, starts = [], []
        for number, xs, ys in _children(rows):
            numbers.append(number)
            starts.append(ends)
            ends = after(xs, ys, ends, ttl)
        return _filled(key[:-1], schema, {"parent": numbers, "ends": starts})

    joined = _with_parent(nodes, None if top else fan_in).join(entries, [*group, "parent"])
    return _per_node(joined, [*group, "parent"], descend, schema)


def _anchors_of(
    leaves: DataFrame, entries: DataFrame, group: list[str], ttl: int, fan_in: int | None
) -> DataFrame:
    """Anchors set inside the blocks below the given entries."""
    keys = group[:-1]
    schema = T.StructType(
        [leaves.schema[name] for name in keys] + [T.StructField("anchor_us", T.LongType())]
    )

    def walk(key: tuple, rows: pa.Table) -> pa.Table:
        ends = rows.column("ends")[0].as_py()
        found = []
        for _, xs, ys in _children(rows):
            moved = after(xs, ys, ends, ttl)
            if moved != ends:
                found.append(moved - ttl)
            ends = moved
        return _filled(key[: len(keys)], schema, {"anchor_us": found})

    joined = _with_parent(leaves, fan_in).join(entries, [*group, "parent"])
    return _per_node(joined, [*group, "parent"], walk, schema)


def _filled(key: tuple, schema: T.StructType, values: dict[str, Sequence[int]]) -> pa.Table:
    """Key values repeated next to the computed columns."""
    size = len(next(iter(values.values())))
    constants = [pa.repeat(part, size) for part in key]
    numbers = [pa.array(column, pa.int64()) for column in values.values()]
    return pa.Table.from_arrays([*constants, *numbers], names=schema.names)


def _children(rows: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Step functions of the children in time order."""
    node = rows.column("node").to_numpy()
    x = rows.column("x").to_numpy()
    y = rows.column("y").to_numpy()
    order = np.lexsort((x, node))
    node, x, y = node[order], x[order], y[order]
    edges = np.flatnonzero(np.diff(node)) + 1
    for at, xs, ys in zip(
        node[np.r_[0, edges]], np.split(x, edges), np.split(y, edges), strict=True
    ):
        yield int(at), xs, ys


def after(xs: np.ndarray, ys: np.ndarray, ends: int, ttl: int) -> int:
    """End of the running anchor once a node has been passed."""
    at = np.searchsorted(xs, ends)
    return ends if at == len(xs) else int(ys[at]) + ttl


def compose_steps(
    children: Iterator[tuple[int, np.ndarray, np.ndarray]], ttl: int
) -> tuple[np.ndarray, np.ndarray]:
    """Step function of neighbouring nodes, computed for all steps at once.

    An anchor set before the parent ends within its first block, so the steps
    of the first child and the first step after them are all that can be
    entered.
    """
    parts = list(children)
    _, domain, last = parts[0]
    ends = last + ttl
    if len(parts) > 1:
        later = parts[1][1][:1]
        later = later[later > domain[-1]]
        domain = np.r_[domain, later]
        last = np.r_[last, later]
        ends = np.r_[ends, later]
    for _, xs, ys in parts[1:]:
        at = np.searchsorted(xs, ends)
        inside = at < len(xs)
        last = np.where(inside, ys[np.minimum(at, len(xs) - 1)], last)
        ends = np.where(inside, last + ttl, ends)
    # Starts that leave the same anchor behind are one step.
    keep = np.r_[np.diff(last) != 0, True]
    return domain[keep], last[keep]
