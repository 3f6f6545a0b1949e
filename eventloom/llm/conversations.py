"""Damage to conversations, found and repaired at the least cost.

Every row becomes one sign: its role's initial and whether it must or should go.
The signs of a conversation are its signature. What a repair costs from some row
on depends on the rest of the signature and on what the grammar has seen so far,
so signatures are put into one automaton from their ends: a node stands for all
conversations that go on alike, and has the cost and the best edit once for each
state of the grammar. In the order of reversed signatures all nodes shared with
the next signature are still on the path to the last one, so a task keeps one path
only, however many conversations it reads. The order has conversations of one
signature over several tasks where there are many.

Texts are shuffled once, when the repaired conversation is hashed, row after row.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.session import materialise, ship_package

# Kinds of damage by remainder, costs of edits, and the grammar
# (s?(ua)+)? as states: nothing yet, after s, after u, after a.
MODULUS = 20
DROPPED, EMPTIED, UNENDED, REPEATED, MADE_USER = range(5)
DELETE, REROLE, INSERT, UNENDED_COST = 2, 1, 5, 5
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: State after the user or assistant turn that may come next, after s, u and a as they are.
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
KEEPS = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}}
ROLES = {AFTER_U: "user", AFTER_A: "assistant"}
#: Signs: a lower-case initial (x: any other) of a whole row, upper-case of one without
#: its end, and that of a row that must go.
GONE = "d"
ACCEPTS = (True, False, False, True)
#: What is left to do by state when all rows are read: nothing, or insertions.
ENDS = ((0, 2 * INSERT, INSERT, 0), b"-II-")

SPACES = " \t\n\x0b\x0c\r"


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after damage by crc32 of `conv_id:turn`; other columns are left out.

    Missing values count as one space, in the text hashed as well; `conv_id` and
    `turn` stay missing.
    """
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % MODULUS
    return (
        rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
        .where(F.col("kind") != DROPPED)
        .withColumn("copy", F.explode(F.when(F.col("kind") == REPEATED, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select(
            "conv_id",
            "turn",
            F.when(F.col("kind") == MADE_USER, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("kind") == EMPTIED, "")
            .when(F.col("kind") == UNENDED, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text"))
            .alias("text"),
        )
    )


def _order() -> list[Column]:
    """The order of a conversation's rows; what is left equal then is equal rows."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("content")]


def _content() -> Column:
    """128 bits of a row's role and text."""
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return F.substring(F.sha2(whole, 256), 1, 32)


def signs(rows: DataFrame) -> DataFrame:
    """`conv_id, turn, role, content, initial, fault` of damaged rows, without their texts.

    `fault` is blank, duplicate, truncated or missing, the first that holds.
    """
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    marked = rows.select(
        "conv_id",
        "turn",
        "role",
        _content().alias("content"),
        F.left("role", F.lit(1)).alias("initial"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        last.isin(".", "!", "?").alias("ends"),
    )
    dealt = marked.repartition("conv_id")
    nth = F.row_number().over(Window.partitionBy("conv_id", "content").orderBy(*_order()))
    fault = (
        F.when(F.col("blank"), "blank")
        .when(nth > 1, "duplicate")
        .when(~F.col("ends"), "truncated")
    )
    return dealt.withColumn("fault", fault).drop("blank", "ends")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def signatures(rows: DataFrame) -> DataFrame:
    """`conv_id, signature` of damaged rows, with the counts of `COUNTS`."""
    ship_package(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation, fields = None, None
        for batch in batches:
            done = []
            for conv_id, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conversation is None or conversation.conv_id != conv_id:
                    if conversation:
                        done.append(conversation.row())
                    conversation = Signature(conv_id)
                conversation.add(*values)
            fields = [("conv_id", batch.schema[0].type), ("signature", pa.string())]
            fields += [(name, pa.int64()) for name in COUNTS]
            yield _batch(done, fields)
        if conversation:
            yield _batch([conversation.row()], fields)

    return (
        signs(rows)
        .sortWithinPartitions("conv_id", *_order())
        .select("conv_id", F.col("turn").cast("bigint"), "initial", "fault")
        .mapInArrow(told, f"conv_id {kind}, signature string, {' bigint, '.join(COUNTS)} bigint")
    )


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    arrays = [pa.array(list(c), kind) for c, (_, kind) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


class Signature:
    """What is said of one conversation while its rows come in by turn."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.signs = bytearray()
        self.first = self.last = self.before = None
        self.turns = self.illegal = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}

    def add(self, turn: int | None, initial: str, fault: str | None) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last = turn if self.first is None else self.first, turn
            self.turns += 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if fault:
            self.faults[fault] += 1
        sign = initial if initial in KEEPS else "x"
        if fault:
            sign = sign.upper() if fault == "truncated" else GONE
        self.signs += sign.encode()

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.conv_id, self.signs.decode(), gaps, *self.faults.values(), self.illegal)


class Repairs:
    """The path of the automaton that leads to the last signature, from its end on.

    A node holds, for each state of the grammar, the least cost from there on and the
    edit that begins it. Of edits that cost the same the least letter comes first; no
    two edits of one row have the same letter, so this gives the least audit.
    """

    def __init__(self):
        self.signature = ""
        self.costs = array("q", ENDS[0])
        self.edits = bytearray(ENDS[1])
        self.answer: tuple[int, str] = (0, "")

    def of(self, signature: str) -> tuple[int, str]:
        """Cost and audit; neighbours should have long ends in common."""
        if signature != self.signature:
            shared = _common_end(self.signature, signature)
            del self.costs[4 * (shared + 1) :], self.edits[4 * (shared + 1) :]
            for sign in reversed(signature[: len(signature) - shared]):
                costs, edits = node(sign, self.costs[-4:])
                self.costs.extend(costs)
                self.edits += edits
            self.signature = signature
            self.answer = (self.costs[4 * len(signature) + START], self._audit())
        return self.answer

    def _audit(self) -> str:
        left, state, audit = len(self.signature), START, bytearray()
        while left or not ACCEPTS[state]:
            edit = chr(self.edits[4 * left + state])
            audit += edit.encode()
            if edit == "K":
                state = KEEPS[self.signature[-left].lower()][state]
            elif edit != "D":
                state = NEXT[state]
            left -= edit != "I"
        return audit.decode()


def _common_end(a: str, b: str) -> int:
    n = 0
    for x, y in zip(reversed(a), reversed(b), strict=False):
        if x != y:
            break
        n += 1
    return n


def node(sign: str, rest: array) -> tuple[list[int], bytes]:
    """Costs and edits of a sign by state, from the costs of all that follows it."""
    found = []
    extra = UNENDED_COST if sign.isupper() else 0
    for state in range(4):
        edits = [(DELETE + rest[state], "D")]
        if sign != GONE:
            edits.append((REROLE + extra + rest[NEXT[state]], "R"))
            kept = KEEPS.get(sign.lower(), {}).get(state)
            if kept is not None:
                edits.append((extra + rest[kept], "K"))
        found.append(min(edits))
    # A third insertion in a row would be in a state that was there before.
    once = [min(found[s], (INSERT + found[NEXT[s]][0], "I")) for s in range(4)]
    best = [min(found[s], (INSERT + once[NEXT[s]][0], "I")) for s in range(4)]
    return [cost for cost, _ in best], "".join(edit for _, edit in best).encode()


def repairs(conversations: DataFrame) -> DataFrame:
    """Conversations with `cost, audit` of their signatures' cheapest repair."""
    ship_package(conversations.sparkSession)
    schema = conversations.schema.simpleString()[len("struct<") : -1]
    kinds = f"{schema},cost:bigint,audit:string"
    place = conversations.columns.index("signature")

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Repairs()
        for batch in batches:
            answers = [known.of(s) for s in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([a[0] for a in answers], pa.int64()), pa.array([a[1] for a in answers], pa.string())],
                [*batch.schema.names, "cost", "audit"],
            )

    # Written first: ranges are chosen by a sample, which would make the rows twice.
    written = materialise(conversations)
    ends = F.reverse("signature")
    return (
        written.repartitionByRange(ends, F.xxhash64("conv_id"))
        .sortWithinPartitions(ends)
        .mapInArrow(solved, kinds)
    )


class Repaired:
    """The hash of a repaired conversation while its rows come in by turn."""

    def __init__(self, conv_id, audit: str):
        self.conv_id = conv_id
        self.audit = audit
        self.at, self.state = 0, START
        self.lines = 0
        self.hash = hashlib.sha256()

    def add(self, role: str, text: str) -> None:
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self._turn(text)
        elif edit == "K":
            self.state = KEEPS[role[0]][self.state]
            self._line(role, text)

    def _insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self._turn("")

    def _turn(self, text: str) -> None:
        self.state = NEXT[self.state]
        self._line(ROLES[self.state], text)

    def _line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) * bool(self.lines)}{role}:{text}".encode())
        self.lines += 1

    def row(self) -> tuple:
        self._insert()
        return (self.conv_id, self.hash.hexdigest())


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row per `conv_id` of the table: faults after damage, and the cheapest repair.

    `conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256`. Rows without conv_id are one conversation. Rows of one turn go by
    role and a hash of their content; repeated rows are duplicates of the first. An
    empty role has no initial, so it is never kept. A conversation without rows after
    damage has zeros, an empty audit and the hash of nothing; an empty table gives no
    rows. Other columns are not read.
    """
    broken = damaged(rows)
    solved = materialise(repairs(signatures(broken))).drop("signature")
    names = [F.col("conv_id").alias("of"), *(c for c in solved.columns if c != "conv_id")]
    everyone = rows.select("conv_id").distinct()
    found = everyone.join(solved.select(*names), F.col("conv_id").eqNullSafe(F.col("of")), "left")
    found = materialise(
        found.drop("of").fillna(0, [*COUNTS, "cost"]).fillna("", ["audit"])
    )
    hashes = repaired(broken, found).withColumnRenamed("conv_id", "of")
    return found.join(hashes, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")


def repaired(broken: DataFrame, audits: DataFrame) -> DataFrame:
    """`conv_id, repaired_sha256` of damaged rows after the edits of `conv_id, audit`."""
    ship_package(broken.sparkSession)
    # A conversation's edits come ahead of its rows, so that no row carries them.
    heads = audits.select("conv_id", "audit")
    lines = broken.withColumn("content", _content())
    both = heads.unionByName(lines, allowMissingColumns=True)
    kind = broken.schema["conv_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation, fields = None, None
        for batch in batches:
            done = []
            for conv_id, audit, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if audit is None:
                    conversation.add(role, text)
                    continue
                if conversation:
                    done.append(conversation.row())
                conversation = Repaired(conv_id, audit)
            fields = [("conv_id", batch.schema[0].type), ("repaired_sha256", pa.string())]
            yield _batch(done, fields)
        if conversation:
            yield _batch([conversation.row()], fields)

    return (
        both.repartition("conv_id")
        .sortWithinPartitions(F.col("conv_id"), F.col("audit").asc_nulls_last(), *_order())
        .select("conv_id", "audit", "role", "text")
        .mapInArrow(hashed, f"conv_id {kind}, repaired_sha256 string")
    )
