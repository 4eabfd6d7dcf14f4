"""Conversation structure repair: the cheapest edits by a dynamic program with square-root checkpoints.

A first pass streams the rows of a conversation backwards, without texts, and stores the backward state-cost vector only at
the triangular distances 1, 3, 6, 10, ... from the end: about sqrt(2n) vectors for n rows. A second pass streams the rows forwards, holds
one block between two checkpoints, recomputes the vectors inside it and walks through it along the tight edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.shared import write_table

# States of the role grammar (s?(ua)+)?: nothing yet, after s, after u, after a. Nothing yet and after a may end.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)  # after the user or assistant turn that a state asks for
SYSTEM, USER, ASSISTANT, OTHER = range(4)
KEPT = {(START, SYSTEM): AFTER_S, (START, USER): AFTER_U, (AFTER_S, USER): AFTER_U, (AFTER_A, USER): AFTER_U, (AFTER_U, ASSISTANT): AFTER_A}
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
REROLE, DELETE, INSERT, OPEN_END, NEVER = 1, 2, 5, 5, 1 << 60
SPACES = " \t\n\x0b\x0c\r"
Vector = tuple[int, int, int, int]


def with_inserts(w: Vector) -> Vector:
    """Costs if any number of turns may be inserted first; more than two never help."""
    return min(w[0], INSERT + w[2], 2 * INSERT + w[3]), min(w[1], INSERT + w[2], 2 * INSERT + w[3]), min(w[2], INSERT + w[3]), min(w[3], INSERT + w[2])


END = with_inserts((0, NEVER, NEVER, 0))


def kept_cost(fault: int, role: int, state: int, after: Vector) -> int:
    """Cost of keeping a row and going on, or NEVER."""
    to = KEPT.get((state, role))
    return NEVER if to is None or fault >= BLANK else after[to] + (OPEN_END if fault == TRUNCATED else 0)


def before(fault: int, role: int, after: Vector) -> Vector:
    """The backward state-cost vector in front of a row from the one behind it."""
    if fault >= BLANK:
        return with_inserts((DELETE + after[0], DELETE + after[1], DELETE + after[2], DELETE + after[3]))
    extra = REROLE + (OPEN_END if fault == TRUNCATED else 0)
    return with_inserts(tuple(min(DELETE + after[s], kept_cost(fault, role, s, after), extra + after[NEXT[s]]) for s in range(4)))


class Repair:
    """One conversation read forwards: measures, edits and the digest of what is left. Holds one block of rows at a time."""

    def __init__(self, n: int = 0, points: list[int] | None = None) -> None:
        vectors = [END] + [tuple(points[k : k + 4]) for k in range(0, len(points or []), 4)]
        self.ends = [(n - k * (k + 1) // 2, v) for k, v in enumerate(vectors)]  # falling places, a vector for each
        self.state, self.cost, self.seen, self.block = START, 0, 0, []
        self.audit: list[str] = []
        self.digest, self.texts = hashlib.sha256(), 0
        self.faults, self.illegal = [0] * 4, 0
        self.first_turn = self.last_turn = None
        self.turns, self.role_before = 0, ""
        while self.ends and self.ends[-1][0] <= 0 < n:
            self.ends.pop()

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.faults[fault] += 1
        if turn is not None and turn != self.last_turn:
            self.first_turn, self.last_turn, self.turns = turn if self.first_turn is None else self.first_turn, turn, self.turns + 1
        if self.seen and self.role_before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.role_before, self.seen = role[:1], self.seen + 1
        self.block.append((fault, role, text))
        if self.seen == self.ends[-1][0]:
            self.walk(self.ends.pop()[1])

    def say(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.texts else ''}{role}:{text}".encode())
        self.texts += 1

    def insert(self) -> None:
        self.audit.append("I")
        self.say("user" if NEXT[self.state] == AFTER_U else "assistant", "")
        self.state = NEXT[self.state]

    def walk(self, behind: Vector) -> None:
        """Recompute the vectors of the block and take the ASCII-least tight edits (D, I, K, R) through it."""
        vectors = [behind]
        for fault, role, _ in reversed(self.block):
            vectors.append(before(fault, initial(role), vectors[-1]))
        vectors.reverse()
        if not self.audit:
            self.cost = vectors[0][START]
        for k, (fault, role, text) in enumerate(self.block):
            here, after = vectors[k], vectors[k + 1]
            while DELETE + after[self.state] != here[self.state] and INSERT + here[NEXT[self.state]] == here[self.state]:
                self.insert()
            if DELETE + after[self.state] == here[self.state]:
                self.audit.append("D")
                continue
            if kept_cost(fault, initial(role), self.state, after) == here[self.state]:
                self.audit.append("K")
                self.state = KEPT[self.state, initial(role)]
            else:
                self.audit.append("R")
                self.state = NEXT[self.state]
                role = "user" if self.state == AFTER_U else "assistant"
            self.say(role, text)
        self.block = []

    def row(self, conv_id: int | None) -> tuple:
        if self.seen:
            while self.state not in (START, AFTER_A):
                self.insert()
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return (
            conv_id, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal, self.cost, "".join(self.audit),
            self.digest.hexdigest(), self.seen,
        )


def initial(role: str) -> int:
    """Number of the role's first letter; an empty or other role has no place in the grammar and can't be kept."""
    return {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role[:1], OTHER)


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a conversation from its end: its number of rows and the vectors at triangular distances."""
    key, last, n, vector, points, out = None, None, 0, END, [], []
    step = 1

    def push(fault: int, role: int) -> None:
        nonlocal n, vector, step
        vector, n = before(fault, role, vector), n + 1
        if n == step * (step + 1) // 2:
            points.extend(vector)
            step += 1

    def flush() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "n", "points"])

    for batch in batches:
        names = ("conv_id", "turn", "role", "mark", "fault", "later")
        for conv_id, turn, role, mark, fault, later in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            row = (conv_id, turn, role, mark)
            if last is not None:
                push(DUPLICATE if last[1] != BLANK and (last[2] or last[0] == row) else last[1], initial(last[0][2]))
                if conv_id != key:
                    out.append((key, n, points))
                    n, vector, points, step = 0, END, [], 1
            key, last = conv_id, (row, fault, later)
        if out:
            yield flush()
    if last is not None:
        push(DUPLICATE if last[1] != BLANK and last[2] else last[1], initial(last[0][2]))
        out.append((key, n, points))
        yield flush()


RESULT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
    "repaired_sha256 string, n_rows bigint"
)


def _forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = [c.split()[0] for c in RESULT.split(", ")], [pa.string() if "string" in c else pa.int64() for c in RESULT.split(", ")]
    key, repair, last, out = None, None, None, []

    def flush() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        columns = ("conv_id", "kind", "turn", "role", "mark", "fault", "later", "n", "points")
        for text, conv_id, kind, turn, role, mark, fault, later, n, points in zip(
            batch.column("text"), *(batch.column(c).to_pylist() for c in columns), strict=True,
        ):
            if repair is None or conv_id != key:
                if repair is not None:
                    out.append(repair.row(key))
                key, repair, last = conv_id, Repair(), None
            if kind == 0:
                repair = Repair(n, points)
            elif kind == 2:
                row = (turn, role, mark)
                repair.add(turn, role, text.as_py(), DUPLICATE if fault != BLANK and (later or last == row) else fault)
                last = row
        if out:
            yield flush()
    if repair is not None:
        out.append(repair.row(key))
        yield flush()


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text and dropped after the damage that crc32(`conv_id:turn`) % 20 asks for; nulls count as one space."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), blank))
    case = F.crc32(key.cast("binary")) % 20
    text = F.coalesce(F.col(text_col), blank)
    text = F.when(case == 1, "").when(case == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(case == 4, "user").otherwise(F.coalesce(F.col(role_col), blank))
    copies = F.explode(F.when(case == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    out = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), (case == 0).alias("dropped"), copies.alias("copy"))
    return out.drop("copy")


def _fault(text: Column) -> Column:
    end = F.substring(F.rtrim(text, F.lit(SPACES)), -1, 1)
    return F.when(end == "", BLANK).when(end.isin(".", "!", "?"), FINE).otherwise(TRUNCATED)


def repair(rows: DataFrame, with_dropped: bool = False) -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired text of every conversation in conv_id, turn, role and text.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 and n_rows, one row a conversation;
    a null conv_id is a conversation too. Rows are ordered by turn, nulls first; rows of one turn by role, then by the sha256 of
    the text. Null roles and texts count as one space. An empty or unknown role is rerouted or deleted, never kept. With
    `with_dropped` the rows marked in the column dropped only make their conversation appear. An empty table gives no row.

    A text that occurs again later is found by counting (role, digest) pairs, partial sums first; repeats within one turn stand side by side.
    Texts travel once. A conversation of n rows is one stream in a task, since its digest must see its texts in order, and keeps about
    sqrt(2n) vectors, sqrt(2n) rows and the audit in memory, whatever its share of the table.
    """
    dropped = F.col("dropped") if with_dropped else F.lit(False)
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), dropped.alias("dropped"))
    rows = rows.withColumns({"mark": F.unhex(F.sha2("text", 256)), "fault": _fault(F.col("text")), "place": F.struct(F.col("turn").isNotNull().alias("some"), "turn")})
    live = rows.where(~F.col("dropped"))
    again = live.where(F.col("fault") != BLANK).groupBy("conv_id", "role", "mark").agg(F.min("place").alias("first"), F.max("place").alias("end"))
    again = again.where(F.col("first") < F.col("end")).select(*[F.col(c).alias(f"again_{c}") for c in ("conv_id", "role", "mark")], "first")
    again = write_table(again, "repeated-turns")  # its size on disk decides whether Catalyst broadcasts it

    def flagged(frame: DataFrame) -> DataFrame:
        same = [F.col(c).eqNullSafe(F.col(f"again_{c}")) for c in ("conv_id", "role", "mark")]
        return frame.join(again, same[0] & same[1] & same[2], "left").withColumn("later", F.coalesce(F.col("place") > F.col("first"), F.lit(False)))

    order = ["conv_id", "turn", "role", "mark"]
    narrow = flagged(live.drop("text")).select(*order, "fault", "later").repartition("conv_id")
    narrow = narrow.sortWithinPartitions("conv_id", F.desc_nulls_last("turn"), F.desc("role"), F.desc("mark"))
    points = narrow.mapInArrow(_backwards, "conv_id bigint, n bigint, points array<bigint>").withColumn("kind", F.lit(0))
    found = flagged(live).select(*order, "text", "fault", "later").withColumn("kind", F.lit(2))
    every = points.unionByName(found, allowMissingColumns=True)
    if with_dropped:
        every = every.unionByName(rows.where("dropped").select("conv_id", F.lit(1).alias("kind")), allowMissingColumns=True)
    every = every.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "mark")
    return every.mapInArrow(_forwards, RESULT)


def damage_and_repair(rows: DataFrame) -> DataFrame:
    """The digest of every original conversation after the stated damage."""
    return repair(damaged(rows), with_dropped=True)
