"""Repair of conversations by a parallel Viterbi search whose chunks converge in rank.

A repaired conversation has the roles ``(s?(ua)+)?`` by initial. Every row is kept, given another
role or deleted, and rows may be inserted; the cheapest edits are wanted, and of those the least
list of initials. The states are the grammar's: nothing yet, after the system row, after a user row,
after an assistant row. A row turns the cost vector of the states after it into the one before it.

All rows, in order of conversation and turn, are numbered and cut into chunks of equal size, whatever
conversations they hold, so one that fills a third of the table is many chunks. Each chunk runs
backward from a speculative vector where its last conversation goes on. In fix-up passes, a chunk
whose neighbour's vector differs from the one it used by more than a constant is run again, old and new
vector side by side, and stops where the two differ by a constant only: from there the old result
holds, shifted. When a pass changes nothing, every chunk knows its costs up to a constant, which no
choice depends on. The least list is then traced forward; a chunk traces all four states it may be
entered in, and chunks learn the entering state from their left neighbour, mostly in one pass, since
traces meet.

Between passes there is one small row per chunk, in the shared folder; a chunk's rows are one byte
each. Texts are shuffled to be sorted, to meet their edits, and to be digested. Digest and list of edits
of a conversation are single values and made in one task, row by row; the repaired rows
themselves (``repaired``) are made in parallel.

Defined cases: a null role or text is one space, in keys as well; a null conv_id is one conversation; rows of
one turn stand in order of role and text (64 characters, then a hash), a repeated one beside its
original; repeated rows are rows of their own (and so duplicates); conversations that lose all rows have zeros; an empty table
has no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.llm.common import give_back, stored
from tablesync.operators.chunking import INDEX, number_rows

CHUNK_ROWS = 8_192
# White space, and the marks that end a text.
BLANK, ENDS = " \t\n\x0b\x0c\r", ".!?"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2, "truncated": 1}
FINE, BLANK_ROW, DUPLICATE, TRUNCATED = range(4)
FAULT_BITS, START_BIT = 2, 16  # a row's byte: fault, role above it, and whether it starts a conversation
ROLES = ("s", "u", "a")  # role 3 is any other
# state that follows a row given (or inserted with) the role its place asks for
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = {(NOTHING, 0): SYSTEM, (NOTHING, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
DONE = (0, 4, 2, 0)  # cost of closing a conversation in each state, by inserts


# ------------------------------------------------------------ rows


def words_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage by the checksum of ``conv_id:turn``: ``conv_id, turn, role, text, again``."""
    key = F.concat_ws(":", words_of("conv_id"), words_of("turn"))
    kind = F.crc32(key.cast("binary")) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        words_of("role").alias("role"), words_of("text").alias("text"), kind.alias("kind"),
    )
    text = F.when(F.col("kind") == 1, F.lit("")).when(
        F.col("kind") == 2, F.regexp_replace("text", f"[{ENDS}]", "")
    ).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("again"))


def in_order(rows: DataFrame) -> DataFrame:
    """Rows with ``_row_index``, their place among all rows by conversation, turn, role and text (its beginning, then a hash)."""
    beginning = F.substring("text", 1, 64)  # sort keys are sampled on the driver, whole texts are not
    keys = ["conv_id", "turn", "role", beginning.asc(), F.xxhash64("text").asc(), "again"]
    return number_rows(rows, keys).df


def row_codes(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``chunk, place, conv_id, code``: fault and role of each row, one byte; nothing else travels."""
    bare = F.rtrim(F.col("text"), F.lit(BLANK))
    alike = rows.select(
        INDEX, "conv_id", "role", F.sha2("text", 256).alias("text"),
    ).groupBy("conv_id", "role", "text").agg(F.min(INDEX).alias(INDEX))
    fault = F.when(bare == "", BLANK_ROW).when(~F.right(bare, F.lit(1)).isin(*ENDS), TRUNCATED).otherwise(FINE)
    initial = F.left("role", F.lit(1))
    role = F.lit(3)
    for i, r in enumerate(ROLES):
        role = F.when(initial == r, i).otherwise(role)
    own = rows.select(INDEX, "conv_id", (role * (1 << FAULT_BITS) + fault).alias("code"))
    # the first of equal rows is marked by a row of its own, so no join is needed: both meet in their chunk
    marks = alike.select(INDEX, F.lit(None).cast("long").alias("conv_id"), F.lit(-1).alias("code"))
    return own.unionByName(marks).withColumn("chunk", F.expr(f"{INDEX} div {chunk_rows}L"))


BLOCK = "chunk long, first long, n int, codes binary, first_conv string, last_conv string"


def blocks(codes: DataFrame) -> DataFrame:
    """One row per chunk: its rows' bytes in order, and the conversations it begins and ends with."""
    schema = pa.schema([
        ("chunk", pa.int64()), ("first", pa.int64()), ("n", pa.int32()), ("codes", pa.binary()),
        ("first_conv", pa.string()), ("last_conv", pa.string()),
    ])

    def block(table: pa.Table) -> pa.Table:
        index = table.column(INDEX).to_numpy()
        code = table.column("code").to_numpy()
        row = np.flatnonzero(code >= 0)
        row = row[np.argsort(index[row], kind="stable")]
        conv = [str(c) for c in table.column("conv_id").take(pa.array(row)).to_pylist()]
        out = code[row].astype(np.uint8)
        again = ~np.isin(index[row], index[code < 0])
        fault = out & (1 << FAULT_BITS) - 1
        out += np.where(again & (fault != BLANK_ROW), DUPLICATE - fault, 0).astype(np.uint8)
        starts = np.array([i > 0 and c != conv[i - 1] for i, c in enumerate(conv)], np.uint8)
        out |= starts * np.uint8(START_BIT)
        return pa.Table.from_arrays([
            pa.array([table.column("chunk")[0].as_py()]), pa.array([index[row[0]]]), pa.array([len(row)], pa.int32()),
            pa.array([out.tobytes()], pa.binary()), pa.array([conv[0]]), pa.array([conv[-1]]),
        ], schema=schema)

    return codes.groupBy("chunk").applyInArrow(block, BLOCK)


# ------------------------------------------------------------ one chunk


def before(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs of the states before a row, from those after it."""
    fault, role = code & 3, code >> FAULT_BITS & 3
    row = [COST[DELETE] + after[x] for x in range(4)]
    if fault in (FINE, TRUNCATED):
        extra = COST["truncated"] if fault == TRUNCATED else 0
        for x in range(4):
            row[x] = min(row[x], COST[REROLE] + extra + after[NEXT[x]])
            kept = KEPT.get((x, role))
            if kept is not None:
                row[x] = min(row[x], extra + after[kept])
    # inserts before the row: one, or two
    one = [COST[INSERT] + row[NEXT[x]] for x in range(4)]
    two = [2 * COST[INSERT] + row[NEXT[NEXT[x]]] for x in range(4)]
    return tuple(min(a, b, c) for a, b, c in zip(row, one, two, strict=True))


def shift(a, b) -> int | None:
    """The constant by which two vectors differ, if they do."""
    d = a[0] - b[0]
    return d if all(x - y == d for x, y in zip(a, b, strict=True)) else None


def backward(codes: bytes, after: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Cost vectors before every row and, last, after all; a conversation's last row sees ``DONE``."""
    out = [after]
    for i in range(len(codes) - 1, -1, -1):
        after = before(codes[i], after)
        out.append(after)
        if codes[i] & START_BIT:
            after = DONE
    return out[::-1]


def leftmost(codes: bytes, after: tuple[int, ...]) -> tuple[int, ...]:
    for i in range(len(codes) - 1, -1, -1):
        after = before(codes[i], after)
        if codes[i] & START_BIT:
            after = DONE
    return after


def fixed(codes: bytes, old_after, new_after, old_left) -> tuple[int, ...]:
    """Vector at the left edge for another vector at the right, run until both differ by a constant."""
    old, new = tuple(old_after), tuple(new_after)
    for i in range(len(codes) - 1, -1, -1):
        d = shift(new, old)
        if d is not None:
            # what lies to the left is as before, shifted if it is still the same conversation
            return tuple(old_left) if any(c & START_BIT for c in codes[: i + 1]) else tuple(x + d for x in old_left)
        old, new = before(codes[i], old), before(codes[i], new)
        if codes[i] & START_BIT:
            return tuple(old_left)
    return new


def trace(codes: bytes, vectors: list[tuple[int, ...]], state: int, closes: bool, first: int, last: int) -> tuple[list[str], int]:
    """Least cheapest edits of the rows ``first`` to ``last - 1`` of one conversation and the state after them.

    ``vectors[i]`` are the costs before row ``i`` within the conversation. Inserts stand with the row they
    precede; those that close the conversation with its last row.
    """
    out = []
    for i in range(first, last):
        end = i + 1 == last
        after = DONE if end and closes else vectors[i + 1]
        fault, role = codes[i] & 3, codes[i] >> FAULT_BITS & 3
        extra = COST["truncated"] if fault == TRUNCATED else 0
        kept = KEPT.get((state, role))
        steps = ""
        while True:
            left = vectors[i][state]
            if COST[DELETE] + after[state] == left:
                steps += DELETE
                break
            if COST[INSERT] + vectors[i][NEXT[state]] == left:
                steps += INSERT
                state = NEXT[state]
                kept = KEPT.get((state, role))
                continue
            if kept is not None and fault in (FINE, TRUNCATED) and extra + after[kept] == left:
                steps += KEEP
                state = kept
            else:
                steps += REROLE
                state = NEXT[state]
            break
        if end and closes:
            while state not in (NOTHING, ASSISTANT):
                steps += INSERT
                state = NEXT[state]
        out.append(steps)
    return out, state


def stretches(codes: bytes) -> list[tuple[int, int]]:
    """First and past-last row of each conversation's part of a chunk."""
    starts = [0, *[i for i in range(1, len(codes)) if codes[i] & START_BIT]]
    return list(zip(starts, [*starts[1:], len(codes)], strict=True))


# ------------------------------------------------------------ passes over all chunks


EDGE = "chunk long, used array<long>, left array<long>, first_conv string, last_conv string"


def _mapped(df: DataFrame, one, schema: str) -> DataFrame:
    """``one`` (a function of a dict, giving dicts) applied to every row, of which there is one per chunk."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                yield from one(row)

    names = [c.split(" ")[0] for c in schema.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    arrow = pa.schema([(n, types[c.split(" ")[1]]) for n, c in zip(names, schema.split(", "), strict=True)])

    def arrowed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = []
        for row in run(parts):
            kept.append(row)
            if len(kept) == 20_000:
                yield pa.RecordBatch.from_pylist(kept, schema=arrow)
                kept = []
        yield pa.RecordBatch.from_pylist(kept, schema=arrow)
        give_back()

    return df.mapInArrow(arrowed, schema)


def speculate(chunks: DataFrame) -> DataFrame:
    """First pass: every chunk from the vector of a conversation that ends where the chunk does."""

    def one(row):
        left = leftmost(row["codes"], DONE)
        yield {"chunk": row["chunk"], "used": list(DONE), "left": list(left), "first_conv": row["first_conv"], "last_conv": row["last_conv"]}

    return _mapped(chunks, one, EDGE)


def _with_right(edges: DataFrame) -> DataFrame:
    """Edges with the vector that the right neighbour gives: its left one, or the end's if it is another conversation."""
    right = edges.select((F.col("chunk") - 1).alias("chunk"), F.col("left").alias("right"), F.col("first_conv").alias("next_conv"))
    goes_on = F.col("next_conv").eqNullSafe(F.col("last_conv"))
    done = F.array(*[F.lit(x).cast("long") for x in DONE])
    return edges.join(right, "chunk", "left").withColumns({"right": F.when(goes_on, F.col("right")).otherwise(done), "goes_on": goes_on})


def converge(chunks: DataFrame) -> tuple[DataFrame, int]:
    """Fix-up passes until no chunk's vector changes by more than a constant; edges and number of passes.

    What a pass leaves alone is as the pass before left it. As vectors only matter up to a constant,
    they are kept with a least entry of zero, which also bounds them.
    """
    level = lambda c: F.transform(c, lambda x: x - F.array_min(c))
    edges = stored(speculate(chunks).withColumn("left", level(F.col("left"))), "edges")
    passes = 0
    while True:
        near = _with_right(edges)
        differs = level(F.col("right")) != level(F.col("used"))
        stale = near.filter(differs)
        if not stale.take(1):
            return edges, passes
        passes += 1

        def one(row):
            left = fixed(row["codes"], row["used"], row["right"], row["left"])
            yield {"chunk": row["chunk"], "used": row["right"], "left": list(left), "first_conv": row["first_conv"], "last_conv": row["last_conv"]}

        again = _mapped(stale.drop("next_conv", "goes_on").join(chunks.select("chunk", "codes"), "chunk"), one, EDGE)
        again = again.withColumn("left", level(F.col("left")))
        edges = stored(near.filter(~differs).select(*edges.columns).unionByName(again), "edges")


def entered(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """``chunk, right, goes_on, comes_in, state``: the state every chunk's first conversation is entered in."""
    near = _with_right(edges).select("chunk", "right", "goes_on")

    def one(row):
        codes = row["codes"]
        vectors = backward(codes, tuple(row["right"]))
        first, last = stretches(codes)[-1]
        ends = [trace(codes, vectors, s if first == 0 else NOTHING, False, first, last)[1] for s in range(4)] if row["goes_on"] else [NOTHING] * 4
        yield {"chunk": row["chunk"], "ends": ends}

    ends = stored(_mapped(near.join(chunks.select("chunk", "codes"), "chunk"), one, "chunk long, ends array<long>"), "ends")
    before_ = ends.select((F.col("chunk") + 1).alias("chunk"), "ends")
    goes = near.select((F.col("chunk") + 1).alias("chunk"), F.col("goes_on").alias("comes_in"))
    rows = near.join(goes, "chunk", "left").join(before_, "chunk", "left")
    # known where nothing comes in, or all four traces of the left neighbour met
    known = F.when(~F.coalesce("comes_in", F.lit(False)), F.lit(NOTHING).cast("long")).when(
        F.array_min("ends") == F.array_max("ends"), F.array_min("ends")
    )
    current = stored(rows.withColumn("state", known), "states")
    while current.filter("state is null").take(1):
        left = current.select((F.col("chunk") + 1).alias("chunk"), F.col("state").alias("left_state"))
        met = F.try_element_at("ends", (F.col("left_state") + 1).cast("int"))
        current = stored(current.join(left, "chunk", "left").withColumn("state", F.coalesce("state", met)).drop("left_state"), "states")
    return current.drop("ends")


def edits(chunks: DataFrame, states: DataFrame) -> DataFrame:
    """``_row_index, code, edits`` of every row."""

    def one(row):
        codes = row["codes"]
        vectors = backward(codes, tuple(row["right"]))
        parts = stretches(codes)
        for first, last in parts:
            closes = last < len(codes) or not row["goes_on"]
            state = row["state"] if first == 0 else NOTHING
            found, _ = trace(codes, vectors, state, closes, first, last)
            for i, steps in zip(range(first, last), found, strict=True):
                yield {INDEX: row["first"] + i, "code": codes[i], "edits": steps, "entered": state}
                for step in steps:
                    if step != DELETE:
                        kept = KEPT.get((state, codes[i] >> FAULT_BITS & 3)) if step == KEEP else None
                        state = NEXT[state] if kept is None else kept

    joined = states.join(chunks.select("chunk", "first", "codes"), "chunk")
    return _mapped(joined, one, f"{INDEX} long, code int, edits string, entered int")


# ------------------------------------------------------------ results


@dataclass(frozen=True)
class Repair:
    """Rows after damage with their edits (stored), and the passes it took."""

    rows: DataFrame
    passes: int


def repair(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> Repair:
    """Edits of the rows of ``conv_id, turn, role, text, again``."""
    ordered = in_order(rows)
    chunks = stored(blocks(row_codes(ordered, chunk_rows)), "blocks")
    edges, passes = converge(chunks)
    steps = edits(chunks, entered(chunks, edges))
    return Repair(ordered.join(steps, INDEX), passes)


def repaired(conversations: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The repaired rows of damaged conversations: ``conv_id, _row_index, place, edit, role, text``.

    ``place`` orders the rows that an original row gives: those inserted before it, itself, those
    inserted after it.
    """
    schema = pa.schema([
        ("conv_id", pa.int64()), (INDEX, pa.int64()), ("place", pa.int32()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()),
    ])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for row in part.to_pylist():
                for place, (edit, role, text) in enumerate(outcome(row)):
                    out.append({"conv_id": row["conv_id"], INDEX: row[INDEX], "place": place, "edit": edit, "role": role, "text": text})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    rows = repair(damaged(conversations), chunk_rows).rows.select("conv_id", INDEX, "role", "text", "code", "edits", "entered")
    return rows.mapInArrow(run, f"conv_id long, {INDEX} long, place int, edit string, role string, text string")


def outcome(row: dict) -> Iterator[tuple[str, str, str]]:
    """Edit, role and text of every row that a row and the inserts beside it give."""
    state, role = row["entered"], row["code"] >> FAULT_BITS & 3
    names = {USER: "user", ASSISTANT: "assistant"}
    for step in row["edits"]:
        if step == DELETE:
            continue
        state = KEPT[(state, role)] if step == KEEP else NEXT[state]
        if step == KEEP:
            yield step, row["role"], row["text"]
        else:
            yield step, names[state], row["text"] if step == REROLE else ""


REPORT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


class _Conversation:
    """Running counts and digest of one conversation, row by row."""

    def __init__(self, conv_id):
        self.conv_id, self.audit = conv_id, []
        self.digest, self.any = hashlib.sha256(), False
        self.faults = [0] * 4
        self.illegal = self.cost = self.turns = 0
        self.role = self.low = self.turn = None

    def add(self, row: dict) -> None:
        fault, role = row["code"] & 3, row["code"] >> FAULT_BITS & 3
        self.faults[fault] += 1
        if self.role is not None and (self.role, role) not in ((0, 1), (1, 2), (2, 1)):
            self.illegal += 1
        self.role = role
        if row["turn"] is not None and row["turn"] != self.turn:
            self.low = row["turn"] if self.low is None else self.low
            self.turn, self.turns = row["turn"], self.turns + 1
        self.cost += sum(COST[s] for s in row["edits"])
        if fault == TRUNCATED and DELETE not in row["edits"]:
            self.cost += COST["truncated"]
        self.audit.append(row["edits"])
        for _, name, text in outcome(row):
            self.digest.update((b"\n" if self.any else b"") + name.encode() + b":" + text.encode())
            self.any = True

    def report(self) -> dict:
        gaps = 0 if self.low is None else self.turn - self.low + 1 - self.turns
        return {
            "conv_id": self.conv_id, "gaps": gaps, "blank": self.faults[BLANK_ROW], "duplicate": self.faults[DUPLICATE],
            "truncated": self.faults[TRUNCATED], "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit),
            "repaired_sha256": self.digest.hexdigest(),
        }


def report(conversations: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per original conversation: see ``REPORT``."""
    schema = pa.schema([
        (f.split(" ")[0], pa.string() if f.endswith("string") else pa.int64()) for f in REPORT.split(", ")
    ])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, out = None, []
        for part in parts:
            for row in part.to_pylist():
                if current is None or row["conv_id"] != current.conv_id:
                    if current is not None:
                        out.append(current.report())
                    current = _Conversation(row["conv_id"])
                current.add(row)
            if len(out) > 1_000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if current is not None:
            out.append(current.report())
        yield pa.RecordBatch.from_pylist(out, schema=schema)
        give_back()

    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    rows = repair(damaged(conversations), chunk_rows).rows.select("conv_id", INDEX, "turn", "role", "text", "code", "edits", "entered")
    found = rows.repartition("conv_id").sortWithinPartitions("conv_id", INDEX).mapInArrow(run, REPORT)
    same = every["conv_id"].eqNullSafe(found["conv_id"])
    counts = [F.coalesce(found[c], F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return every.join(found, same, "left").select(
        every["conv_id"], *counts, F.coalesce(found["audit"], F.lit("")).alias("audit"),
        F.coalesce(found["repaired_sha256"], F.lit(empty)).alias("repaired_sha256"),
    )
