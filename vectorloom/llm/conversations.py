"""Repair of conversations by the cheapest edits, found with Hirschberg's divide and conquer.

A conversation is sound when the initials of its roles read ``(s?(ua)+)?``: at most one system turn,
then questions and answers in turn. Four states say what has been read: nothing, the system turn, a
question, an answer. Edits keep a row, change its role, delete it, or insert an empty turn; the
cheapest edits win, of equally cheap ones those whose initials (the audit) come first in ASCII order.

Hirschberg, "A linear space algorithm for computing maximal common subsequences" (CACM 1975): a
forward vector (least cost of every state after the first half) and a backward vector (least cost
from every state to the end) meet in the middle; the crossing of least total cost is kept and both
halves are solved alone, so no table of back-pointers is ever held. A crossing is the arrival in a
state right after a row, so no audit of a half is the beginning of another one. Hence the order of the
least audits of the four states (``rank``) can be carried along with the costs, and it decides between
crossings of equal cost, whatever follows.

At scale no conversation is gathered in one task:

1. Equal rows are counted, first occurrences of repeated texts are joined to the rows.
2. Rows are dealt by ranges of (conversation, order). A task walks through its sorted range. What lies
   wholly inside it is repaired there; conversations at its edges, and any longer than a piece
   (:data:`PIECE_ROWS`, :data:`PIECE_BYTES`), leave as pieces, each with a map from start states to
   costs and ranks of end states.
3. Maps of a conversation (one row per piece) are composed: suffix costs backward, start states forward.
4. Every piece is repaired on its own between its start state and its suffix costs.
5. Repaired pieces pass through one hash per conversation in order, batch by batch. A digest of a whole
   conversation can only be computed in order; only its audit is held.

Defined cases: a null role or text counts as one space; null turns come first, equal turns are ordered
by role, then text; a null conversation id is a conversation; a role without a letter is never sound;
repeated rows are duplicates; a conversation without rows is sound; further columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.columns import col
from vectorloom.session import materialize

#: Blank characters, ends of sentences, costs of the edits.
BLANK = " \t\n\x0b\x0c\r"
ENDINGS = (".", "!", "?")
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 3, 4, 3, 3
DAMAGE_OF = 20

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The turn that may be added in each state, and the state it leads to.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = ("s", "u", "a")
SOUND_PAIRS = {"su", "ua", "au"}
#: What is still to be paid, and inserted, at the end of a conversation.
LAST_COSTS = (0, 2 * INSERT, INSERT, 0)
LAST_EDITS = ("", "II", "I", "")

#: Largest piece of a conversation that is repaired at once.
PIECE_ROWS = 4096
PIECE_BYTES = 4 << 20

NEVER = 1 << 60
OTHER, TRUNCATED, MUST_GO = 3, 4, 8


def kept_state(state: int, initial: str) -> int | None:
    """State after a turn with this initial is kept, if it may stand there."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def step_table() -> list[list[list[tuple[int, int, str]]]]:
    """code -> state before -> ``(state after, cost, edits)`` of the cheapest, first edits of one row.

    A code is a role's number (:data:`OTHER` for none of them), plus :data:`TRUNCATED`, or
    :data:`MUST_GO`. Turns may be inserted before the row; after two the states repeat.
    """
    table = []
    for code in range(MUST_GO + 1):
        extra = LEFT_TRUNCATED if code & TRUNCATED else 0
        initial = INITIALS[code % TRUNCATED] if code < MUST_GO and code % TRUNCATED < OTHER else ""
        by_state = []
        for before in STATES:
            best: dict[int, tuple[int, str]] = {}
            state = before
            for inserted in range(3):
                options = [(state, DELETE, "D")]
                if code < MUST_GO:
                    options.append((NEXT[state], REROLE + extra, "R"))
                    if kept_state(state, initial) is not None:
                        options.append((kept_state(state, initial), extra, "K"))
                for after, cost, edit in options:
                    found = (inserted * INSERT + cost, "I" * inserted + edit)
                    best[after] = min(best.get(after, found), found)
                state = NEXT[state]
            by_state.append([(after, cost, edits) for after, (cost, edits) in sorted(best.items())])
        table.append(by_state)
    return table


STEPS = step_table()


def forward(rows, lo: int, hi: int, start: int) -> tuple[list[int], list[int]]:
    """Least cost of every state after rows ``lo … hi - 1``, and the order of their least audits."""
    cost, rank = [NEVER] * 4, [0] * 4
    cost[start] = 0
    for code, copies in rows[lo:hi]:
        best: list[tuple | None] = [None] * 4
        for before, steps in enumerate(STEPS[code]):
            if cost[before] < NEVER:
                for after, step, edits in steps:
                    found = (cost[before] + step, rank[before], edits)
                    if best[after] is None or found < best[after]:
                        best[after] = found
        reached = sorted((b[1:], after) for after, b in enumerate(best) if b is not None)
        for place, (_, after) in enumerate(reached):
            rank[after] = place
        again = DELETE * (copies - 1)
        cost = [NEVER if b is None else b[0] + again for b in best]
    return cost, rank


def backward(rows, lo: int, hi: int, end) -> list[int]:
    """Least cost from every state before row ``lo`` to the end, given the costs after ``hi - 1``."""
    cost = list(end)
    for code, copies in reversed(rows[lo:hi]):
        again = DELETE * (copies - 1)
        cost = [
            min(NEVER, min(step + cost[after] for after, step, _ in STEPS[code][before]) + again) for before in STATES
        ]
    return cost


def crossing(cost, rank, rest) -> int:
    """State of least total cost; of equally cheap ones that of the first audit."""
    return min((c + r, place, state) for state, (c, place, r) in enumerate(zip(cost, rank, rest)))[2]


def solve(rows, lo: int, hi: int, start: int, end, out: list[str]) -> int:
    """Fill ``out`` with the edits of each row (insertions before it included); returns the last state."""
    if hi - lo == 1:
        code, copies = rows[lo]
        _, edits, after = min((step + end[after], edits, after) for after, step, edits in STEPS[code][start])
        out[lo] = edits + "D" * (copies - 1)
        return after
    middle = (lo + hi) // 2
    state = crossing(*forward(rows, lo, middle, start), backward(rows, middle, hi, end))
    solve(rows, lo, middle, start, [0 if s == state else NEVER for s in STATES], out)
    return solve(rows, middle, hi, state, end, out)


def repaired(rows, roles, texts, start: int, end, last: bool) -> tuple[str, list[str]]:
    """Audit of a piece and its repaired ``role:text`` lines; the last piece is completed."""
    edits, state = [""] * len(rows), start
    if rows:
        solve(rows, 0, len(rows), start, end, edits)
    lines = []

    def insert():
        nonlocal state
        state = NEXT[state]
        lines.append(NAMES[state] + ":")

    for row_edits, role, text in zip(edits, roles, texts):
        for edit in row_edits:
            if edit == "I":
                insert()
            elif edit == "R":
                state = NEXT[state]
                lines.append(f"{NAMES[state]}:{text}")
            elif edit == "K":
                state = kept_state(state, role[:1])
                lines.append(f"{role}:{text}")
    if last:
        edits.append(LAST_EDITS[state])
        for _ in LAST_EDITS[state]:
            insert()
    return "".join(edits), lines


# --- rows ------------------------------------------------------------------------------------


def damage(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies)`` after reproducible damage, by a hash of each row's key.

    A dropped row keeps its conversation in the table with no copies.
    """
    space = F.lit(" ")
    key = F.concat_ws(
        ":", F.coalesce(col("conv_id").cast("string"), space), F.coalesce(col("turn").cast("string"), space)
    )
    kind = F.crc32(key.cast("binary")) % DAMAGE_OF
    role, text = F.coalesce(col("role"), space), F.coalesce(col("text"), space)
    return rows.select(
        col("conv_id").alias("conv_id"),
        F.when(kind != 0, col("turn")).alias("turn"),
        F.when(kind == 0, "").when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def order_of(turn: Column) -> Column:
    return F.struct(turn.isNotNull().alias("known"), turn.alias("turn"))


def judged(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies, whether they are blank, truncated, or a repetition."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    counted = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "copies")
    counted = counted.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    parts = [F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.length("role").cast("string"), "role", "text"]
    keyed = counted.withColumn("same", F.md5(F.concat_ws(":", *parts).cast("binary")))
    repeated = (
        keyed.where("copies > 0")
        .groupBy("same")
        .agg(F.min(order_of(F.col("turn"))).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
    )
    marked = keyed.join(repeated.select("same", "first"), "same", "left")
    end = F.right(F.rtrim("text", F.lit(BLANK)), F.lit(1))
    return marked.select(
        "conv_id", "turn", "role", "text", "copies",
        (end == "").alias("blank"),
        (~end.isin(*ENDINGS)).alias("truncated"),
        F.coalesce(order_of(F.col("turn")) > F.col("first"), F.lit(False)).alias("again"),
    )


TOTALS = "blank long, duplicate long, truncated long, illegal long"
PIECE = (
    "conv_id long, part int, seq int, first_turn long, last_turn long, turns long, first_role string, last_role string, "
    + TOTALS
    + ", cost long, audit string, digest string, costs array<long>, ranks array<long>, "
    "codes array<int>, copies array<long>, roles array<string>, texts array<string>"
)
LONGS = pa.list_(pa.int64())
PIECE_FIELDS = [
    ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("first_turn", pa.int64()),
    ("last_turn", pa.int64()), ("turns", pa.int64()), ("first_role", pa.string()), ("last_role", pa.string()),
    ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("cost", pa.int64()), ("audit", pa.string()), ("digest", pa.string()), ("costs", LONGS), ("ranks", LONGS),
    ("codes", pa.list_(pa.int32())), ("copies", LONGS), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
]


class Piece:
    """Rows of one conversation that follow each other, and what is counted over them."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.rows, self.roles, self.texts, self.bytes = [], [], [], 0
        self.first_turn = self.last_turn = self.first_role = self.last_role = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def full(self) -> bool:
        return len(self.rows) >= PIECE_ROWS or self.bytes >= PIECE_BYTES

    def add(self, turn, role, text, copies, blank, truncated, again) -> None:
        if not copies:
            return
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.last_turn = turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
        initial = role[:1]
        if self.last_role is None:
            self.first_role = initial
        else:
            self.illegal += self.last_role + initial not in SOUND_PAIRS
        self.last_role = initial
        self.illegal += copies - 1
        if blank:
            self.blank += copies
            code = MUST_GO
        else:
            self.duplicate += copies - (not again)
            if again:
                code = MUST_GO
            else:
                self.truncated += truncated
                code = (INITIALS.index(initial) if initial in INITIALS else OTHER) + (TRUNCATED if truncated else 0)
        self.rows.append((code, copies))
        self.roles.append(role)
        self.texts.append(text)
        self.bytes += len(text)

    def summary(self, part: int, seq: int) -> dict:
        names = "conv_id first_turn last_turn turns first_role last_role blank duplicate truncated illegal"
        return {"part": part, "seq": seq, **{name: getattr(self, name) for name in names.split()}}

    def whole(self, part: int, seq: int) -> dict:
        audit, lines = repaired(self.rows, self.roles, self.texts, START, LAST_COSTS, True)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        cost = backward(self.rows, 0, len(self.rows), LAST_COSTS)[START]
        return {**self.summary(part, seq), "cost": cost, "audit": audit, "digest": digest}

    def open(self, part: int, seq: int) -> dict:
        maps = [forward(self.rows, 0, len(self.rows), state) for state in STATES]
        return {
            **self.summary(part, seq),
            "costs": [c for cost, _ in maps for c in cost],
            "ranks": [r for _, rank in maps for r in rank],
            "codes": [code for code, _ in self.rows],
            "copies": [copies for _, copies in self.rows],
            "roles": self.roles,
            "texts": self.texts,
        }


def piece_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(PIECE_FIELDS))


def cut(rows: DataFrame) -> DataFrame:
    """Repaired conversations and open pieces of the others, in the order of the ranges."""
    prefix = F.substring("text", 1, 32)
    dealt = rows.repartitionByRange("conv_id", "turn", "role", prefix)
    in_order = dealt.sortWithinPartitions("conv_id", "turn", "role", "text").select(
        "conv_id", "turn", "role", "text", "copies", "blank", "truncated", "again"
    )

    def walk(batches):
        part, seq, out, size = TaskContext.get().partitionId(), 0, [], 0
        piece, inner = None, False  # inner: the conversation began in this range and has one piece so far
        for batch in batches:
            for values in zip(*[column.to_pylist() for column in batch.columns]):
                if piece is not None and values[0] != piece.conv_id:
                    out.append(piece.whole(part, seq) if inner else piece.open(part, seq))
                    size += 0 if inner else piece.bytes
                    seq, piece, inner = seq + 1, Piece(values[0]), True
                elif piece is None:
                    piece = Piece(values[0])
                elif piece.full():
                    out.append(piece.open(part, seq))
                    size += piece.bytes
                    seq, piece, inner = seq + 1, Piece(values[0]), False
                piece.add(*values[1:])
                if len(out) >= 1000 or size >= PIECE_BYTES:
                    yield piece_batch(out)
                    out, size = [], 0
        if piece is not None:
            out.append(piece.open(part, seq))
        if out:
            yield piece_batch(out)

    return in_order.mapInArrow(walk, PIECE)


PLAN = "conv_id long, part int, seq int, start int, ends array<long>, last boolean, gaps long, " + TOTALS + ", cost long"


def composed(pieces: DataFrame) -> DataFrame:
    """Start state and suffix costs of every piece; what is counted over a conversation is on its first one."""
    summaries = pieces.select(
        "conv_id", "part", "seq", "first_turn", "last_turn", "turns", "first_role", "last_role", "blank", "duplicate",
        "truncated", "illegal", "costs", "ranks",
    )

    def compose(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda row: (row["part"], row["seq"]))
        ends = [list(LAST_COSTS)]
        for row in reversed(rows):
            costs = row["costs"]
            ends.append([min(NEVER, min(costs[4 * s + t] + ends[-1][t] for t in STATES)) for s in STATES])
        ends.reverse()
        out, state = [], START
        for i, row in enumerate(rows):
            out.append(
                {
                    "conv_id": row["conv_id"], "part": row["part"], "seq": row["seq"], "start": state, "ends": ends[i + 1],
                    "last": i == len(rows) - 1,
                }
            )
            line = slice(4 * state, 4 * state + 4)
            state = crossing(row["costs"][line], row["ranks"][line], ends[i + 1])
        filled = [row for row in rows if row["first_role"] is not None]
        timed = [row for row in rows if row["turns"]]
        total = {name: sum(row[name] for row in rows) for name in ("blank", "duplicate", "truncated", "illegal")}
        for a, b in zip(filled, filled[1:]):
            total["illegal"] += a["last_role"] + b["first_role"] not in SOUND_PAIRS
        turns = sum(row["turns"] for row in timed) - sum(
            a["last_turn"] == b["first_turn"] for a, b in zip(timed, timed[1:])
        )
        total["gaps"] = timed[-1]["last_turn"] - timed[0]["first_turn"] + 1 - turns if timed else 0
        out[0].update(total, cost=ends[0][START])
        kinds = [(f.name, f.type) for f in plan_schema]
        return pa.Table.from_pylist(out, schema=pa.schema(kinds))

    plan_schema = pa.schema(
        [
            ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("start", pa.int32()), ("ends", LONGS),
            ("last", pa.bool_()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
            ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()),
        ]
    )
    return summaries.groupBy("conv_id").applyInArrow(compose, PLAN)


REPAIRED = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "digest string"
)


def reconstructed(pieces: DataFrame, plan: DataFrame) -> DataFrame:
    """Audit and lines of every piece, ``(conv_id, part, seq, …, audit, lines)``; lines null if there are none."""
    rows = pieces.select("part", "seq", "codes", "copies", "roles", "texts").join(plan, ["part", "seq"])
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    given = rows.select("conv_id", "part", "seq", *counts, "codes", "copies", "roles", "texts", "start", "ends", "last")

    def solve_pieces(batches):
        for batch in batches:
            audits, lines = [], []
            for row in range(batch.num_rows):
                codes, copies, roles, texts, start, ends, last = (
                    batch.column(c)[row].as_py() for c in range(9, batch.num_columns)
                )
                audit, text = repaired(list(zip(codes, copies)), roles, texts, start, ends, last)
                audits.append(audit)
                lines.append("\n".join(text) if text else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:9], pa.array(audits, pa.string()), pa.array(lines, pa.string())],
                names=[*batch.schema.names[:9], "audit", "lines"],
            )

    kinds = ", ".join(f"{name} long" for name in counts)
    return given.mapInArrow(
        solve_pieces, f"conv_id long, part int, seq int, {kinds}, audit string, lines string"
    )


def joined(parts: DataFrame) -> DataFrame:
    """One row per conversation; its pieces pass through a hash in order."""
    in_order = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")

    def stream(batches):
        state = None  # [conv_id, counts, audits, hash, whether a line came before]

        def closed():
            conv_id, counts, audits, digest, _ = state
            values = [conv_id, *counts, "".join(audits), digest.hexdigest()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], pa.string() if isinstance(v, str) else pa.int64()) for v in values],
                names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "digest"],
            )

        for batch in batches:
            for row in range(batch.num_rows):
                conv_id, _, _, *counts, audit, lines = (column[row].as_py() for column in batch.columns)
                if state is None or state[0] != conv_id:
                    if state is not None:
                        yield closed()
                    state = [conv_id, counts, [], hashlib.sha256(), False]
                state[2].append(audit)
                if lines is not None:
                    if state[4]:
                        state[3].update(b"\n")
                    state[3].update(lines.encode())
                    state[4] = True
        if state is not None:
            yield closed()

    return in_order.mapInArrow(stream, REPAIRED)


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``(conv_id, turn, role, text, copies)``: counts, cost, audit and the
    SHA-256 of the repaired turns. A row may stand for several copies, or for none."""
    pieces = materialize(cut(judged(rows)), "pieces")
    turns = F.when(F.col("turns") > 0, F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")).otherwise(0)
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "digest"]
    whole = pieces.where("audit is not null").withColumn("gaps", turns.cast("long")).select(*names)
    still_open = pieces.where("audit is null")
    return whole.unionByName(joined(reconstructed(still_open, composed(still_open))).select(*names))
