"""Cheapest repair of conversations to the roles `(s?(ua)+)?`: an audit of edits, least in cost, then in ASCII.

Edits are Delete, Insert, Keep and Rerole; a row's fault (blank, duplicate, truncated) forbids keeping it or
makes that dear.  The state after a row is one of four: nothing yet, after the system row, after a user row,
after an assistant row.  Inserts come in front of a row or at the end, so an audit names its states.

**Audit prefixes are shared.** Each row and state has one node: its parent, the piece of audit that leads
from it, its rolling hash and its ancestors at distances of powers of two.  Two prefixes of equal cost are
compared by searching the longest common prefix: halving steps over ancestors of equal hash, verified to be
the same node, and then the two pieces behind it.

**Blocks.** The cost from any state to any state through a block of rows is a 4 x 4 table of (cost, audit),
and tables chain, so a conversation need not be whole anywhere while costs are found.  Rows are sorted over
ranges of (conversation, turn, role, text).  A task finishes conversations that lie inside its range and fit
one block; of all others it hands out tables and texts block by block, and the second exchange, by
conversation, chains the tables and streams the texts into the digest (a digest has one order, so that last
pass over a very long conversation is one task, with one block in memory).

Whether a row repeats an earlier one is found by minimum over (conversation, role, text), joined to the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelore.runtime import checkpointed

DELETE, INSERT, KEEP, REROLE = "DIKR"
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 2, 5, 1, 5
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The role that may follow a state beside a first system row, and the state it leads to.
FOLLOWS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL = {"su", "ua", "au"}
#: A block ends after so many rows or bytes of text.
BLOCK_ROWS, BLOCK_BYTES = 2_048, 4_000_000
#: Code points of role and text by which ranges are cut; a cut never needs more of a text.
RANGE_CHARS = 24
_MODULUS, _BASE = (1 << 61) - 1, 1_000_003


# ------------------------------------------------------------------ audits


class Prefix:
    """A shared audit prefix: its parent and the piece behind it, with a hash of the whole."""

    __slots__ = ("piece", "hash", "depth", "up")

    def __init__(self, parent: Prefix | None = None, piece: str = "") -> None:
        self.piece = piece
        if parent is None:
            self.hash, self.depth, self.up = 0, 0, []
            return
        h = parent.hash
        for c in piece:
            h = (h * _BASE + ord(c)) % _MODULUS
        self.hash, self.depth = h, parent.depth + 1
        # up[j] is the ancestor 2^j rows back
        self.up = up = [parent]
        j = 0
        while j < len(up[j].up):
            up.append(up[j].up[j])
            j += 1

    def text(self) -> str:
        pieces, node = [], self
        while node.up:
            pieces.append(node.piece)
            node = node.up[0]
        return "".join(reversed(pieces))


def first_pieces_apart(a: Prefix, b: Prefix, verified: bool = False) -> tuple[str, str]:
    """The pieces behind the longest common prefix of two different prefixes of one depth.

    Steps go to the farthest ancestors whose hashes differ.  Equal hashes of different nodes may be a
    collision; the parents found at the end must be one node, else the search goes by nodes alone.
    """
    x, y = a, b
    for j in range(len(x.up) - 1, -1, -1):
        if j < len(x.up):
            p, q = x.up[j], y.up[j]
            if p is not q if verified else p.hash != q.hash:
                x, y = p, q
    if x.up[0] is not y.up[0] and not verified:
        return first_pieces_apart(a, b, verified=True)
    return x.piece, y.piece


def least(a: tuple[int, Prefix] | None, b: tuple[int, Prefix]) -> tuple[int, Prefix]:
    """The cheaper of two prefixes over the same rows; of equal ones the smaller in ASCII."""
    if a is None or b[0] < a[0]:
        return b
    if a[0] < b[0] or a[1] is b[1]:
        return a
    p, q = first_pieces_apart(a[1], b[1])
    return b if q < p else a


Front = dict[int, tuple[int, Prefix]]


def _inserts(state: int) -> Iterator[tuple[int, int]]:
    """(state, inserts) reachable by inserted rows alone; a third insert would lead back."""
    yield state, 0
    one = FOLLOWS[state]
    yield one, 1
    if FOLLOWS[one] != state:
        yield FOLLOWS[one], 2


def _moves() -> dict[tuple[int, str, int], list[tuple[int, str, int]]]:
    """(state, role initial, fault) -> (next state, piece, cost), for every state and kind of row."""
    table = {}
    for state in STATES:
        for initial in ("s", "u", "a", ""):
            for fault in (0, BLANK, DUPLICATE, TRUNCATED):
                found: dict[int, tuple[int, str]] = {}
                for middle, inserted in _inserts(state):
                    steps = [(middle, DELETE, DELETE_COST)]
                    if fault not in (BLANK, DUPLICATE):
                        dear = TRUNCATED_COST if fault == TRUNCATED else 0
                        steps.append((FOLLOWS[middle], REROLE, REROLE_COST + dear))
                        if initial and (INITIAL[initial] == FOLLOWS[middle] or (initial == "s" and middle == START)):
                            steps.append((INITIAL[initial], KEEP, dear))
                    for to, edit, cost in steps:
                        whole = (cost + INSERT_COST * inserted, INSERT * inserted + edit)
                        found[to] = min(found.get(to, whole), whole)
                table[state, initial, fault] = [(to, piece, cost) for to, (cost, piece) in found.items()]
    return table


MOVES = _moves()


def advance(front: Front, initial: str, fault: int) -> Front:
    """The best prefix of each state after one more row."""
    initial = initial if initial in INITIAL else ""
    out: Front = {}
    for state, (cost, prefix) in front.items():
        for to, piece, more in MOVES[state, initial, fault]:
            held = out.get(to)
            if held is None or cost + more <= held[0]:
                out[to] = least(held, (cost + more, Prefix(prefix, piece)))
    return out


def chain(front: Front, tables: dict[tuple[int, int], tuple[int, str]]) -> Front:
    """The best prefix of each state behind a block of which only the table is known."""
    out: Front = {}
    for (start, end), (more, piece) in tables.items():
        if start in front:
            cost, prefix = front[start]
            out[end] = least(out.get(end), (cost + more, Prefix(prefix, piece)))
    return out


def ending(front: Front) -> tuple[int, Prefix]:
    """The best whole audit: inserts at the end lead to an assistant row."""
    best = None
    for state, (cost, prefix) in front.items():
        inserted = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}[state]
        best = least(best, (cost + INSERT_COST * inserted, Prefix(prefix, INSERT * inserted)))
    return best


# ------------------------------------------------------------------ rows and blocks


@dataclass
class Block:
    """Neighbouring rows of one conversation: (initial, fault) of each, texts, and counts."""

    shapes: list[tuple[str, int]] = field(default_factory=list)
    rows: list[tuple[str, str]] = field(default_factory=list)
    size: int = 0
    faults: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    illegal: int = 0
    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None

    def add(self, role: str, text: str, turn: int | None, fault: int) -> None:
        initial = role[:1]
        if self.shapes and self.shapes[-1][0] + initial not in LEGAL:
            self.illegal += 1
        self.shapes.append((initial, fault))
        # a blank or repeated row is deleted whatever the audit says, its text is not needed again
        self.rows.append((role, text if fault in (0, TRUNCATED) else ""))
        self.size += len(self.rows[-1][1]) + 64
        self.faults[fault] += 1
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn

    def full(self) -> bool:
        return len(self.shapes) >= BLOCK_ROWS or self.size >= BLOCK_BYTES

    def table(self, starts: Iterable[int] = STATES) -> dict[tuple[int, int], tuple[int, str]]:
        out = {}
        for start in starts:
            front: Front = {start: (0, Prefix())}
            for initial, fault in self.shapes:
                front = advance(front, initial, fault)
            out |= {(start, end): (cost, prefix.text()) for end, (cost, prefix) in front.items()}
        return out


class Repaired:
    """Streams rows through an audit into the digest of the repaired conversation."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START
        self.digest, self.any = hashlib.sha256(), False

    def _put(self, role: str, text: str) -> None:
        if self.any:
            self.digest.update(b"\n")
        self.any = True
        self.digest.update(role.encode("utf-8", "surrogatepass"))
        self.digest.update(b":")
        self.digest.update(text.encode("utf-8", "surrogatepass"))

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            self.state = FOLLOWS[self.state]
            self._put(ROLE[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == KEEP:
            self.state = INITIAL[role[:1]]
            self._put(role, text)
        elif edit == REROLE:
            self.state = FOLLOWS[self.state]
            self._put(ROLE[self.state], text)

    def hexdigest(self) -> str:
        self._inserted()
        return self.digest.hexdigest()


@dataclass
class Counts:
    """Counts of a conversation, block by block in order."""

    faults: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    illegal: int = 0
    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    last_initial: str | None = None

    def add(self, b: Block, first: str | None, last: str | None) -> None:
        self.faults = [x + y for x, y in zip(self.faults, b.faults, strict=True)]
        self.illegal += b.illegal
        if first is not None:
            if self.last_initial is not None and self.last_initial + first not in LEGAL:
                self.illegal += 1
            self.last_initial = last
        if b.first_turn is not None:
            self.turns += b.turns - (b.first_turn == self.last_turn)
            self.first_turn = b.first_turn if self.first_turn is None else self.first_turn
            self.last_turn = b.last_turn

    def gaps(self) -> int:
        return 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns


def _outcome(counts: Counts, cost: int, audit: str, digest: str) -> tuple:
    return (counts.gaps(), *counts.faults[1:], counts.illegal, cost, audit, digest)


def finished(block: Block) -> tuple:
    """The outcome of a conversation that is one block."""
    counts = Counts()
    shapes = block.shapes
    counts.add(block, shapes[0][0] if shapes else None, shapes[-1][0] if shapes else None)
    front: Front = {START: (0, Prefix())}
    for initial, fault in shapes:
        front = advance(front, initial, fault)
    cost, prefix = ending(front)
    repaired = Repaired(prefix.text())
    for role, text in block.rows:
        repaired.row(role, text)
    return _outcome(counts, cost, repaired.audit, repaired.hexdigest())


# ------------------------------------------------------------------ tables

OUTCOME = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PAIRS = [(a, b) for a in STATES for b in STATES]
_PART = (
    "part int, block long, texts boolean, roles array<string>, bodies array<string>, costs array<long>, audits array<string>, "
    "faults array<long>, inner_illegal long, turns long, first_turn long, last_turn long, first_initial string, last_initial string"
)


def _lines(frame: pa.RecordBatch) -> Iterator[tuple]:
    yield from zip(*[c.to_pylist() for c in frame.columns], strict=True)


def _arrow(spark_type: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(spark_type))


def faults_of(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, times, first): equal rows as one with their number; whether it is the earliest.

    `first` means that no row of the conversation with this role and text has a smaller turn (NULL is the
    smallest).  Both aggregates combine before their exchange; the join is by conversation, role and text.
    """
    once = rows.groupBy(conv, turn, role, text).agg(F.count_if("present").alias("times"))
    h1, h2 = F.xxhash64(conv, role, text), F.xxhash64(F.lit(1), conv, role, text)
    keyed = once.withColumn("_h1", h1).withColumn("_h2", h2)
    when = F.struct(F.col(turn).isNotNull(), turn)
    earliest = rows.where("present").groupBy(h1.alias("_h1"), h2.alias("_h2")).agg(F.min(when).alias("_least"))
    return (
        keyed.join(earliest, ["_h1", "_h2"], "left")
        .withColumn("first", F.col("_least").eqNullSafe(when))
        .drop("_h1", "_h2", "_least")
    )


def repair(
    rows: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    present: str | None = None,
) -> DataFrame:
    """One row per conversation: its key, counts of faults, the cheapest audit and the repaired digest.

    Rows are taken by turn, NULL first, then role and text.  NULL roles and texts are one blank, which is a
    blank row; conversation NULL is a conversation.  Turns are integers.  Equal rows are duplicates of the
    first.  `present` names a flag of the rows that count (default: all); a conversation without one has zeros, an
    empty audit and the digest of the empty string.  Texts may be of any length, conversations of any number
    of rows; other columns are not looked at.
    """
    space = F.lit(" ")
    plain = rows.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), space).alias("role"),
        F.coalesce(F.col(text), space).alias("text"),
        (F.lit(True) if present is None else F.col(present)).alias("present"),
    )
    last = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    worded = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    fault = F.when(~worded, BLANK).when(~F.col("first"), DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    marked = faults_of(plain, "conv", "turn", "role", "text").select(
        "conv", "turn", "role", "text", fault.alias("fault"), F.col("times").cast("long").alias("times")
    )
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first()]
    cut = [F.substring(c, 1, RANGE_CHARS) for c in ("role", "text")]
    ranged = marked.repartitionByRange(*order, *cut).sortWithinPartitions(*order, "role", "text")

    conv_type = plain.schema["conv"].dataType.simpleString()
    parts_ddl = f"conv {conv_type}, done boolean, {OUTCOME}, {_PART}"
    out_schema_ddl = f"conv {conv_type}, {OUTCOME}"
    parts_schema, out_schema = _arrow(parts_ddl), _arrow(out_schema_ddl)
    n_out, n_part = len(out_schema) - 1, len(parts_schema) - len(out_schema) - 1

    def block_rows(key, part: int, number: int, b: Block) -> Iterator[tuple]:
        head = (key, False, *[None] * n_out, part, number)
        table = b.table()
        yield (
            *head, False, None, None,
            [table[p][0] if p in table else None for p in _PAIRS],
            [table[p][1] if p in table else None for p in _PAIRS],
            b.faults, b.illegal, b.turns, b.first_turn, b.last_turn,
            b.shapes[0][0] if b.shapes else None, b.shapes[-1][0] if b.shapes else None,
        )
        yield (*head, True, [r for r, _ in b.rows], [t for _, t in b.rows], *[None] * (n_part - 5))

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """The rows to hand out: a finished conversation, or blocks of one that may go on in another task."""
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        # the first and the last conversation of a range may have rows in another one
        key, begun, block, number, whole = None, False, Block(), 0, False
        for batch in batches:
            out: list[tuple] = []
            for conv_, turn_, role_, text_, fault_, times in _lines(batch):
                if not begun or conv_ != key:
                    if begun:
                        if whole and number == 0:
                            out.append((key, True, *finished(block), *[None] * n_part))
                        else:
                            out.extend(block_rows(key, part, number, block))
                    key, whole, begun, block, number = conv_, begun, True, Block(), 0
                for n in range(times):
                    block.add(role_, text_, turn_, fault_ if n == 0 or fault_ == BLANK else DUPLICATE)
                    if block.full():
                        out.extend(block_rows(key, part, number, block))
                        block, number = Block(), number + 1
            if out:
                yield out
        if begun:
            yield list(block_rows(key, part, number, block))

    def to_batch(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in conversations(batches):
            yield to_batch(out, parts_schema)

    def by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tables of a conversation come before its texts, both in the order of its rows."""
        key, begun, counts, front, cost, repaired = None, False, Counts(), {}, 0, None

        def closed() -> list[tuple]:
            return [(key, *_outcome(counts, cost, repaired.audit, repaired.hexdigest()))]

        for batch in batches:
            out: list[tuple] = []
            for line in _lines(batch):
                conv_, part = line[0], line[1:]
                if not begun or conv_ != key:
                    if begun:
                        out += closed()
                    key, begun, counts, front, repaired = conv_, True, Counts(), {START: (0, Prefix())}, None
                (_, _, texts, roles, bodies, costs, audits, faults, illegal, turns, first_turn, last_turn, first, last) = part
                if not texts:
                    told = Block(faults=faults, illegal=illegal, turns=turns, first_turn=first_turn, last_turn=last_turn)
                    counts.add(told, first, last)
                    front = chain(
                        front, {p: (c, a) for p, c, a in zip(_PAIRS, costs, audits, strict=True) if c is not None}
                    )
                    continue
                if repaired is None:
                    cost, prefix = ending(front)
                    repaired = Repaired(prefix.text())
                for role_, text_ in zip(roles, bodies, strict=True):
                    repaired.row(role_, text_)
            if out:
                yield to_batch(out, out_schema)
        if begun:
            yield to_batch(closed(), out_schema)

    handed = checkpointed(ranged.mapInArrow(by_range, parts_ddl))
    result = ["conv", *out_schema.names[1:]]
    parts = handed.where("NOT done").repartition("conv").sortWithinPartitions("conv", "texts", "part", "block")
    chained = parts.select("conv", *parts_schema.names[n_out + 2 :]).mapInArrow(by_conversation, out_schema_ddl)
    return handed.where("done").select(*result).unionByName(chained).withColumnRenamed("conv", conv)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with planted faults and `present`, by the CRC-32 of `conv_id:turn` modulo 20.

    0 takes the row out (present is false), 1 empties its text, 2 removes `.`, `!` and `?`, 3 repeats it,
    4 makes its role user.  NULLs of any column are one blank in the key and in role and text.
    """
    space = F.lit(" ")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    times = F.when(kind == 3, 2).otherwise(1)
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(shown("role")).alias("role"),
        text.alias("text"),
        (kind != 0).alias("present"),
        F.explode(F.sequence(F.lit(1), times)).alias("_copy"),
    ).drop("_copy")
