"""Repair of conversation structure by an audit: the cheapest edits, and among those the first in order.

The rows of a conversation are read once, in order. A dynamic programme over (row, role expected
next) keeps in every cell the cheapest prefix of edits; prefixes are shared as linked nodes, so a
cell costs one node. Equal costs are settled by the order of the edit strings: two prefixes are
compared by a search for their longest common prefix over binary-lifting ancestors and rolling
hashes, and what the hashes say is verified node by node.

Rows are dealt by ranges of their order, so a long conversation spreads over tasks. A task solves a
conversation that lies within it; of others it gives pieces: for each role expected before, the
cheapest edits to each role expected after. Pieces are put together in order, by the same nodes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import SPACE_CHARS, bounded_batches, col, materialise

#: Rows, and characters of text, of a conversation that a task holds at a time.
ROWS, CHARS = 4_096, 8_000_000
#: Costs of edits, and what a truncated row that stays adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: What the roles so far ask for: nothing seen, after the system turn, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The role that may follow (beside a first system turn), by state; and the state it leads to.
FOLLOWS = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
_BASE, _MOD = 1_000_003, (1 << 61) - 1
#: Begins a label that stands for a whole piece; not part of the string.
MARK = "."


# ---- edit strings as linked nodes -----------------------------------------


class Trail:
    """Strings that share prefixes: a node is a string one label longer than its parent's.

    Node 0 is the empty string. ``up[v][k]`` is the ancestor 2**k above v, ``hash[v]`` the rolling
    hash of the labels from the root. A label is one character, or ``MARK`` and any string.
    """

    def __init__(self):
        self.label, self.depth, self.hash, self.up = [""], [0], [0], [[]]

    def add(self, parent: int, label: str) -> int:
        lifts, k = [parent], 0
        while k < len(self.up[lifts[k]]):
            lifts.append(self.up[lifts[k]][k])
            k += 1
        code = ord(label) if len(label) == 1 else hash_of(label)
        self.label.append(label)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * _BASE + code) % _MOD)
        self.up.append(lifts)
        return len(self.label) - 1

    def ancestor(self, v: int, depth: int) -> int:
        climb = self.depth[v] - depth
        while climb:
            k = climb.bit_length() - 1
            v = self.up[v][k]
            climb -= 1 << k
        return v

    def fork(self, a: int, b: int) -> tuple[int, int]:
        """The first nodes below the longest common prefix of a and b, (x, x) where one is a prefix of the other."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        top = x
        if self.hash[x] == self.hash[y]:
            up_x, up_y = x, y
            x = y = top
        else:
            for k in range(len(self.up[x]) - 1, -1, -1):
                if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                    x, y = self.up[x][k], self.up[y][k]
            up_x, up_y = self.up[x][0], self.up[y][0]
        while up_x != up_y:  # equal hashes may stand for different labels: the topmost difference counts
            if self.label[up_x] != self.label[up_y]:
                x, y = up_x, up_y
            up_x, up_y = self.up[up_x][0], self.up[up_y][0]
        return x, y

    def less(self, a: int, b: int) -> bool:
        """Whether a's string comes before b's in the order of their characters."""
        if a == b:
            return False
        x, y = self.fork(a, b)
        if x == y:
            return self.depth[a] < self.depth[b]
        p, q = self.label[x], self.label[y]
        if p.startswith(q) or q.startswith(p):  # long labels: what follows decides
            return "".join(self.labels(a, self.depth[x] - 1)) < "".join(self.labels(b, self.depth[y] - 1))
        return p < q

    def labels(self, v: int, above: int = 0) -> list[str]:
        """The labels of v's string that lie deeper than ``above``, without marks."""
        out = []
        while self.depth[v] > above:
            out.append(self.label[v].removeprefix(MARK))
            v = self.up[v][0]
        return out[::-1]


def hash_of(label: str) -> int:
    code = 7
    for character in label:
        code = (code * _BASE + ord(character)) % _MOD
    return code


# ---- the programme --------------------------------------------------------


def _offer(trail: Trail, cells: list, state: int, cost: int, parent: int, label: str) -> None:
    held = cells[state]
    if held is None or cost < held[0]:
        cells[state] = (cost, parent, label)
    elif cost == held[0]:
        new, old = trail.add(parent, label), trail.add(held[1], held[2])
        if trail.less(new, old):
            cells[state] = (cost, parent, label)


def _settle(trail: Trail, cells: list) -> list:
    return [None if c is None else (c[0], trail.add(c[1], c[2])) for c in cells]


def _inserted(trail: Trail, cells: list) -> list:
    """Cells after insertions; two in a row suffice, as a third would be back at the same role."""
    for target, sources in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
        best = cells[target]
        for state in sources:
            if cells[state] is None:
                continue
            cost = cells[state][0] + INSERT
            if best is None or cost < best[0]:
                best = (cost, trail.add(cells[state][1], "I"))
            elif cost == best[0]:
                node = trail.add(cells[state][1], "I")
                if trail.less(node, best[1]):
                    best = (cost, node)
        cells = [best if k == target else c for k, c in enumerate(cells)]
    return cells


def edited(trail: Trail, cells: list, rows: list[tuple[str, str]]) -> list:
    """Cells (cost, node) by state after ``rows`` of (role initial, fault), insertions after each included."""
    for initial, fault in rows:
        new = [None] * 4
        for state, cell in enumerate(cells):
            if cell is None:
                continue
            cost, node = cell
            _offer(trail, new, state, cost + DELETE, node, "D")
            if fault in ("blank", "duplicate"):
                continue
            kept = cost + (TRUNCATED if fault == "truncated" else 0)
            follows = FOLLOWS[state]
            if initial == "s" and state == START:
                _offer(trail, new, SYSTEM, kept + KEEP, node, "K")
            if initial == ("u" if follows == USER else "a"):
                _offer(trail, new, follows, kept + KEEP, node, "K")
            else:
                _offer(trail, new, follows, kept + REROLE, node, "R")
        cells = _inserted(trail, _settle(trail, new))
    return cells


def cheapest(trail: Trail, cells: list) -> tuple[int, int]:
    """Cost and node of the best cell that a repaired conversation may end in."""
    ends = [c for c in (cells[START], cells[ASSISTANT]) if c is not None]
    best = ends[0]
    for cell in ends[1:]:
        if cell[0] < best[0] or (cell[0] == best[0] and trail.less(cell[1], best[1])):
            best = cell
    return best


class Repaired:
    """The repaired turns, by applying edits in order."""

    def __init__(self):
        self.state = START

    def apply(self, edits: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
        for edit in edits:
            if edit == "I":
                self.state = FOLLOWS[self.state]
                yield NAMES[self.state], ""
                continue
            role, text = next(rows)
            if edit == "R":
                role = NAMES[FOLLOWS[self.state]]
            if edit != "D":
                self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
                yield role, text


# ---- damage and faults ----------------------------------------------------


def damage(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows damaged by the checksum of ``conv_id:turn``: one in 20 each is dropped, emptied, loses its
    marks of sentence ends, is repeated or becomes a user's. Nulls are one space. A dropped row
    stays as a ``gone`` one, so that its conversation is known."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(col(conv_id).cast("string"), blank), F.lit(":"), F.coalesce(col(turn).cast("string"), blank))
    kind = F.crc32(key.cast("binary")) % 20
    plain = rows.select(
        col(conv_id).cast("long").alias("conv_id"), col(turn).cast("long").alias("turn"),
        F.coalesce(col(role), blank).alias("role"), F.coalesce(col(text), blank).alias("text"), kind.alias("kind"),
    )
    gone = F.col("kind") == 0
    return plain.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, "").when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(gone | (F.col("kind") == 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"), gone.alias("gone"),
    )


def faults(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies, gone) in single copies, with each row's first fault.

    Order is by turn, nulls first, then role, then text; what is alike in all three is copies of one
    row. Copies are counted before anything is shuffled.
    """
    keys = ["conv_id", "turn", "role", "text", "gone"]
    counted = rows.groupBy(*keys).agg(F.sum("copies").alias("copies"))
    said = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("said")
    counted = counted.select("*", said)
    # texts that a conversation has once, the usual case, need no look-up of where they came first
    first = counted.groupBy("conv_id", "said").agg(
        F.count("*").alias("places"), F.min("turn").alias("turn"), F.max(F.col("turn").isNull()).alias("unknown"),
    ).filter("places > 1").select(
        F.col("conv_id").alias("first_conv"), F.col("said").alias("first_said"), F.col("turn").alias("first_turn"), F.col("unknown").alias("first_unknown"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("first_conv")) & (F.col("said") == F.col("first_said"))
    placed = counted.join(first, same, "left")
    later = F.col("first_said").isNotNull() & F.when(F.col("first_unknown"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first_turn"))
    single = placed.select(
        *keys, later.alias("later"), F.explode(F.when(F.col("gone"), F.array(F.lit(1).cast("long"))).otherwise(F.sequence(F.lit(1).cast("long"), F.col("copies")))).alias("copy")
    )
    return single.select(*keys, "copy", fault_of(F.col("text"), F.col("later") | (F.col("copy") > 1)).alias("fault"))


def fault_of(text: Column, repeated: Column) -> Column:
    tail = F.right(F.btrim(text, F.lit(SPACE_CHARS)), F.lit(1))
    return F.when(tail == "", "blank").when(repeated, "duplicate").when(~tail.isin(".", "!", "?"), "truncated")


# ---- pieces ---------------------------------------------------------------

COUNTS = ["blank", "duplicate", "truncated", "illegal"]
ORDER = ["turn", "role", "text", "copy"]
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_WAYS = pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))
_FIELDS = {
    "conv_id": ("long", pa.int64()), "open": ("boolean", pa.bool_()), "part": ("long", pa.int64()),
    "turn": ("long", pa.int64()), "role": ("string", pa.string()), "text": ("string", pa.string()), "copy": ("long", pa.int64()),
    **{name: ("long", pa.int64()) for name in COUNTS}, "gaps": ("long", pa.int64()),
    "initials": ("array<string>", pa.list_(pa.string())), "turns": ("array<long>", pa.list_(pa.int64())),
    "cost": ("long", pa.int64()), "audit": ("string", pa.string()), "edits": ("string", pa.string()),
    "repaired": ("array<struct<role: string, text: string>>", _TURNS),
    "ways": ("array<struct<before: int, after: int, cost: long, edits: string>>", _WAYS),
}
RECORD = ", ".join(f"{name} {kind}" for name, (kind, _) in _FIELDS.items())
RESULT = ["conv_id", "open", "part", "gaps", *COUNTS, "cost", "audit", "repaired"]


def _record(rows: list[dict]) -> pa.RecordBatch:
    columns = [pa.array([r.get(name) for r in rows], kind) for name, (_, kind) in _FIELDS.items()]
    return pa.RecordBatch.from_arrays(columns, names=list(_FIELDS))


def gaps_of(turns: list[int]) -> int:
    """Turns missing between the smallest and the largest, from those and the number of distinct ones."""
    return turns[1] - turns[0] + 1 - turns[2] if turns else 0


class Piece:
    """A run of rows of one conversation, in order, as a task meets them."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.rows, self.chars = conv_id, [], 0

    def take(self, gone: bool, turn, role, text, copy, fault) -> None:
        if not gone:
            self.rows.append((turn, role, text, copy, fault))
            self.chars += len(text)

    @property
    def full(self) -> bool:
        return len(self.rows) >= ROWS or self.chars >= CHARS

    def symbols(self) -> list[tuple[str, str | None]]:
        return [(r[1][:1], r[4]) for r in self.rows]

    def facts(self) -> dict:
        """Counts that add up over pieces, and what their edges need."""
        out = {name: sum(r[4] == name for r in self.rows) for name in COUNTS[:3]}
        initials = [r[1][:1] for r in self.rows]
        turns = [r[0] for r in self.rows if r[0] is not None]
        out["illegal"] = sum(x + y not in LEGAL for x, y in zip(initials, initials[1:], strict=False))
        out["initials"] = [initials[0], initials[-1]] if initials else []
        out["turns"] = [turns[0], turns[-1], len(set(turns))] if turns else []
        return {"conv_id": self.conv_id, **out}

    def solved(self) -> dict:
        trail = Trail()
        begin = _inserted(trail, [(0, 0), None, None, None])
        cost, node = cheapest(trail, edited(trail, begin, self.symbols()))
        audit = "".join(trail.labels(node))
        turns = Repaired().apply(audit, ((r[1], r[2]) for r in self.rows))
        facts = self.facts()
        return facts | {
            "open": False, "part": 0, "gaps": gaps_of(facts["turns"]), "cost": cost, "audit": audit,
            "repaired": [{"role": r, "text": t} for r, t in turns],
        }

    def ways(self) -> dict:
        """A piece of an open conversation: the cheapest edits between any two states."""
        out = []
        for before in range(4):
            trail = Trail()
            cells = [(0, 0) if k == before else None for k in range(4)]
            for after, cell in enumerate(edited(trail, cells, self.symbols())):
                if cell is not None:
                    out.append({"before": before, "after": after, "cost": cell[0], "edits": "".join(trail.labels(cell[1]))})
        first = dict(zip(ORDER, self.rows[0][:4], strict=True)) if self.rows else {}
        return self.facts() | {"open": True, "ways": out, **first}


def solve_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of one range of rows in order: solved, or in pieces where the range or a piece ends within one."""
    held: Piece | None = None
    edge = True  # the conversation may have begun before what is held
    for batch in batches:
        out = []
        for conv_id, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is None or held.conv_id != conv_id:
                if held is not None:
                    out.append(held.ways() if edge else held.solved())
                    edge = False
                held = Piece(conv_id)
            elif held.full:
                out.append(held.ways())
                held, edge = Piece(conv_id), True
            held.take(*row)
        if out:
            yield _record(out)
    if held is not None:
        yield _record([held.ways()])


class Pieces:
    """The pieces of one open conversation, put together in order."""

    def __init__(self):
        self.pieces, self.trail = [], Trail()
        lead = Trail()
        cells = _inserted(lead, [(0, 0), None, None, None])
        self.cells = [None if c is None else (c[0], self.trail.add(0, MARK + "".join(lead.labels(c[1])))) for c in cells]

    def take(self, piece: dict) -> None:
        new = [None] * 4
        for way in piece["ways"]:
            cell = self.cells[way["before"]]
            if cell is not None:
                _offer(self.trail, new, way["after"], cell[0] + way["cost"], cell[1], MARK + way["edits"])
        self.cells = _settle(self.trail, new)
        self.pieces.append({name: piece[name] for name in ("conv_id", *ORDER, *COUNTS, "initials", "turns")})

    def finish(self) -> list[dict]:
        """The pieces with their edits; the first has the conversation's totals and first insertions."""
        cost, node = cheapest(self.trail, self.cells)
        lead, *chosen = self.trail.labels(node)
        edges = [p["initials"] for p in self.pieces if p["initials"]]
        turns = [p["turns"] for p in self.pieces if p["turns"]]
        total = {name: sum(p[name] for p in self.pieces) for name in COUNTS}
        total["illegal"] += sum(x[1] + y[0] not in LEGAL for x, y in zip(edges, edges[1:], strict=False))
        twice = sum(x[1] == y[0] for x, y in zip(turns, turns[1:], strict=False))
        total["gaps"] = gaps_of([turns[0][0], turns[-1][1], sum(t[2] for t in turns) - twice] if turns else [])
        out = [{n: p[n] for n in ("conv_id", *ORDER)} | {"open": True, "edits": e} for p, e in zip(self.pieces, chosen, strict=True)]
        out[0] |= total | {"cost": cost, "audit": lead + "".join(chosen), "edits": lead + chosen[0]}
        return out


def join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of their conversations: each with its chosen edits.

    Holds the edit strings of one conversation's pieces, sixteen a piece at most.
    """
    now, held = None, None
    for batch in batches:
        out = []
        for piece in batch.to_pylist():
            if now != (piece["conv_id"],):
                out += held.finish() if held else []
                now, held = (piece["conv_id"],), Pieces()
            held.take(piece)
        if out:
            yield _record(out)
    if held:
        yield _record(held.finish())


def apply_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of open conversations in order, each piece before its rows: the repaired turns in parts."""
    now, part, repaired, edits, chars = None, {}, None, iter(()), 0
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if now != (row["conv_id"],):
                if now is not None:
                    out.append(part)
                now, repaired, chars = (row["conv_id"],), Repaired(), 0
                part = {"conv_id": row["conv_id"], "open": True, "part": 0, "repaired": [], **{n: row[n] for n in (*COUNTS, "gaps", "cost", "audit")}}
            if row["edits"] is not None:
                first = re.match("I*", row["edits"])[0]
                edits = iter(re.findall("[DKR]I*", row["edits"]))
                turns = repaired.apply(first, iter(()))
            else:
                turns = repaired.apply(next(edits), iter([(row["role"], row["text"])]))
            for role, text in turns:
                part["repaired"].append({"role": role, "text": text})
                chars += len(text)
            if len(part["repaired"]) >= ROWS or chars >= CHARS:
                out.append(part)
                part, chars = {"conv_id": row["conv_id"], "open": True, "part": part["part"] + 1, "repaired": []}, 0
        if out:
            yield _record(out)
    if now is not None:
        yield _record([part])


# ---- the operator ---------------------------------------------------------


def _first(*names: str) -> list[Column]:
    return [F.col(n).asc_nulls_first() for n in names]


def repair_conversations(rows: DataFrame) -> DataFrame:
    """The audit and the repaired turns of every conversation.

    ``rows`` has conv_id, turn, role and text, and may have ``copies`` (a row that stands for
    several) and ``gone`` (a row that is no turn, but whose conversation is reported). Rows are
    read by turn (nulls first), then role, then text. Each row's first fault counts: blank (only
    white space), duplicate (role and text seen earlier in the conversation), truncated (the last
    character that is no white space is not one of ``.!?``).

    Returns ``conv_id``, ``open``, ``part``, ``gaps``, ``blank``, ``duplicate``, ``truncated``,
    ``illegal`` (neighbouring role initials other than su, ua, au), ``cost``, ``audit`` and
    ``repaired`` (role, text). A conversation that is not ``open`` is one row; an open one, which lay
    across ranges or is very long, is one row for each ``part`` of its turns, and the first has the
    counts. Null ids are one conversation; null roles and texts are one space. A conversation
    without turns has zeros, an empty audit and no turns. Other columns are not returned.
    """
    bounded_batches(rows.sparkSession)
    has = set(rows.columns)
    blank = F.lit(" ")
    plain = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
        (F.col("copies") if "copies" in has else F.lit(1)).cast("long").alias("copies"),
        (F.col("gone") if "gone" in has else F.lit(False)).alias("gone"),
    )
    order = [*_first("conv_id"), F.col("gone").desc(), *_first(*ORDER)]
    names = ["conv_id", "gone", *ORDER, "fault"]
    ranged = faults(plain).select(*names).repartitionByRange(*order).sortWithinPartitions(*order)
    found = materialise(ranged.mapInArrow(solve_ranges, RECORD), "conversations")

    pieces = found.filter("open").repartition("conv_id").sortWithinPartitions(*_first("conv_id", *ORDER))
    edits = materialise(pieces.mapInArrow(join_pieces, RECORD), "conversation-edits").withColumn("kind", F.lit(0))
    ids = edits.select(F.col("conv_id").alias("open_id")).distinct()
    again = plain.filter("NOT gone").join(ids, F.col("conv_id").eqNullSafe(F.col("open_id")), "left_semi")
    turns = faults(again).select("conv_id", *ORDER, F.lit(1).alias("kind"))
    stream = edits.unionByName(turns, allowMissingColumns=True)
    stream = stream.repartition("conv_id").sortWithinPartitions(*_first("conv_id", *ORDER, "kind")).drop("kind")
    opened = stream.select(*_FIELDS).mapInArrow(apply_edits, RECORD)
    return found.filter("NOT open").select(*RESULT).unionByName(opened.select(*RESULT))


def digests(parts: DataFrame) -> DataFrame:
    """``conv_id`` and ``repaired_sha256`` of open conversations: a hash that reads one part after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            for conv_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (conv_id,):
                    if now is not None:
                        done.append((now[0], state.hexdigest()))
                    now, state, empty = (conv_id,), hashlib.sha256(), True
                if text is not None:
                    state.update(("" if empty else "\n").encode() + text.encode())
                    empty = False
            yield _digests(done)
            done = []
        if now is not None:
            yield _digests([(now[0], state.hexdigest())])

    texts = parts.select("conv_id", "part", F.when(F.size("repaired") > 0, spelt(F.col("repaired"))).alias("text"))
    ordered = texts.repartition("conv_id").sortWithinPartitions(*_first("conv_id", "part")).select("conv_id", "text")
    return ordered.mapInArrow(run, "conv_id long, repaired_sha256 string")


def _digests(done: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["conv_id", "repaired_sha256"]
    )


def spelt(turns: Column) -> Column:
    """Turns as ``role:text``, joined by newlines."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def conversation_report(repaired: DataFrame) -> DataFrame:
    """One row for each conversation of ``repair_conversations``, with the SHA-256 of its repaired turns."""
    columns = ["conv_id", "gaps", *COUNTS, "cost", "audit"]
    closed = repaired.filter("NOT open").select(*columns, F.sha2(spelt(F.col("repaired")), 256).alias("repaired_sha256"))
    opened = materialise(repaired.filter("open"), "open-conversations")
    known = opened.filter("part = 0").select(*columns).join(digests(opened).withColumnRenamed("conv_id", "id"), F.col("conv_id").eqNullSafe(F.col("id")))
    return closed.unionByName(known.drop("id"))
