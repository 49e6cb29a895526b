"""Conversation repair as a lightest derivation, found with Knuth's agenda.

An item (i, q) says that the first i turns are dealt with and that the roles written so far have led
to state q.  Deductions turn an item into another one for the price of an edit: keep a turn, give it
the role that is due, delete it, or insert a turn.  A derivation's weight is its cost and its audit,
the initials of its edits; every deduction adds to the cost and appends to the audit, so weights only
grow (the functions are superior), and an item popped from the agenda with the least (cost, audit) is
final.  The goal is an item of all turns in an accepting state; the agenda stops when it is popped.
Two derivations of one item with the same cost are never prefixes of each other, so their order
stands whatever follows.

Turns are sorted by ranges of (conversation, turn), so a conversation may reach over many tasks.  A
task solves the conversations that are its own.  Others are cut into blocks of bounded size; a block
gives the lightest derivation from every state to every state, and the blocks of a conversation are
put together in order.  Texts are never gathered: the digest of a repaired conversation streams
through its blocks.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from codemem.llm.common import SPACE_BYTES, arrow_type, stored

# Turns, and characters of text, after which a block is closed.
BLOCK_TURNS = 512
BLOCK_CHARS = 1 << 20

# Prices of the edits and of a truncated turn that stays; states of the role pattern.
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
ACCEPTING = (START, AFTER_ASSISTANT)
NEXT = {
    (START, "s"): AFTER_SYSTEM, (START, "u"): AFTER_USER, (AFTER_SYSTEM, "u"): AFTER_USER,
    (AFTER_USER, "a"): AFTER_ASSISTANT, (AFTER_ASSISTANT, "u"): AFTER_USER,
}
NAMES = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = ("su", "ua", "au")


def _due(state: int) -> str:
    """The role that a turn may be given in a state."""
    return "a" if state == AFTER_USER else "u"


def lightest(initials: list[str], faults: list[str], start: int = START, goals: tuple[int, ...] | None = ACCEPTING) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the lightest derivation of all turns, by the state it ends in.

    With ``goals`` the agenda stops at the first item of a goal, the lightest of them; without, every
    state that can be reached is given.  Faults are ``b``, ``d``, ``t`` or empty.
    """
    n, final, ends = len(initials), set(), {}
    agenda = [(0, "", 0, start)]
    while agenda:
        cost, audit, i, q = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        final.add((i, q))
        if i == n:
            ends[q] = (cost, audit)
            if goals and q in goals:
                return {q: ends[q]}
        moves = [(INSERT, "I", i, NEXT[q, _due(q)])]
        if i < n:
            fault = faults[i]
            moves.append((DELETE, "D", i + 1, q))
            if fault not in ("b", "d"):
                stays = CUT_OFF if fault == "t" else 0
                moves.append((REROLE + stays, "R", i + 1, NEXT[q, _due(q)]))
                if (q, initials[i]) in NEXT:
                    moves.append((KEEP + stays, "K", i + 1, NEXT[q, initials[i]]))
        for price, edit, j, p in moves:
            if (j, p) not in final:
                heapq.heappush(agenda, (cost + price, audit + edit, j, p))
    return ends


def edited(roles: list[str], texts: list[str], audit: str, state: int = START) -> list[dict]:
    """The turns that the edits of an audit give: ``edit, role, text``; deleted ones are left out."""
    out, i = [], 0
    for edit in audit:
        due = _due(state)
        if edit == "I":
            out.append({"edit": edit, "role": NAMES[due], "text": ""})
        else:
            if edit == "K":
                due = roles[i][:1]
                out.append({"edit": edit, "role": roles[i], "text": texts[i]})
            elif edit == "R":
                out.append({"edit": edit, "role": NAMES[due], "text": texts[i]})
            i += 1
        if edit != "D":
            state = NEXT[state, due]
    return out


# ---- blocks ---------------------------------------------------------------------------

COUNTS = ("blank", "duplicate", "truncated", "illegal")
BLOCKS = (
    "conv_id long, task long, seq long, closed boolean, n_turns long, blank long, duplicate long, truncated long, illegal long, "
    "first string, last string, least long, most long, different long, cost long, audit string, "
    "ways array<struct<p:int,q:int,cost:bigint,audit:string>>, roles array<string>, texts array<string>, "
    "lines array<struct<edit:string,role:string,text:string>>"
)


def faulty(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text, lost)`` with ``fault``: blank, duplicate, truncated or nothing."""
    same = Window.partitionBy("conv_id", "lost", "role", F.md5("text")).orderBy(F.col("turn").asc_nulls_first())
    inside = F.rtrim("text", F.lit(SPACE_BYTES.decode()))
    fault = F.when(inside == "", "b").when(F.col("nth") > 1, "d").when(~F.right(inside, F.lit(1)).isin(".", "!", "?"), "t").otherwise("")
    return rows.withColumn("nth", F.row_number().over(same)).withColumn("fault", fault)


class _Open:
    """The turns of a conversation that a task has read and not yet passed on."""

    def __init__(self, conv_id):
        self.conv_id, self.passed = conv_id, False
        self.clear()

    def clear(self) -> None:
        self.roles, self.texts, self.faults, self.turns, self.chars = [], [], [], [], 0

    def add(self, turn, role, text, fault) -> None:
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault)
        self.turns.append(turn)
        self.chars += len(role) + len(text)

    def full(self, turns: int) -> bool:
        return len(self.roles) >= turns or self.chars >= BLOCK_CHARS

    def block(self, task: int, seq: int, closed: bool) -> dict:
        initials = [r[:1] for r in self.roles]
        turns = [t for t in self.turns if t is not None]
        row = {
            "conv_id": self.conv_id, "task": task, "seq": seq, "closed": closed, "n_turns": len(initials),
            "blank": self.faults.count("b"), "duplicate": self.faults.count("d"), "truncated": self.faults.count("t"),
            "illegal": sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:])),
            "first": initials[0] if initials else None, "last": initials[-1] if initials else None,
            "least": min(turns, default=None), "most": max(turns, default=None), "different": len(set(turns)),
        }
        if closed:
            (cost, audit), = lightest(initials, self.faults).values()
            row |= {"cost": cost, "audit": audit, "lines": edited(self.roles, self.texts, audit)}
        else:
            ways = [(p, q, *end) for p in range(4) for q, end in lightest(initials, self.faults, p, None).items()]
            row |= {"ways": [dict(zip(("p", "q", "cost", "audit"), w)) for w in ways], "roles": self.roles, "texts": self.texts}
        self.clear()
        self.passed = True
        return row


def blocks(rows: DataFrame, turns: int = BLOCK_TURNS) -> DataFrame:
    """Conversations solved in one task (``closed``), and blocks of those at the borders of tasks or beyond a block's size."""
    schema = arrow_type(BLOCKS)
    key = ["conv_id", "turn", "role", F.left("text", F.lit(32))]
    ordered = faulty(rows).repartitionByRange(*key).sortWithinPartitions(*key[:3], "text", "nth")

    def run(batches):
        task, seq, now, first, out, size = TaskContext.get().partitionId(), 0, None, True, [], 0
        for batch in batches:
            for conv_id, turn, role, text, lost, fault in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        # Only the first and the last conversation of a task can go on in another one.
                        out.append(now.block(task, seq, closed=not first and not now.passed))
                        seq, first = seq + 1, False
                    now = _Open(conv_id)
                if not lost:
                    now.add(turn, role, text, fault)
                    if now.full(turns):
                        out.append(now.block(task, seq, closed=False))
                        seq += 1
                size += 1 + len(text)
                if size >= BLOCK_CHARS and out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, size = [], 0
        if now is not None:
            out.append(now.block(task, seq, closed=False))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return stored(ordered.select("conv_id", "turn", "role", "text", "lost", "fault").mapInArrow(run, BLOCKS), "repair-blocks")


# ---- conversations over several blocks ------------------------------------------------

REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
PIECES = "task long, seq long, state int, piece string"
JOINED = f"{REPORT}, pieces array<struct<task:bigint,seq:bigint,state:int,piece:string>>"


class _Joined:
    """Lightest derivations of the blocks read so far, by the state they end in."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.best = {START: (0, "", None)}
        self.counts = dict.fromkeys(COUNTS, 0)
        self.last = self.least = self.most = None
        self.different = 0

    def add(self, block: dict) -> None:
        for name in COUNTS:
            self.counts[name] += block[name]
        if block["n_turns"]:
            if self.last is not None:
                self.counts["illegal"] += self.last + block["first"] not in LEGAL_PAIRS
            self.last = block["last"]
        if block["least"] is not None:
            self.different += block["different"] - (self.most == block["least"])
            self.least = block["least"] if self.least is None else min(self.least, block["least"])
            self.most = block["most"]
        found = {}
        for way in block["ways"]:
            if way["p"] in self.best:
                cost, audit, path = self.best[way["p"]]
                x = (cost + way["cost"], audit + way["audit"], (path, block["task"], block["seq"], way["p"], way["audit"]))
                if way["q"] not in found or x[:2] < found[way["q"]][:2]:
                    found[way["q"]] = x
        self.best = found

    def row(self) -> dict:
        # Turns may still be wanted at the very end.
        ends = [(cost + c, audit + a, path, a) for q, (cost, audit, path) in self.best.items() for c, a in lightest([], [], q).values()]
        cost, audit, path, extra = min(ends, key=lambda e: e[:2])
        pieces = []
        while path is not None:
            path, task, seq, state, piece = path
            pieces.append({"task": task, "seq": seq, "state": state, "piece": piece + extra})
            extra = ""
        gaps = self.most - self.least + 1 - self.different if self.least is not None else 0
        return {"conv_id": self.conv_id, "gaps": gaps, **self.counts, "cost": cost, "audit": audit, "pieces": pieces}


def _by_conversation(rows: DataFrame, begin, add, end, ddl: str) -> DataFrame:
    """Streams the rows of each conversation, in order, through ``begin(conv_id)``, ``add(x, row)`` and ``end(x)``."""
    schema = arrow_type(ddl)

    def run(batches):
        now, conv = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if now is None or row["conv_id"] != conv:
                    if now is not None:
                        yield pa.RecordBatch.from_pylist([end(now)], schema=schema)
                    conv = row["conv_id"]
                    now = begin(conv)
                add(now, row)
        if now is not None:
            yield pa.RecordBatch.from_pylist([end(now)], schema=schema)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "task", "seq").mapInArrow(run, ddl)


def solved(conversations: DataFrame, turns: int = BLOCK_TURNS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations solved in one task; reports of the others; and the repaired turns of those, in blocks.

    ``conversations(conv_id, turn, role, text, lost)``: no role and no text is null; a lost turn only says
    that its conversation exists.
    """
    found = blocks(conversations, turns)
    closed, open_ = found.where("closed"), found.where("not closed")
    joined = stored(_by_conversation(open_.drop("roles", "texts", "lines"), _Joined, _Joined.add, _Joined.row, JOINED), "repair-joined")
    pieces = joined.select(F.explode("pieces").alias("x")).select("x.*")

    @F.udf(found.schema["lines"].dataType)
    def lines(roles, texts, piece, state):
        return edited(roles, texts, piece, state)

    rest = open_.drop("lines").join(pieces, ["task", "seq"])
    return closed, joined.drop("pieces"), rest.select("conv_id", "task", "seq", lines("roles", "texts", "piece", "state").alias("lines"))


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired turns: ``conv_id, task, seq, place, edit, role, text``; (task, seq, place) is their order."""
    closed, _, rest = solved(conversations)
    lines = closed.select("conv_id", "task", "seq", "lines").union(rest)
    return lines.select("conv_id", "task", "seq", F.posexplode("lines").alias("place", "x")).select("conv_id", "task", "seq", "place", "x.*")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the planted faults, by crc32 of ``conv_id:turn`` modulo 20; nulls are one space."""
    blank = F.lit(" ")
    as_text = lambda name: F.coalesce(F.col(name).cast("string"), blank)
    kind = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn"))) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), as_text("role").alias("role"), as_text("text").alias("text"), kind.alias("kind")
    )
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("lost"), "kind")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def report(conversations: DataFrame, turns: int = BLOCK_TURNS) -> DataFrame:
    """Per conversation: faults after the planted damage, cost and audit of the repair, digest of its result.

    Null ids are one conversation; null turns come first and make no gap; a null role or text is one
    space.  Turns of the same number are ordered by role and text; a repeated row is a duplicate.  A role
    without a character cannot be kept, for it has no initial.  Empty texts are blank; long ones are
    whole.  A conversation that lost all turns has zeros, an empty audit and the digest of nothing.  No
    rows give no rows.  Further columns are not read, so their names cannot clash.
    """
    closed, joined, rest = solved(damaged(conversations), turns)
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("different"), F.lit(0).cast("long"))
    lines = F.transform("lines", lambda turn: F.concat(turn["role"], F.lit(":"), turn["text"]))
    digest = F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256")
    whole = closed.select("conv_id", gaps.alias("gaps"), *COUNTS, "cost", "audit", digest)

    def take(state, row):
        for turn in row["lines"]:
            state[1].update(("" if state[2] else "\n").encode() + f"{turn['role']}:{turn['text']}".encode())
            state[2] = False

    # One digest runs through all blocks of a conversation, in order, and holds one block at a time.
    digests = _by_conversation(
        rest, lambda conv: [conv, hashlib.sha256(), True], take,
        lambda state: {"id": state[0], "repaired_sha256": state[1].hexdigest()}, "id long, repaired_sha256 string",
    )
    return whole.union(joined.join(digests, F.col("conv_id").eqNullSafe(F.col("id"))).drop("id"))
