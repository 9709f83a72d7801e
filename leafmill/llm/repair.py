"""Conversation structure repair: damage by a hash, faults, and the cheapest edits that make turns alternate.

The edits of a conversation are a path through a DAG: layers of rows, with a node for each state
of the wanted order of roles. The weight of a path is one integer: its cost in the high digits,
below them the letters of its edits as digits from the left, and zeros to a fixed width at the
end. The smallest integer is the cheapest path and, of equal ones, the one whose letters come
first in ASCII: a missing letter is less than any. One ordinary minimum decides everything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from leafmill.llm.schemas import schema
from leafmill.llm.scratch import Scratch
from leafmill.llm.worker import release

#: Rows of a conversation that are decided together; longer ones are blocks that are joined.
BLOCK = 256
LETTERS = "DIKR"  # in ASCII order: digits 1 to 4; 0 is no letter
KEEP, RETAG, DELETE, INSERT, OPEN_END = 0, 2, 3, 2, 1
#: Nothing yet, after system, after user, after assistant; the order (s?(ua)+)? ends at nothing or after assistant.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
FINAL = (START, ASSISTANT)
NAMES = {USER: "user", ASSISTANT: "assistant"}
BITS = 3

LEGAL = ("su", "ua", "au")
_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_BLOCKS = "turn long, role string, digest binary, seq long, turns long, first_turn long, last_turn long, blank long, duplicate long, truncated long, illegal long, first string, last string, ways array<struct<a:int,b:int,cost:long,audit:string>>"
_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Weights:
    """Integers for paths of at most width letters."""

    def __init__(self, width: int):
        self.size = BITS * width
        self.low = (1 << self.size) - 1
        self.letter = {c: (i + 1) << (self.size - BITS) for i, c in enumerate(LETTERS)}

    def before(self, letter: str, cost: int, rest: int) -> int:
        """A path's weight with a letter put before it: all others move one digit to the right, and zeros are left at the end."""
        return (cost << self.size) + (rest & ~self.low) + self.letter[letter] + ((rest & self.low) >> BITS)

    def cost(self, weight: int) -> int:
        return weight >> self.size

    def audit(self, weight: int) -> str:
        digits = oct((weight & self.low) | (1 << self.size))[3:].rstrip("0")
        return digits.translate(str.maketrans("1234", LETTERS))


def ways(rows: list[tuple[str, bool, bool]]) -> dict[tuple[int, int], tuple[int, str]]:
    """Least cost and letters from each state before rows to each state after them, where there is a way.

    rows: role's initial, whether the row must go, whether its text ends open. Letters tell
    how many rows they take, so no way is the beginning of an equally cheap one: ways of
    blocks can be put together, and of equal sums the smallest letters are the smallest.
    """
    out = {}
    w = Weights(3 * len(rows) + 2)
    for end in STATES:
        best: dict[int, int] = {end: 0}
        for initial, gone, open_end in reversed(rows):
            best = _inserted(best, w)
            now: dict[int, int] = {}
            for at in STATES:
                found = [w.before("D", DELETE, best[at])] if at in best else []
                if not gone:
                    for name, to in NEXT[at].items():
                        if to in best:
                            if name == initial:
                                found.append(w.before("K", KEEP + open_end, best[to]))
                            if to != SYSTEM:
                                found.append(w.before("R", RETAG + open_end, best[to]))
                if found:
                    now[at] = min(found)
            best = now
        for at, weight in _inserted(best, w).items():
            out[at, end] = w.cost(weight), w.audit(weight)
    return out


def _inserted(best: dict[int, int], w: Weights) -> dict[int, int]:
    """best with rows inserted before; between any two states at most two are worth it."""
    for _ in range(2):
        found = dict(best)
        for at in STATES:
            for to in NEXT[at].values():
                if to != SYSTEM and to in best:
                    weight = w.before("I", INSERT, best[to])
                    found[at] = min(found.get(at, weight), weight)
        best = found
    return best


class Joined:
    """Ways from the start over block after block; what all of them share goes to done."""

    def __init__(self):
        self.done: list[str] = []
        self.live: dict[int, tuple[int, str]] = {START: (0, "")}

    def add(self, block: list[dict]) -> None:
        now: dict[int, tuple[int, str]] = {}
        for way in block:
            if way["a"] in self.live:
                cost, audit = self.live[way["a"]]
                cost += way["cost"]
                if way["b"] not in now or cost <= now[way["b"]][0]:
                    found = (cost, audit + way["audit"])
                    now[way["b"]] = min(now.get(way["b"], found), found)
        shared = commonprefix([audit for _, audit in now.values()])
        self.done.append(shared)
        self.live = {s: (cost, audit[len(shared) :]) for s, (cost, audit) in now.items()}

    def end(self) -> tuple[int, str]:
        cost, audit = min(self.live[s] for s in FINAL if s in self.live)
        return cost, "".join(self.done) + audit


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and n (copies, 0: dropped) of each row, changed by crc32(conv_id:turn) % 20; nulls count as one space, but in conv_id and turn they stay."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(fate == 1, F.lit("")).when(fate == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(fate == 4, F.lit("user")).otherwise(space("role"))
    n = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    return rows.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), n.cast("long").alias("n"))


def _arrow(conv: pa.DataType) -> pa.Schema:
    way = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    numbers = [(c, pa.int64()) for c in ("turns", "first_turn", "last_turn", *_COUNTS)]
    return pa.schema([("conv_id", conv), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()), ("seq", pa.int64()), *numbers, ("first", pa.string()), ("last", pa.string()), ("ways", pa.list_(way))])


def _blocked(size: int):
    """Blocks of each conversation from sorted rows: what lies in one task, size rows at a time, named by its first row."""

    def made(key, seq, name, rows):
        """rows: turn, role's initial, blank, copy, ends open."""
        pairs = [a[1] + b[1] for a, b in zip(rows, rows[1:], strict=False)]
        stamps = [r[0] for r in rows if r[0] is not None]
        counts = (*(sum(r[k] for r in rows) for k in (2, 3, 4)), sum(p not in LEGAL for p in pairs))
        found = ways([(r[1], r[2] or r[3], r[4]) for r in rows])
        return {
            "conv_id": key, "turn": name[0], "role": name[1], "digest": name[2], "seq": seq, "turns": len(set(stamps)), "first_turn": min(stamps, default=None), "last_turn": max(stamps, default=None),
            **dict(zip(_COUNTS, counts, strict=True)), "first": rows[0][1], "last": rows[-1][1], "ways": [{"a": a, "b": b, "cost": cost, "audit": audit} for (a, b), (cost, audit) in found.items()],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        key, name, held, out, seq, kind = None, None, [], [], 0, None
        for batch in batches:
            kind = _arrow(batch.schema.field("conv_id").type)
            for conv_id, turn, role, digest, blank, open_end, n, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k in range(n):
                    if held and (conv_id != key or len(held) == size):
                        out.append(made(key, seq, name, held))
                        held, seq = [], seq + 1
                    if not held:
                        key, name = conv_id, (turn, role, digest)
                    copy = not blank and not (first and k == 0)
                    held.append((turn, role[:1], blank, copy, open_end and not copy))
            yield pa.RecordBatch.from_pylist(out, kind)
            out = []
        if held:
            yield pa.RecordBatch.from_pylist([made(key, seq, name, held)], kind)

    return run


class _Conversation:
    """One conversation of the last pass: its blocks come first, then its rows with their texts, in order."""

    def __init__(self, conv_id):
        self.conv_id, self.joined = conv_id, Joined()
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.turns, self.low, self.high, self.last = 0, None, None, None
        self.digest, self.audit, self.at, self.state, self.lines = hashlib.sha256(), None, 0, START, 0

    def block(self, b: dict) -> None:
        self.joined.add(b["ways"])
        for c in _COUNTS:
            self.counts[c] += b[c]
        if self.last is not None:
            self.counts["illegal"] += self.last + b["first"] not in LEGAL
        self.last = b["last"]
        if b["first_turn"] is not None:
            self.turns += b["turns"] - (b["first_turn"] == self.high)  # a turn may run over a block's end
            self.low = b["first_turn"] if self.low is None else self.low
            self.high = b["last_turn"]

    def _line(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1
        self.state = next(s for name, s in NEXT[self.state].items() if name == role[0])

    def _insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self._line(NAMES[self._due()], "")

    def _due(self) -> int:
        """The state after a user or an assistant at this place."""
        return next(s for s in NEXT[self.state].values() if s != SYSTEM)

    def row(self, role: str, text: str, n: int) -> None:
        if self.audit is None:
            self.cost, self.audit = self.joined.end()
        for _ in range(n):
            self._insert()
            letter = self.audit[self.at]
            self.at += 1
            if letter == "K":
                self._line(role, text)
            elif letter == "R":
                self._line(NAMES[self._due()], text)

    def end(self) -> dict:
        if self.audit is None:
            self.cost, self.audit = self.joined.end()
        self._insert()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"conv_id": self.conv_id, "gaps": gaps, **self.counts, "cost": self.cost, "audit": self.audit, "repaired_sha256": self.digest.hexdigest()}


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    now, kind = None, None
    for batch in batches:
        names = ("gaps", *_COUNTS, "cost")
        kind = pa.schema([("conv_id", batch.schema.field("conv_id").type), *[(c, pa.int64()) for c in names], ("audit", pa.string()), ("repaired_sha256", pa.string())])
        out = []
        for conv_id, block, role, text, n in zip(*(batch.column(c) for c in ("conv_id", "block", "role", "text", "n")), strict=True):
            conv_id = conv_id.as_py()
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    out.append(now.end())
                now = _Conversation(conv_id)
            if block.is_valid:
                now.block(block.as_py())
            elif n.as_py():
                now.row(role.as_py(), text.as_py(), n.as_py())
        yield pa.RecordBatch.from_pylist(out, kind)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.end()], kind)


def repair_conversations(rows: DataFrame, damage: bool = True, block: int = BLOCK) -> DataFrame:
    """A report for each conversation (conv_id) of rows (conv_id, turn, role, text), damaged first if asked for.

    Rows of a conversation are taken by turn, nulls first; rows of one turn by role and the
    MD5 of their text, so equal ones stand together. Columns: gaps (turns missing between the
    first and the last), blank, duplicate (same role and text seen earlier), truncated (last
    character is no end of a sentence) by each row's first fault, illegal (neighbours that
    don't alternate), cost and audit of the cheapest edits (K, R, D, I), repaired_sha256.

    Equal rows are counted, not moved, and repeats are found by aggregation. Rows without
    their texts are then sorted by range over all tasks, so a conversation of any length lies
    in many; each block of its rows becomes the cheapest ways between the states before and
    after it. Blocks, and then texts, of a conversation stream through one task: its digest
    is one chain over all its text, which no other order of work can give. A task keeps the
    letters of one conversation and no texts.

    Nulls in role and text are one space, which is blank and no role; in conv_id they are a
    conversation, in turn they come first. An empty role has no initial and can't be kept.
    Conversations of which nothing is left have zeros and an empty audit. An empty table
    gives no rows. Other columns are not read.
    """
    scratch = Scratch(rows.sparkSession, "repair")
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    read = rows.select("conv_id", "turn", "role", "text")
    read = damaged(read) if damage else read.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), F.lit(1).cast("long").alias("n"))
    read = read.withColumn("digest", F.unhex(F.md5("text")))

    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    open_end = ~blank & ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    key = ["conv_id", "turn", "role", "digest"]
    narrow = read.where("n > 0").select(*key, blank.alias("blank"), open_end.alias("open_end"), "n")
    once = scratch.keep(narrow.groupBy(*key).agg(F.sum("n").alias("n"), F.first("blank").alias("blank"), F.first("open_end").alias("open_end")), "once")
    at = F.struct(F.col("turn").isNotNull(), "turn")  # a null turn comes first
    seen = once.where("not blank").groupBy("conv_id", "role", "digest").agg(F.min(at).alias("o"), F.count(F.lit(1)).alias("c")).where("c > 1")
    seen = seen.select(F.col("conv_id").alias("c1"), F.col("role").alias("c2"), F.col("digest").alias("c3"), "o")
    same = F.col("conv_id").eqNullSafe(F.col("c1")) & (F.col("role") == F.col("c2")) & (F.col("digest") == F.col("c3"))
    marked = once.join(seen, same, "left").select(*key, "blank", "open_end", "n", (F.col("o").isNull() | (F.col("o") == at)).alias("first"))
    marked = scratch.keep(marked, "marked")
    scratch.drop(once)

    conv = rows.schema["conv_id"]
    parts = marked.repartitionByRange(*key).sortWithinPartitions(*key)
    blocks = scratch.keep(parts.mapInArrow(_blocked(block), schema(conv, _BLOCKS)), "blocks")
    scratch.drop(marked)
    inner = ("turns", "first_turn", "last_turn", *_COUNTS, "first", "last", "ways")
    ahead = blocks.select(*key, "seq", F.struct(*inner).alias("block"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n"))
    texts = read.select(*key, F.lit(None).cast("long").alias("seq"), F.lit(None).cast(ahead.schema["block"].dataType).alias("block"), "text", "n")
    stream = ahead.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", F.col("block").isNull(), "turn", "role", "digest", "seq")
    return stream.select("conv_id", "block", "role", "text", "n").mapInArrow(_repaired, schema(conv, _REPORT))
