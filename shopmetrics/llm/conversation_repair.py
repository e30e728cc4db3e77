"""Cheapest structural repair of conversations by Four-Russians block tables (operator 12).

A conversation is a string of row symbols (role initial, truncated or not, or "must go"). What the rest of it costs at
least, given what has been written so far (nothing, a system turn, a user turn, an assistant turn), is a vector of four
numbers. Less its last entry, such a vector is one of a small fixed set, so the step over any block of ``BLOCK`` symbols
is a table look-up: from the vector behind the block to the one before it and what is added. Blocks are looked up from
the end of the conversation to its begin; each is then expanded backward once more, step by step, from the vector behind it,
and the edits are read off from the front, the ASCII-least of those that keep the cost.

Rows are dealt in ranges of (conversation, turn), so a conversation of any length is spread over tasks. What lies
wholly inside a range is done there. The others are cut into chunks, each with the look-up of the whole chunk for
every vector; these are chained per conversation, which is narrow work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import materialize, shuffle_width

BLOCK = 4
SYMBOLS = 9  # 4 role initials, the same truncated, and a row that must go
GONE = 8
CHUNK_BYTES = 1 << 20

# Costs of the edits, and what a truncated row adds that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
INITIALS = "sua"
LEGAL = {(0, 1), (1, 2), (2, 1)}

# What has been written: nothing, system, user, assistant (a pair is complete). The state a further turn leads to, and its role.
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
AT_END = (0, 2 * INSERT, INSERT, 0)
KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}  # (state, initial): the state if the row is kept


def _choices(symbol: int, state: int, behind: tuple[int, ...]) -> list[tuple[str, int, int]]:
    """(edit, cost of it and of all behind it, state after it) for one row, without insertions, in ASCII order."""
    found = [("D", DELETE + behind[state], state)]
    if symbol != GONE:
        more = TRUNCATED * (symbol >= 4)
        if (to := KEPT.get((state, symbol % 4))) is not None:
            found.append(("K", KEEP + more + behind[to], to))
        found.append(("R", REROLE + more + behind[NEXT[state]], NEXT[state]))
    return found


def _before(symbol: int, behind: tuple[int, ...]) -> tuple[int, ...]:
    """The cost vector before a row, from the one behind it; turns may be inserted before the row."""
    plain = [min(c for _, c, _ in _choices(symbol, state, behind)) for state in range(4)]
    user, assistant = min(plain[2], INSERT + plain[3]), min(plain[3], INSERT + plain[2])
    return min(plain[0], INSERT + user), min(plain[1], INSERT + user), user, assistant


@lru_cache(maxsize=1)
def tables() -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All normalised vectors (the first is the one at the end), the step of one symbol and that of a block.

    A step is (vector, symbol or block) -> vector, and the same -> what the normalisation took off. The first
    symbol of a block is the lowest digit of its number.
    """
    vectors = [AT_END]
    number = {AT_END: 0}
    step, added = [], []
    for vector in vectors:  # grows as it runs, until no new vector appears
        to, by = [], []
        for symbol in range(SYMBOLS):
            raw = _before(symbol, vector)
            normal = tuple(c - raw[3] for c in raw)
            if normal not in number:
                number[normal] = len(vectors)
                vectors.append(normal)
            to.append(number[normal])
            by.append(raw[3])
        step.append(to)
        added.append(by)
    one, one_by = np.array(step, np.int32), np.array(added, np.int32)
    block = np.arange(SYMBOLS**BLOCK)
    at = np.repeat(np.arange(len(vectors), dtype=np.int32)[:, None], len(block), axis=1)
    by = np.zeros_like(at)
    for k in reversed(range(BLOCK)):
        symbol = block // SYMBOLS**k % SYMBOLS
        by += one_by[at, symbol]
        at = one[at, symbol]
    return vectors, one, one_by, at, by


def _numbers(symbols: bytes) -> tuple[list[int], bytes]:
    """The whole blocks of a symbol string as numbers, and the symbols behind them."""
    whole = len(symbols) // BLOCK * BLOCK
    digits = np.frombuffer(symbols[:whole], np.uint8).reshape(-1, BLOCK).astype(np.int64)
    return (digits @ (SYMBOLS ** np.arange(BLOCK, dtype=np.int64))).tolist(), symbols[whole:]


def whole_step(symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The look-up of a whole chunk: for each vector behind it the one before it, and what is added."""
    vectors, one, one_by, many, many_by = tables()
    at = np.arange(len(vectors), dtype=np.int32)
    by = np.zeros(len(vectors), np.int64)
    blocks, rest = _numbers(symbols)
    for symbol in reversed(rest):
        by += one_by[at, symbol]
        at = one[at, symbol]
    for block in reversed(blocks):
        by += many_by[at, block]
        at = many[at, block]
    return at, by


@lru_cache(maxsize=1 << 16)
def _expand(symbols: bytes, behind: int, state: int) -> tuple[str, int]:
    """The edits of a block, and the state behind it: its vectors are computed backward, its edits read from the front."""
    vectors = [tables()[0][behind]]
    for symbol in reversed(symbols):
        vectors.append(_before(symbol, vectors[-1]))
    edits = []
    for symbol, before, after in zip(symbols, reversed(vectors[1:]), reversed(vectors[:-1])):
        while True:
            options = {edit: (cost, to) for edit, cost, to in _choices(symbol, state, after)}
            options["I"] = (INSERT + before[NEXT[state]], NEXT[state])
            edit = min(e for e, (cost, _) in options.items() if cost == before[state])
            state = options[edit][1]
            edits.append(edit)
            if edit != "I":
                break
    return "".join(edits), state


def trace(symbols: bytes, behind: int, state: int) -> tuple[str, int]:
    """Edits of a chunk, given the vector behind it and the state before it; and the state behind it."""
    _, one, _, many, _ = tables()
    blocks, rest = _numbers(symbols)
    pieces = [symbols[k : k + BLOCK] for k in range(0, BLOCK * len(blocks), BLOCK)]
    ends = []
    at = behind
    for symbol in reversed(rest):
        at = int(one[at, symbol])
    for block in reversed(blocks):
        ends.append(at)
        at = int(many[at, block])
    edits = []
    for piece, end in zip(pieces, reversed(ends)):
        found, state = _expand(piece, end, state)
        edits.append(found)
    if rest:
        found, state = _expand(rest, behind, state)
        edits.append(found)
    return "".join(edits), state


class _Repaired:
    """The hash over the repaired turns and the audit, fed in order."""

    def __init__(self):
        self.sha, self.audit, self.state, self.any = hashlib.sha256(), [], 0, False

    def _write(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any = True

    def feed(self, edits: str, roles: list[str], texts: list[str]) -> None:
        self.audit.append(edits)
        row = 0
        for edit in edits:
            if edit == "I" or edit == "R":
                self.state = NEXT[self.state]
                self._write(ROLE[self.state], texts[row] if edit == "R" else "")
            elif edit == "K":
                self.state = KEPT[self.state, INITIALS.find(roles[row][:1])]
                self._write(roles[row], texts[row])
            row += edit != "I"

    def close(self) -> tuple[str, str]:
        self.feed("I" * (AT_END[self.state] // INSERT), [], [])
        return "".join(self.audit), self.sha.hexdigest()


def damage(df: DataFrame, parts: int = 20) -> DataFrame:
    """Planted faults: by crc32 of ``conv_id:turn`` modulo ``parts``, 0 drops a row, 1 empties its text, 2 removes its
    ``.!?``, 3 repeats it, 4 makes it the user's. Nulls read as one space (a null turn keeps its place as null).

    Adds ``gone`` (dropped; the row stays as a mark of its conversation) and ``copy`` (0, or 1 for a repetition).
    """
    space = F.lit(" ")
    spot = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fate = F.crc32(spot.cast("binary")) % parts
    text, role = F.coalesce(F.col("text").cast("string"), space), F.coalesce(F.col("role").cast("string"), space)
    out = df.select("conv_id", "turn", fate.alias("fate"), role.alias("role"), text.alias("text"))
    out = out.withColumn("text", F.when(F.col("fate") <= 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    out = out.withColumn("role", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.select("conv_id", "turn", "role", "text", (F.col("fate") == 0).alias("gone"), F.explode(copies).alias("copy"))


def mark_faults(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) with ``initial``, ``fault`` (0 none, 1 blank, 2 duplicate, 3 truncated) and ``at``.

    Of rows of one conversation with one role and text all but the first by turn (nulls first) are duplicates. The first is
    found by an aggregate that combines per map task, and met again by its row number, so many equal rows are no hot key.
    """
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    initial = F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.substring("role", 1, 1)), F.lit(0)) - 1, F.lit(3))
    initial = F.when(F.col("role") == "", 3).otherwise(initial).cast("int")
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    seen = rows.select("conv_id", "turn", "role", "text", "gone", initial.alias("initial"), last.alias("last"), same.alias("same"))
    seen = materialize(seen.withColumn("at", F.monotonically_increasing_id()), "conversation-rows")
    firsts = seen.where("not gone").groupBy("conv_id", "same").agg(F.min(F.struct("turn", "at")).alias("first"))
    seen = seen.join(firsts.select(F.col("first.at").alias("at"), F.lit(True).alias("new")), "at", "left")
    fault = F.when(F.col("gone"), 0).when(F.col("last") == "", 1).when(F.col("new").isNull(), 2).when(~F.col("last").isin(".", "!", "?"), 3).otherwise(0)
    return seen.select("conv_id", "turn", "role", "text", "gone", "initial", fault.alias("fault"), "at")


COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")


class _Chunk:
    """Rows of one conversation, or a part of it, in order."""

    def __init__(self, before: tuple[int, int | None] | None = None):
        self.roles, self.texts, self.symbols, self.bytes = [], [], bytearray(), 0
        self.count = dict.fromkeys(COUNTS, 0)
        self.first = self.last = None  # (initial, turn) of the first and last row
        self.low = self.high = None

    def add(self, row: dict) -> None:
        if row["gone"]:
            return
        here = (row["initial"], row["turn"])
        if self.last is None:
            self.first = here
            self.count["turns"] += here[1] is not None
        else:
            self.join_on(here)
        self.last = here
        if here[1] is not None:
            self.low, self.high = here[1] if self.low is None else self.low, here[1]
        fault = row["fault"]
        if fault:
            self.count[COUNTS[fault]] += 1
        self.count["rows"] += 1
        must_go = fault in (1, 2)
        self.symbols.append(GONE if must_go else row["initial"] + 4 * (fault == 3))
        self.roles.append(row["role"])
        self.texts.append("" if must_go else row["text"])
        self.bytes += 64 + len(self.texts[-1])

    def join_on(self, here: tuple[int, int | None]) -> None:
        self.count["illegal"] += (self.last[0], here[0]) not in LEGAL
        self.count["turns"] += here[1] is not None and here[1] != self.last[1]


def _result(count: dict, low: int | None, high: int | None, cost: int, audit: str, sha: str) -> list:
    gaps = 0 if low is None else high - low + 1 - count["turns"]
    return [gaps, count["blank"], count["duplicate"], count["truncated"], count["illegal"], cost, audit, sha]


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
RESULT_TYPES = [pa.int64()] * 6 + [pa.string()] * 2
RESULT_SCHEMA = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The cheapest repair of each conversation: conv_id, counts of faults, cost, audit and the hash of what it becomes.

    ``rows``: conv_id, turn, role, text (no nulls in the last two), gone. Rows are taken by turn, nulls first, then by
    role, text. A null conv_id is a conversation too; one whose rows are all gone has zeros, an empty audit and the hash of
    the empty text; an empty table gives an empty result. Edits: Keep 0, Rerole 1, Delete 2 (blank and duplicate rows
    must go), Insert an empty turn 5; a truncated row that stays adds 5. Roles go by their initials, which read
    ``(s?(ua)+)?`` in the end. Of equally cheap edits the ASCII-least string is taken.

    A hash over a whole conversation has to be fed in order: the repaired turns of a conversation that spans ranges pass
    through one task, a chunk of ``chunk_bytes`` at a time. Nothing else of it does.
    """
    spark = rows.sparkSession
    kind = rows.schema["conv_id"].dataType.simpleString()
    width = shuffle_width(spark)
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("at")]
    dealt = mark_faults(rows).withColumn("turn", F.col("turn").cast("long")).repartitionByRange(width, *order).sortWithinPartitions(*order)

    counts = [f"n_{name}" for name in COUNTS]
    parts = ["part", "chunk", "done", *counts, "first_initial", "first_turn", "last_initial", "last_turn", "low", "high", "symbols", "roles", "texts", "step", "added"]
    part_types = [pa.int32(), pa.int32(), pa.bool_()] + [pa.int64()] * 12 + [pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    part_schema = "part int, chunk int, done boolean, " + ", ".join(f"{c} long" for c in parts[3:15]) + ", symbols binary, roles array<string>, texts array<string>, step array<int>, added array<long>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        vectors, *_ = tables()
        out: list[list] = []
        kinds: list = []
        sent = 0

        def finished(conv, chunk: _Chunk) -> list:
            step, added = whole_step(bytes(chunk.symbols))
            cost = int(added[0] + vectors[step[0]][0])
            text = _Repaired()
            text.feed(trace(bytes(chunk.symbols), 0, 0)[0], chunk.roles, chunk.texts)
            return [conv, here, 0, True, *[None] * 17, *_result(chunk.count, chunk.low, chunk.high, cost, *text.close())]

        def piece(conv, chunk: _Chunk) -> list:
            nonlocal sent
            sent += 1
            step, added = whole_step(bytes(chunk.symbols))
            ends = [*(chunk.first or (None, None)), *(chunk.last or (None, None)), chunk.low, chunk.high]
            return [conv, here, sent, False, *chunk.count.values(), *ends, bytes(chunk.symbols), chunk.roles, chunk.texts, step.tolist(), added.tolist(), *[None] * 8]

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out), [kinds[0], *part_types, *RESULT_TYPES])]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["conv_id", *parts, *RESULT])

        now, chunk, inside = None, None, False  # inside: the conversation began behind another one, and none of it was sent
        held = 0
        for batch in batches:
            kinds[:] = [batch.schema.field("conv_id").type]
            for row in batch.to_pylist():
                if chunk is None or row["conv_id"] != now:
                    if chunk is not None:
                        out.append(finished(now, chunk) if inside else piece(now, chunk))
                        held += chunk.bytes
                    inside = chunk is not None
                    now, chunk = row["conv_id"], _Chunk()
                elif chunk.bytes >= chunk_bytes:
                    out.append(piece(now, chunk))
                    held += chunk.bytes
                    inside, chunk = False, _Chunk()
                chunk.add(row)
                if len(out) >= 1000 or held >= 4 * chunk_bytes:
                    yield flush()
                    held = 0
        if chunk is not None:  # the next range may go on with it
            out.append(piece(now, chunk))
        if out:
            yield flush()

    found = dealt.select("conv_id", "turn", "role", "text", "gone", "initial", "fault").mapInArrow(cut, f"conv_id {kind}, {part_schema}, {RESULT_SCHEMA}")
    found = materialize(found, "conversation-parts")
    chunks = found.where("not done")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From the last chunk of a conversation to its first: the vector behind each, and the cost from its begin on."""
        vectors, *_ = tables()
        now, begun, at, cost = None, False, 0, 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not begun or row["conv_id"] != now:
                    now, begun, at, cost = row["conv_id"], True, 0, 0
                behind = at
                cost += row["added"][at]
                at = row["step"][at]
                out.append((row["part"], row["chunk"], behind, cost + vectors[at][0]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32(), pa.int32(), pa.int32(), pa.int64()])], ["part", "chunk", "behind", "cost_from"]) if out else batch.slice(0, 0).select(["part", "chunk"]).append_column("behind", pa.array([], pa.int32())).append_column("cost_from", pa.array([], pa.int64()))

    narrow = chunks.select("conv_id", "part", "chunk", "step", "added").repartition(width, "conv_id")
    narrow = narrow.sortWithinPartitions("conv_id", F.desc("part"), F.desc("chunk"))
    behind = materialize(narrow.mapInArrow(chain, "part int, chunk int, behind int, cost_from long"), "conversation-vectors")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The chunks of a conversation in order: edits by the vector behind each, hash and counts over all."""
        now, total, text, cost, kept = None, None, None, 0, None

        def line() -> pa.RecordBatch:
            values = [now, *_result(total.count, total.low, total.high, cost, *text.close())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [kept, *RESULT_TYPES])], ["conv_id", *RESULT])

        for batch in batches:
            kept = batch.schema.field("conv_id").type
            for row in (r for k in range(len(batch)) for r in batch.slice(k, 1).to_pylist()):
                if total is None or row["conv_id"] != now:
                    if total is not None:
                        yield line()
                    now, total, text, cost = row["conv_id"], _Chunk(), _Repaired(), row["cost_from"]
                for name in COUNTS:
                    total.count[name] += row[f"n_{name}"]
                if row["n_rows"]:
                    if total.last is not None:  # the first turn of a chunk was counted as a new one
                        total.count["turns"] -= row["first_turn"] is not None
                        total.join_on((row["first_initial"], row["first_turn"]))
                    total.last = (row["last_initial"], row["last_turn"])
                    total.low = row["low"] if total.low is None else total.low
                    total.high = row["high"] if row["high"] is not None else total.high
                    text.feed(trace(row["symbols"], row["behind"], text.state)[0], row["roles"], row["texts"])
        if total is not None:
            yield line()

    joined = chunks.join(behind, ["part", "chunk"]).select("conv_id", "part", "chunk", *counts, "first_initial", "first_turn", "last_initial", "last_turn", "low", "high", "symbols", "roles", "texts", "behind", "cost_from")
    joined = joined.repartition(width, "conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    spread = joined.mapInArrow(write, f"conv_id {kind}, {RESULT_SCHEMA}")
    return found.where("done").select("conv_id", *RESULT).unionByName(spread)


def repair_conversations(df: DataFrame) -> DataFrame:
    """The repair of rows as they are: nulls of role and text read as one space, no row is dropped."""
    space = F.lit(" ")
    plain = df.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"), F.lit(False).alias("gone"))
    return repair(plain)
