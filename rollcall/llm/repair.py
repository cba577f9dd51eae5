"""Conversation structure repair with Four-Russians block tables.

Every row is kept, given another role, or deleted, and empty user or assistant rows may be inserted, so that the
roles read ``(s?(ua)+)?``. A row is one of nine symbols (must go, or its role's initial with or without a cut end),
and what is left to pay from each of the four states of that language is a *cost vector*. Differences within a vector
are bounded, so normalised vectors (less their smallest entry) are few.

- ``Tables`` finds all normalised vectors and, for every one of them and every block of ``BLOCK`` symbols, the vector
  before the block and what was subtracted. Rows are processed from the last to the first, a block at a lookup.
- Tracing goes forwards. A block is expanded backwards into the vectors at its rows; at each row the first letter in
  ASCII order that lies on a cheapest way is taken. A letter leads to one state only, so the audit is the least of all
  cheapest ones.

Spreading. Rows are range-partitioned by conversation and place, so that a huge conversation lies in many partitions.
Conversations inside one partition are finished there. Those at its edges, or too large to hold, are written as open
rows and finished in pieces: a piece of at most ``PIECE`` rows is mapped from *every* normalised vector at once; pieces
of a conversation are chained backwards (vectors), traced from all four states in parallel, chained forwards (states)
and traced once more. Only the digest of a conversation's repaired text runs through all its rows in order, as a
stream: a hash cannot be split.

Faults: blank (no character besides ASCII white space), then duplicate (role and text of an earlier row), then
truncated (the last such character is none of ``.!?``). Rows go by turn (nulls first); of equal turns by role, the
first 32 code points and the SHA-256 of the text.

Defined cases: null roles and texts are one space (so a null text is blank, and a null role is no role); null conversation
ids are one conversation; repeated rows are duplicates; a conversation without rows left has zeros, an empty audit
and the hash of nothing; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, partitions, rows, stored, worker_state

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
# states: nothing yet, after s, after u, after a; the role each of them waits for, and the state it leads to
WAITS, AFTER, NAMES = "uuau", (2, 2, 3, 2), {"u": "user", "a": "assistant"}
ENDS = (True, False, False, True)
SYMBOLS, BLOCK = 9, 4
PIECE, HELD_CHARS = 1 << 20, 4 << 20
REPORT = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
          "repaired_sha256 string")


def symbol(initial: str, must_go: bool, cut: bool) -> int:
    return 0 if must_go else 1 + "sua?".index(initial if initial and initial in "sua" else "?") + 4 * cut


def follow(state: int, initial: str) -> int | None:
    """The state after a row that keeps this initial."""
    if initial == "s":
        return 1 if state == 0 else None
    return AFTER[state] if initial == WAITS[state] else None


def closed(costs: list[int]) -> tuple[int, ...]:
    """Costs that allow for inserted rows."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[AFTER[s]]) for s, c in enumerate(costs)]
    return tuple(costs)


def before(costs: tuple[int, ...], sym: int) -> tuple[int, ...]:
    """What is left to pay before a row, from what is left after it."""
    out, extra = [DELETE + c for c in costs], CUT * (sym > 4)
    if sym:
        for s in range(4):
            kept = follow(s, "sua?"[(sym - 1) % 4])
            if kept is not None:
                out[s] = min(out[s], KEEP + extra + costs[kept])
            out[s] = min(out[s], REROLE + extra + costs[AFTER[s]])
    return closed(out)


class Tables:
    """All normalised cost vectors; transitions of single symbols and of blocks."""

    def __init__(self):
        end = closed([0 if e else 1 << 20 for e in ENDS])
        self.vectors, number, steps, shifts = [end], {end: 0}, [], []
        for v in self.vectors:                          # grows until no new vector turns up
            steps.append([])
            shifts.append([])
            for sym in range(SYMBOLS):
                made = before(v, sym)
                low = min(made)
                made = tuple(c - low for c in made)
                if made not in number:
                    number[made] = len(self.vectors)
                    self.vectors.append(made)
                steps[-1].append(number[made])
                shifts[-1].append(low)
        self.step, self.shift = np.array(steps, np.int32), np.array(shifts, np.int32)
        self.block, self.block_shift = np.arange(len(steps), dtype=np.int32)[:, None], np.zeros((len(steps), 1), np.int32)
        for _ in range(BLOCK):                          # one more symbol in front: the most significant digit of a code
            size = self.block.shape[1]
            more = self.block_shift[:, :, None] + self.shift[self.block]
            self.block = self.step[self.block].transpose(0, 2, 1).reshape(-1, SYMBOLS * size)
            self.block_shift = more.transpose(0, 2, 1).reshape(-1, SYMBOLS * size)
        self._expanded: dict = {}

    def blocks(self, syms: np.ndarray) -> tuple[list[int], list[int]]:
        """Codes of the full blocks, and the symbols after them."""
        n = len(syms) // BLOCK * BLOCK
        codes = syms[:n].reshape(-1, BLOCK).astype(np.int64) @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))
        return codes.tolist(), syms[n:].tolist()

    def carry(self, syms: np.ndarray) -> np.ndarray:
        """The vector before these symbols, for every vector after them."""
        codes, tail = self.blocks(syms)
        now = np.arange(len(self.vectors), dtype=np.int32)
        for s in reversed(tail):
            now = self.step[now, s]
        for c in reversed(codes):
            now = self.block[now, c]
        return now

    def trace(self, syms: np.ndarray, right: int, state: int, last: bool) -> tuple[str, int]:
        """The edits of these rows and the state after them; with the rows that must still follow at the end."""
        codes, tail = self.blocks(syms)
        now, tails = right, []
        for s in reversed(tail):
            tails.append((now, s))
            now = int(self.step[now, s])
        edges = []
        for c in reversed(codes):
            edges.append((now, c))
            now = int(self.block[now, c])
        out = []
        for after, code in reversed(edges):
            letters, state = self._expand(after, code, BLOCK, state)
            out.append(letters)
        for after, s in reversed(tails):
            letters, state = self._expand(after, s, 1, state)
            out.append(letters)
        while last and not ENDS[state]:
            out.append("I")
            state = AFTER[state]
        return "".join(out), state

    def _expand(self, after: int, code: int, length: int, state: int) -> tuple[str, int]:
        key = after, code, length, state
        if key not in self._expanded:
            syms = [code // SYMBOLS ** i % SYMBOLS for i in range(length - 1, -1, -1)]
            numbers = [after]
            for s in reversed(syms):
                numbers.append(int(self.step[numbers[-1], s]))
            letters = []
            for s, number in zip(syms, numbers[-2::-1]):
                behind = self.vectors[number]
                here, extra = before(behind, s), CUT * (s > 4)
                while here[state] != DELETE + behind[state] and here[state] == INSERT + here[AFTER[state]]:
                    letters.append("I")
                    state = AFTER[state]
                kept = follow(state, "sua?"[(s - 1) % 4]) if s else None
                if here[state] == DELETE + behind[state]:
                    letters.append("D")
                elif kept is not None and here[state] == KEEP + extra + behind[kept]:
                    letters.append("K")
                    state = kept
                else:
                    letters.append("R")
                    state = AFTER[state]
            self._expanded[key] = "".join(letters), state
        return self._expanded[key]


def tables() -> Tables:
    state = worker_state()
    if "block_tables" not in state:
        state["block_tables"] = Tables()
    return state["block_tables"]


class Report:
    """What is returned of a conversation, from its rows in order and the edits; holds no row."""

    def __init__(self, conv_id):
        self.conv_id, self.counts, self.cost = conv_id, dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0), 0
        self.low = self.turn = self.initial = None
        self.turns, self.state, self.lines, self.audit, self.sha = 0, 0, 0, [], hashlib.sha256()

    def _line(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) * (self.lines > 0)}{role}:{text}".encode("utf-8", "replace"))
        self.lines += 1

    def insert(self) -> None:
        self.audit.append("I")
        self.cost += INSERT
        self._line(NAMES[WAITS[self.state]], "")
        self.state = AFTER[self.state]

    def row(self, turn, role: str, text: str, blank: bool, sym: int, letters: Iterator[str]) -> None:
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.initial = initial
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.turn, self.turns = turn, self.turns + 1
        if not sym or sym > 4:
            self.counts["blank" if blank else "truncated" if sym else "duplicate"] += 1
        letter = next(letters)
        while letter == "I":
            self.insert()
            letter = next(letters)
        self.audit.append(letter)
        if letter == "D":
            self.cost += DELETE
            return
        self.cost += CUT * (sym > 4) + (REROLE if letter == "R" else KEEP)
        self._line(NAMES[WAITS[self.state]] if letter == "R" else role, text)
        self.state = AFTER[self.state] if letter == "R" else follow(self.state, initial)

    def rest(self, letters: Iterator[str]) -> None:
        for _ in letters:
            self.insert()

    def result(self) -> tuple:
        gaps = self.turn - self.low + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.counts.values(), self.cost, "".join(self.audit), self.sha.hexdigest())


# ---------------------------------------------------------------- rows of a conversation

def finished(conv_id, held: list[tuple]) -> tuple:
    """The report of a conversation that is held whole."""
    seen, syms, report = set(), [], Report(conv_id)
    held = [r for r in held if r[0] is not None]
    for _, _, role, text, blank, cut in held:
        syms.append(symbol(role[:1], blank or (role, text) in seen, cut))
        seen.add((role, text))
    letters = iter(tables().trace(np.array(syms, np.uint8), 0, 0, True)[0])
    for (_, turn, role, text, blank, _), sym in zip(held, syms):
        report.row(turn, role, text, blank, sym, letters)
    report.rest(letters)
    return report.result()


def _sweep(batches) -> Iterator[tuple]:
    """Reports of the conversations inside a partition; rows of those that may go on elsewhere, with their global place."""
    base = TaskContext.get().partitionId() << 40
    nothing = (None,) * 6

    def opened(conv_id, held):
        for at, turn, role, text, blank, cut in held:
            yield (conv_id, *(None,) * 8, at, turn, role, text, blank, cut)
    first, last, held = True, None, []
    for conv_id, own in itertools.groupby(enumerate(rows(batches)), key=lambda r: r[1][0]):
        if last is not None:
            yield from opened(*last) if first else [(*finished(*last), *nothing)]
            first = False
        size, spilled, held = 0, False, []
        for place, (_, turn, role, text, blank, cut, gone) in own:
            held.append((None if gone else base + place, turn, role, text, blank, cut))
            size += len(text) + 64
            if size > HELD_CHARS:
                yield from opened(conv_id, held)
                spilled, size, held = True, 0, []
        if spilled:
            yield from opened(conv_id, held)
            last, first = None, False
        else:
            last = conv_id, held
    if last is not None:
        yield from opened(*last)


def prepared(turns: DataFrame, conv_id: str, turn: str, role: str, text: str, copies: Column | None, gone: Column | None) -> DataFrame:
    """Rows in range partitions by conversation and place, with their faults but for duplicates."""
    named = turns.select(F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
                         F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
                         F.coalesce(copies if copies is not None else F.lit(1), F.lit(1)).alias("copies"),
                         F.coalesce(gone if gone is not None else F.lit(False), F.lit(False)).alias("gone"))
    named = named.select("conv_id", "turn", "role", "text", (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
                         (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"), "gone",
                         F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    # equal rows may be dealt to several partitions: they are told apart by a number only
    place = ["conv_id", "turn", "role", F.substring("text", 1, 32), F.sha2("text", 256), F.rand(11)]
    n = partitions(turns.sparkSession)
    named = named.withColumns({f"_{i}": p if isinstance(p, Column) else F.col(p) for i, p in enumerate(place)})
    keys = [f"_{i}" for i in range(len(place))]
    return (named.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
            .select("conv_id", "turn", "role", "text", "blank", "cut", "gone"))


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           copies: Column | None = None, gone: Column | None = None) -> DataFrame:
    """One report for each conversation; ``copies`` repeats a row, ``gone`` leaves it out but keeps its conversation."""
    ready = prepared(turns, conv_id, turn, role, text, copies, gone)
    swept = stored(arrow_map(ready, _sweep, f"{REPORT}, at bigint, turn bigint, role string, text string, open_blank boolean, cut boolean",
                             keeps="block_tables"))
    closed_ = swept.where("audit IS NOT NULL").select(*[f.split()[0] for f in REPORT.split(", ")])
    return closed_.unionAll(pieced(swept.where("audit IS NULL").select(
        "conv_id", "at", "turn", "role", "text", F.col("open_blank").alias("blank"), "cut")))


# ---------------------------------------------------------------- conversations in pieces

def _by_conversation(df: DataFrame, *order) -> DataFrame:
    return df.repartition(partitions(df.sparkSession), "conv_id").sortWithinPartitions("conv_id", *order)


def pieced(opened: DataFrame) -> DataFrame:
    """Reports from open rows (conv_id, at, turn, role, text, blank, cut); rows with a null place are left out."""
    n = partitions(opened.sparkSession)
    there = opened.where("at IS NOT NULL")
    named = there.select("conv_id", "at", "role", F.sha2("text", 256).alias("digest"), "blank", "cut")
    firsts = (named.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
              .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    flagged = named.join(firsts, same, "left").select(
        "conv_id", "at", F.substring("role", 1, 1).alias("initial"), (F.col("blank") | F.coalesce(F.col("at") > F.col("first"), F.lit(False))).alias("must_go"), "cut")

    def pieces(batches):
        def out(conv, held):
            syms = np.array([h[1] for h in held], np.uint8)
            return conv, held[0][0], held[-1][0], syms.tobytes(), tables().carry(syms).tobytes()
        for conv, own in itertools.groupby(rows(batches), key=lambda r: r[0]):
            while held := [(at, symbol(i, go, cut)) for _, at, i, go, cut in itertools.islice(own, PIECE)]:
                yield out(conv, held)
    made = stored(arrow_map(flagged.repartitionByRange(n, "conv_id", "at").sortWithinPartitions("conv_id", "at"), pieces,
                            "conv_id bigint, first bigint, last bigint, syms binary, carried binary", keeps="block_tables"))

    def backwards(batches):
        for _, own in itertools.groupby(rows(batches), key=lambda r: r[0]):
            right, last = 0, True
            for _, first, carried in own:
                yield first, right, last
                right, last = int(np.frombuffer(carried, np.int32)[right]), False
    rights = arrow_map(_by_conversation(made.select("conv_id", "first", "carried"), F.desc("first")), backwards,
                       "first bigint, right int, is_last boolean")

    def exits(batches):
        for conv, first, last, syms, right, is_last in rows(batches):
            syms = np.frombuffer(syms, np.uint8)
            yield conv, first, last, syms.tobytes(), right, is_last, [tables().trace(syms, right, s, False)[1] for s in range(4)]
    traced = stored(arrow_map(made.drop("carried").join(rights, "first").select("conv_id", "first", "last", "syms", "right", "is_last"),
                              exits, "conv_id bigint, first bigint, last bigint, syms binary, right int, is_last boolean, exits array<int>",
                              keeps="block_tables"))

    def forwards(batches):
        for _, own in itertools.groupby(rows(batches), key=lambda r: r[0]):
            state = 0
            for _, first, ways in own:
                yield first, state
                state = ways[state]
    entries = arrow_map(_by_conversation(traced.select("conv_id", "first", "exits"), "first"), forwards, "first bigint, state int")

    def letters(batches):
        for conv, first, syms, right, is_last, state in rows(batches):
            yield conv, first, syms, tables().trace(np.frombuffer(syms, np.uint8), right, state, is_last)[0]
    told = arrow_map(traced.join(entries, "first").select("conv_id", "first", "syms", "right", "is_last", "state"), letters,
                     "conv_id bigint, first bigint, syms binary, letters string", keeps="block_tables")

    # a piece comes just before its first row
    none = lambda t: F.lit(None).cast(t)
    stream = (opened.select("conv_id", "at", F.lit(1).alias("kind"), "turn", "role", "text", "blank", none("binary").alias("syms"), none("string").alias("letters"))
              .unionAll(told.select("conv_id", F.col("first").alias("at"), F.lit(0).alias("kind"), none("bigint"), none("string"), none("string"),
                                    none("boolean"), "syms", "letters")))

    def reports(batches):
        for conv, own in itertools.groupby(rows(batches), key=lambda r: r[0]):
            report, left, syms = Report(conv), iter(""), iter(())
            for _, at, kind, turn, role, text, blank, piece, ways in own:
                if at is None:
                    continue
                if not kind:
                    report.rest(left)
                    left, syms = iter(ways), iter(piece)
                else:
                    report.row(turn, role, text, blank, next(syms), left)
            report.rest(left)
            yield report.result()
    return arrow_map(_by_conversation(stream, "at", "kind"), reports, REPORT)
