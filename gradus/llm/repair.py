"""Conversations mended by the cheapest edits that make their roles alternate.

The rows of a conversation that stay, as they are or in another role, are chosen by a retained-subsequence program over
three states of what has been kept so far. It runs from the last row to the first; for each state it holds the running
minimum of what the rest costs, in which the price of the rows deleted in between is summed and the roles on both sides say
what must be inserted. The audit is then read off from the first row on, taking the least letter that keeps the cost.

Only differences between the states' costs matter, and these are small, so a row is one look into a table of steps
(``step``). A conversation is cut into chunks wherever an Arrow batch ends, and a chunk of an unfinished conversation is first
summed up as costs from each state to each state, so no task needs the whole of it before its text is hashed.
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
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from gradus.llm._order import in_ranges
from gradus.plans.scratch import Scratch, partitions

#: Prices of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANKS = " \t\n\v\f\r"
#: States: nothing kept, a system row, a user row, an assistant row last. A row that must not be deleted goes on to GO_ON of its state.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
GO_ON = (USER, USER, ASSISTANT, USER)
#: By the initial of a row's role (none of the three, s, u, a): the state before it that lets it stay, and that after it.
STAYS = ({}, {NOTHING: SYSTEM}, {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT})
#: Cost of ending in each state: a user row needs an answer, a system row a user row and an answer.
END = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 40
FINE, CUT_OFF, UNFIT = range(3)


@lru_cache(None)
def step(code: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[tuple[str, int] | None, ...]]:
    """Costs before a row, given those after it, and for each state the least letters up to and with this row's and the state they lead to.

    code is 3 * initial + FINE, CUT_OFF or UNFIT (a row that must go).
    """
    initial, kind = divmod(code, 3)
    price = TRUNCATED if kind == CUT_OFF else 0
    options: list[list[tuple[str, int, int]]] = []
    for state in range(4):
        own = [("D", DELETE + after[state], state)]
        if kind != UNFIT:
            if (to := STAYS[initial].get(state)) is not None:
                own.append(("K", price + after[to], to))
            own.append(("R", price + REROLE + after[GO_ON[state]], GO_ON[state]))
        options.append(own)
    costs = [min(c for _, c, _ in own) for own in options]
    for _ in range(2):  # rows inserted before this one
        costs = [min(c, INSERT + costs[GO_ON[state]]) for state, c in enumerate(costs)]
    letters: list[tuple[str, int] | None] = []
    for state in range(4):
        said, at = "", state
        while costs[state] < NEVER:
            fits = [("I", INSERT + costs[GO_ON[at]], GO_ON[at])] + options[at]
            letter, _, to = min(x for x in fits if x[1] == costs[at])
            said, at = said + letter, to
            if letter != "I":
                break
        letters.append((said, at) if said else None)
    return tuple(min(c, NEVER) for c in costs), tuple(letters)


def to_go(codes: bytes, end: tuple[int, ...]) -> tuple[tuple[int, ...], list[tuple]]:
    """Costs to go before the first row, by state, and every row's letters, last row first; end: the costs after the last row."""
    base, now, letters = 0, end, []
    for code in reversed(codes):
        least = min(now)
        base += least
        now, said = step(code, tuple(c - least if c < NEVER else NEVER for c in now))
        letters.append(said)
    return tuple(c + base if c < NEVER else NEVER for c in now), letters


def between(codes: bytes) -> list[int]:
    """Costs from each state before the rows to each state after them, without rows inserted at the end."""
    ends = [to_go(codes, tuple(0 if q == p else NEVER for q in range(4)))[0] for p in range(4)]
    return [ends[q][p] for p in range(4) for q in range(4)]


def walked(letters: list[tuple], start: int) -> tuple[str, int]:
    """The audit of rows from a state, and the state it ends in."""
    said = []
    for row in reversed(letters):
        if row[start] is None:  # no way from this state
            return "", start
        text, start = row[start]
        said.append(text)
    return "".join(said), start


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversation rows (nulls read as one space) damaged by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops a row (copies 0), 1 empties its text, 2 removes its . ! ?, 3 repeats it (copies 2), 4 makes it the user's.
    conv_id and turn keep their nulls.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    role = F.when(kind == 4, "user").otherwise(space("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.cast("long").alias("copies"))


CHUNK = "conv_id {conv}, part int, nth int, codes binary, faults array<long>, turns long, low long, high long, initials array<long>, costs array<long>"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of each batch of ordered rows: a byte a row, counts and, where it may go on elsewhere, costs from state to state."""
    part = TaskContext.get().partitionId()
    for nth, b in enumerate(batches):
        conv = b.column("conv_id").to_pylist()
        if not conv:
            continue
        turn = b.column("turn").to_pylist()
        initial, blank, cut, later, copies = (np.asarray(b.column(c)) for c in ("initial", "blank", "cut", "later", "copies"))
        codes = np.repeat(3 * initial + UNFIT, copies).astype(np.uint8)
        first = np.cumsum(copies) - copies
        good = (copies > 0) & ~blank & ~later
        codes[first[good]] = 3 * initial[good] + np.where(cut[good], CUT_OFF, FINE)
        starts = [0, *(k for k in range(1, len(conv)) if conv[k] != conv[k - 1]), len(conv)]
        rows = []
        for k, (lo, hi) in enumerate(zip(starts, starts[1:])):
            own = codes[first[lo] : first[hi - 1] + copies[hi - 1]]
            who = own // 3
            legal = ((who[:-1] == 1) | (who[:-1] == 3)) & (who[1:] == 2) | (who[:-1] == 2) & (who[1:] == 3)
            here = copies[lo:hi]
            faults = [int(here[blank[lo:hi]].sum()), int(np.where(blank[lo:hi], 0, np.where(later[lo:hi], here, np.maximum(here - 1, 0))).sum()), int((own % 3 == CUT_OFF).sum()), int((~legal).sum()) if len(own) else 0]
            there = [t for t, c in zip(turn[lo:hi], here) if t is not None and c]
            whole = 0 < k < len(starts) - 2
            data = own.tobytes()
            rows.append((conv[lo], part, nth, data, faults, len(set(there)), min(there, default=None), max(there, default=None), [int(who[0]), int(who[-1])] if len(own) else [], None if whole else between(data)))
        types = [b.schema.field("conv_id").type, pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["conv_id", "part", "nth", "codes", "faults", "turns", "low", "high", "initials", "costs"]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), types)], names)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk of a conversation the costs after it, from the last chunk back."""
    for b in batches:
        rows = []
        for chunks in b.column("chunks").to_pylist():
            end = END
            for k, c in reversed([*enumerate(chunks)]):
                rows.append((c["part"], c["nth"], list(end), k == 0, k == len(chunks) - 1))
                if c["costs"] is not None:
                    end = tuple(min(min(c["costs"][4 * p + q] + end[q] for q in range(4)), NEVER) for p in range(4))
        columns = list(zip(*rows)) or [()] * 5
        types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.bool_(), pa.bool_()]
        ends = [0]
        for chunks in b.column("chunks").to_pylist():
            ends.append(ends[-1] + len(chunks))
        values = pa.StructArray.from_arrays([pa.array(list(x), t) for x, t in zip(columns, types)], ["part", "nth", "end", "first", "last"])
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["conv_id", "ends"])


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds said: for each state before the chunk (only the first, where the conversation begins) the audit, the state after it and the cost."""
    for b in batches:
        out = []
        for codes, end, first, last in zip(*(b.column(c).to_pylist() for c in ("codes", "end", "first", "last"))):
            costs, letters = to_go(codes, tuple(end))
            own = []
            for start in range(1 if first else 4):
                text, state = walked(letters, start)
                own.append({"audit": text + ("I" * (END[state] // INSERT) if last else ""), "state": state, "cost": costs[start]})
            out.append(own)
        kind = pa.list_(pa.struct([("audit", pa.string()), ("state", pa.int64()), ("cost", pa.int64())]))
        kept = [c for c in b.schema.names if c not in ("codes", "end", "first", "last")]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(out, kind)], [*kept, "said"])


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit of every conversation and its counts: gaps, blank, duplicate, truncated, illegal, cost."""
    for b in batches:
        audits, counts = [], []
        for chunks in b.column("chunks").to_pylist():
            state, said, faults, turns, low, high, last = 0, [], np.zeros(4, np.int64), 0, None, None, None
            for c in chunks:
                said.append(c["said"][state]["audit"])
                state = c["said"][state]["state"]
                faults += c["faults"]
                if c["initials"]:
                    faults[3] += last is not None and (last, c["initials"][0]) not in ((1, 2), (2, 3), (3, 2))
                    last = c["initials"][1]
                if c["turns"]:
                    turns += c["turns"] - (high == c["low"])
                    low, high = c["low"] if low is None else low, c["high"]
            audits.append("".join(said))
            counts.append([high - low + 1 - turns if turns else 0, *faults.tolist(), chunks[0]["said"][0]["cost"]])
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(audits, pa.string()), pa.array(counts, pa.list_(pa.int64()))], ["conv_id", "audit", "counts"])


class _Repaired:
    """The mended text of one conversation, hashed as its rows come by."""

    def __init__(self, audit: str):
        self.letters, self.state, self.hash, self.any = iter(audit), NOTHING, hashlib.sha256(), False

    def put(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.any = True

    def go_on(self, text: str) -> None:
        self.state = GO_ON[self.state]
        self.put("user" if self.state == USER else "assistant", text)

    def row(self, role: str, text: str) -> None:
        for letter in self.letters:
            if letter == "I":
                self.go_on("")
                continue
            if letter == "K":
                self.state = STAYS["_sua".index(role[0])][self.state]
                self.put(role, text)
            elif letter == "R":
                self.go_on(text)
            return

    def close(self) -> str:
        for _ in self.letters:
            self.go_on("")
        return self.hash.hexdigest()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's head row (audit, counts), then its rows, streamed through the hash."""
    open_: tuple | None = None
    schema = None
    for b in batches:
        schema, done = b.schema, []
        for conv, head, audit, counts, role, text, copies in zip(*(b.column(c).to_pylist() for c in ("conv_id", "head", "audit", "counts", "role", "text", "copies"))):
            if head:
                if open_:
                    done.append((*open_[:3], open_[3].close()))
                open_ = (conv, audit, counts, _Repaired(audit))
            else:
                for _ in range(copies):
                    open_[3].row(role, text)
        if done:
            yield _result(done, schema)
    if open_:
        yield _result([(*open_[:3], open_[3].close())], schema)


SAID = ArrayType(StructType().add("audit", StringType()).add("state", LongType()).add("cost", LongType()))
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _result(done: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    conv, audits, counts, hashes = zip(*done)
    columns = [pa.array(list(conv), schema.field("conv_id").type), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(len(COUNTS)))]
    return pa.RecordBatch.from_arrays([*columns, pa.array(audits, pa.string()), pa.array(hashes, pa.string())], ["conv_id", *COUNTS, "audit", "repaired_sha256"])


def _same(a: str, b: str, *columns: str):
    """Equality of columns of two aliased tables, nulls equal."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def repair(rows: DataFrame) -> DataFrame:
    """A row for every conversation of rows (conv_id, turn, role, text, copies): what is wrong with it and its cheapest repair.

    Rows go by turn (nulls first; equal turns by role, then the SHA-256 of the text), each ``copies`` times in a row. A
    row with copies 0 only names its conversation. The first fault of a row counts: blank, duplicate (role and text seen
    earlier in the conversation), truncated (its last character that isn't white space is none of . ! ?). A row is kept (0),
    given the user's or assistant's role (2) or deleted (3, must be where blank or duplicate), rows without text are inserted
    (2), a truncated row that stays adds 1; the roles' initials become (s?(ua)+)?. The audit has the edits' initials, the
    least of the cheapest; repaired_sha256 is the hash of the repaired role:text lines.

    Null conv_id is one conversation; null role or text is read as one space; a conversation without rows has zeros, an empty
    audit and the hash of no text; repeated rows are duplicates; an empty table gives no rows; other columns are ignored.

    Rows are ordered in ranges and judged without their text (a 32-byte hash stands for it), equal ones counted first;
    text is shuffled once, to be hashed. A hash is a chain, so one conversation's text streams through one task, in batches.
    """
    scratch = Scratch(rows.sparkSession, "repair")
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), "copies")
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    trimmed = F.rtrim("text", F.lit(BLANKS))
    judged = rows.select("conv_id", "turn", "role", "digest", "copies", (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"))
    key = ["conv_id", "turn", "role", "digest"]
    distinct = judged.groupBy(*key).agg(F.sum("copies").alias("copies"), F.max("blank").alias("blank"), F.max("cut").alias("cut"))
    distinct = scratch.save(distinct, "distinct")
    several = distinct.where("copies > 0 and not blank").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1")
    marked = distinct.alias("r").join(several.alias("s"), _same("r", "s", "conv_id", "role", "digest"), "left")
    later = F.coalesce(F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("r.turn")), F.lit(False))
    initial = sum((F.when(F.substring("r.role", 1, 1) == x, k).otherwise(0) for k, x in enumerate("sua", 1)), F.lit(0)).cast("long")
    marked = marked.select(*(F.col(f"r.{c}").alias(c) for c in (*key, "copies", "blank", "cut")), later.alias("later"), initial.alias("initial"))
    conv = rows.schema["conv_id"].dataType.simpleString()
    chunks = scratch.save(in_ranges(marked, key).mapInArrow(_chunks, CHUNK.format(conv=conv)), "chunks")

    by_conv = chunks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "nth", "costs"))).alias("chunks"))
    ends = by_conv.mapInArrow(_ends, f"conv_id {conv}, ends array<struct<part:int,nth:int,end:array<bigint>,first:boolean,last:boolean>>")
    ends = ends.select("conv_id", F.explode("ends").alias("e")).select("conv_id", "e.*")
    met = chunks.alias("c").join(ends.alias("e"), _same("c", "e", "conv_id", "part", "nth"))
    met = met.select(*(F.col(f"c.{c}").alias(c) for c in ("conv_id", "part", "nth", "codes", "faults", "turns", "low", "high", "initials")), "e.end", "e.first", "e.last")
    kept = [c for c in met.columns if c not in ("codes", "end", "first", "last")]
    said = StructType([met.schema[c] for c in kept]).add("said", SAID)
    told = met.mapInArrow(_walks, said)
    heads = told.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*kept[1:], "said"))).alias("chunks")).mapInArrow(_composed, f"conv_id {conv}, audit string, counts array<bigint>")

    none = lambda kind: F.lit(None).cast(kind)
    head = heads.select("conv_id", F.lit(True).alias("head"), "audit", "counts", none("long").alias("turn"), none("string").alias("role"), none("binary").alias("digest"), none("string").alias("text"), F.lit(0).cast("long").alias("copies"))
    body = rows.where("copies > 0").select("conv_id", F.lit(False).alias("head"), none("string").alias("audit"), none("array<bigint>").alias("counts"), "turn", "role", "digest", "text", "copies")
    both = head.unionByName(body).repartition(partitions(rows.sparkSession), "conv_id")
    both = both.sortWithinPartitions("conv_id", F.col("head").desc(), "turn", "role", "digest")
    return both.mapInArrow(_hashed, f"conv_id {conv}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string")
