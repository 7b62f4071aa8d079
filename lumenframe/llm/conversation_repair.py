"""Cheapest repair of conversations whose roles must read s?(ua)+ or nothing.

The rows of a conversation and the states of that grammar make a graph: a node is
(rows gone by, state), an arc keeps, reroles or deletes the next row or inserts
one, and costs 0 to 3.  Dial's buckets give all distances to the end: as costs are
small, nodes lie in a ring of buckets by distance and no heap is needed.  Then arcs
are walked from the start that are tight (cost + distance there = distance here),
always the one with the least letter; the letters are the audit.

A conversation is cut into segments of SEGMENT rows, which are solved side by side
from every state to every state; a segment's table has 16 costs, whatever its
length, and tables are joined from the last one to the first.  So no task holds a
conversation's rows: it holds a segment, then the tables and the audit (a letter a
row, which is part of the result), while the texts stream past to be hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm._spark import map_arrow, saved

#: Rows of one segment.
SEGMENT = 4096
#: Costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after s, after u, after a; where K leads by the initial (s, u, a, other), -1: nowhere; where R and I lead.
STATES = 4
NEXT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
FORCED = np.array([2, 2, 3, 2])
#: What is still to be inserted after the last row, and what that costs.
TAIL = ("", "II", "I", "")
FAR = 1 << 30
#: Faults of a row, as in its code: initial + 4 * fault.
NONE, CUT, BLANK, DUPLICATE = 0, 1, 2, 3
#: Buckets of the ring: more than the largest cost of an arc.
RING = 4
LETTERS = b"DIKR"
SPACE = r"[\x20\x09-\x0D]"
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _row_costs() -> np.ndarray:
    """[code, from, to]: the least cost of an arc that takes a row with this code."""
    out = np.full((16, STATES, STATES), FAR)
    for code in range(16):
        initial, fault = code % 4, code // 4
        for q in range(STATES):
            out[code, q, q] = DELETE
            if fault in (NONE, CUT):
                extra = TRUNCATED * (fault == CUT)
                out[code, q, FORCED[q]] = min(out[code, q, FORCED[q]], REROLE + extra)
                if NEXT[q, initial] >= 0:
                    out[code, q, NEXT[q, initial]] = KEEP + extra
    return out


_ROW = _row_costs()


def distances(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of all nodes to each of the four ends of their segment, and each segment's first level.

    codes of all segments in a row; segment s has those from first[s] to first[s + 1]
    and one level more than rows.  The result's axes: end, level, state.  All
    segments' buckets of one distance are emptied together.
    """
    segments, rows = len(first) - 1, len(codes)
    level = first[:-1] + np.arange(segments)
    last = first[1:] + np.arange(segments)
    levels = rows + segments
    before = np.full(levels, -1)  # the code of the row between the level before and this one
    before[np.delete(np.arange(levels), level)] = codes
    closed = np.zeros(levels, bool)
    closed[last] = True
    size = levels * STATES
    dist = np.full(STATES * size, FAR, np.int32)
    done = np.zeros(STATES * size, bool)
    seeds = (np.arange(STATES)[:, None] * size + last[None, :] * STATES + np.arange(STATES)[:, None]).ravel()
    dist[seeds] = 0
    ring: list[list[np.ndarray]] = [[seeds], *([] for _ in range(RING - 1))]
    d = 0
    while any(ring):
        while ring[d % RING]:
            todo = ring[d % RING].pop()
            todo = todo[(dist[todo] == d) & ~done[todo]]
            done[todo] = True
            node = todo % size
            at, q = node // STATES, node % STATES
            base = todo - q
            code = before[at]
            for p in range(STATES):
                taking = np.where(code >= 0, _ROW[code, p, q], FAR)
                inserting = np.where((FORCED[p] == q) & ~closed[at], INSERT, FAR)
                for cost, target in ((taking, base - STATES + p), (inserting, base + p)):
                    for c in range(RING):
                        found = target[cost == c]
                        found = found[dist[found] > d + c]
                        if len(found):
                            dist[found] = d + c
                            ring[(d + c) % RING].append(found)
        d += 1
    return dist.reshape(STATES, levels, STATES), level


def audits(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[list[bytes | None]]]:
    """costs[segment, from, to], and for each segment the 16 least audits (None where there is no way)."""
    dist, level = distances(codes, first)
    segments = len(level)
    costs = dist[:, level, :].transpose(1, 2, 0)
    s, q, e = (x.ravel() for x in np.meshgrid(np.arange(segments), np.arange(STATES), np.arange(STATES), indexing="ij"))
    walker = np.flatnonzero(costs.ravel() < FAR)
    s, q, e = s[walker], q[walker], e[walker]
    at, end = level[s], (first[1:] + np.arange(segments))[s]
    row = first[:-1][s]
    who: list[np.ndarray] = []
    letters: list[np.ndarray] = []
    while len(walker):
        going = at < end
        walker, e, at, end, row, q = (x[going] for x in (walker, e, at, end, row, q))
        if not len(walker):
            break
        code, here = codes[row], dist[e, at, q]
        initial, extra = code % 4, TRUNCATED * (code // 4 == CUT)
        stays = NEXT[q, initial]
        delete = dist[e, at + 1, q] + DELETE == here
        insert = ~delete & (dist[e, at, FORCED[q]] + INSERT == here)
        keep = ~delete & ~insert & (code // 4 <= CUT) & (stays >= 0) & (dist[e, at + 1, stays] + KEEP + extra == here)
        who.append(walker)
        letters.append(np.where(delete, 0, np.where(insert, 1, np.where(keep, 2, 3))))
        q = np.where(delete, q, np.where(keep, stays, FORCED[q]))
        at, row = at + ~insert, row + ~insert
    out: list[bytes | None] = [None] * (segments * 16)
    if who:
        every = np.concatenate(who)
        order = np.argsort(every, kind="stable")
        text = np.frombuffer(LETTERS, np.uint8)[np.concatenate(letters)[order]].tobytes()
        names, begins = np.unique(every[order], return_index=True)
        for name, a, b in zip(names.tolist(), begins.tolist(), [*begins[1:].tolist(), len(text)], strict=True):
            out[name] = text[a:b]
    return costs, [out[i : i + 16] for i in range(0, len(out), 16)]


def _ranks(texts: list[bytes | None]) -> bytes:
    """For each start the ranks of its ends' audits; none of them is the beginning of another, as each ends with a row."""
    out = bytearray(16)
    for q in range(0, 16, 4):
        for rank, e in enumerate(sorted((e for e in range(4) if texts[q + e] is not None), key=lambda e: texts[q + e])):
            out[q + e] = rank
    return bytes(out)


def chain(tables: list[tuple[np.ndarray, bytes]]) -> tuple[int, list[tuple[int, int]]]:
    """The least cost over a conversation's segments in order, and each segment's start and end of the least audit."""
    ahead = [np.array([INSERT * len(t) for t in TAIL])]
    for costs, _ in reversed(tables):
        ahead.append((costs.astype(np.int64) + ahead[-1][None, :]).min(axis=1))
    ahead.reverse()
    q, ways = 0, []
    for (costs, ranks), here, there in zip(tables, ahead, ahead[1:], strict=False):
        tight = [e for e in range(STATES) if costs[q, e] < FAR and costs[q, e] + there[e] == here[q]]
        end = min(tight, key=lambda e: ranks[4 * q + e])
        ways.append((q, end))
        q = end
    return int(ahead[0][0]), ways


def damage(rows: DataFrame) -> DataFrame:
    """The rows of conversations after damage by crc32 of conv_id:turn: conv_id, turn, role, text; a dropped row stays with a null role.

    Nulls are one space in the hash, in role and in text.
    """
    blank = F.lit(" ")
    k = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")))) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(k == 0, F.lit(None)).when(k == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(k == 1, F.lit("")).when(k == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"),
    ).select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy"))


def _codes(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest and code of each row (never its text), in order within range partitions, written to the shared folder."""
    initial = F.substring("role", 1, 1)
    own = saved(
        rows.filter("role is not null").select(
            "conv_id",
            "turn",
            "role",
            _digest().alias("digest"),
            F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("initial"),
            (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
            (~F.col("text").rlike(rf"[.!?]{SPACE}*\z")).alias("cut"),
            (F.monotonically_increasing_id() * 2 + F.col("copy")).alias("number"),
        )
    )
    # Nulls come first within a struct; a partial minimum for each task, so that a row that is repeated without end is one.
    key = ["conv_id", "role", "digest"]
    first = own.groupBy(*key).agg(F.min(F.struct("turn", "number")).alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    first = first.select(*(F.col(c).alias(f"first_{c}") for c in key), F.col("first.number").alias("first_number"))
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"first_{c}"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first_number") != F.col("number"), DUPLICATE).when(F.col("cut"), CUT).otherwise(NONE)
    order = ["conv_id", "turn", "role", "digest", "number"]
    ranged = own.join(first, same, "left").withColumn("code", (F.col("initial") + 4 * fault).cast("tinyint"))
    return saved(ranged.select(*order, "code").repartitionByRange(*order).sortWithinPartitions(*order).drop("number"))


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256))


def _segments(codes: DataFrame, most: int) -> DataFrame:
    """For each segment its place, the key of its first row, its codes' counts, costs, ranks and audits."""
    schema = pa.schema(
        [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()), ("place", pa.int64()), ("table", pa.binary()), ("audits", pa.list_(pa.string()))]
    )

    def solve(table: pa.Table, first: np.ndarray, number: int) -> pa.RecordBatch:
        code = table.column("code").to_numpy().astype(np.int64)
        costs, texts = audits(code, first)
        initial, fault = code % 4, code // 4
        follows = (initial[:-1] == 0) & (initial[1:] == 1) | (initial[:-1] == 1) & (initial[1:] == 2) | (initial[:-1] == 2) & (initial[1:] == 1)
        bad = np.concatenate([[0], np.cumsum(~follows), [0]])
        sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(np.stack([fault == f for f in (BLANK, DUPLICATE, CUT)], 1), axis=0)])
        blobs = []
        for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            counts = [*(sums[b] - sums[a]).tolist(), int(bad[b - 1] - bad[a]), int(initial[a]), int(initial[b - 1])]
            blobs.append(np.array(counts, "<i8").tobytes() + costs[k].astype("<i4").tobytes() + _ranks(texts[k]))
        heads = table.take(pa.array(first[:-1])).select(["conv_id", "turn", "role", "digest"])
        place = (TaskContext.get().partitionId() << 40) + number + np.arange(len(blobs))
        columns = [*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in heads.columns), pa.array(place), pa.array(blobs, pa.binary()), pa.array([[None if t is None else t.decode() for t in x] for x in texts], pa.list_(pa.string()))]
        return pa.Table.from_arrays([pa.chunked_array([c]) if isinstance(c, pa.Array) else c for c in columns], schema=schema).to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        number = 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            if rest.num_rows < 2 * SEGMENT:
                continue
            first = _cuts(rest, most)
            yield solve(rest.slice(0, int(first[-1])), first, number)
            number += len(first) - 1
            rest = rest.slice(int(first[-1]))
        if rest is not None and rest.num_rows:
            first = np.append(_cuts(rest, most), rest.num_rows)
            yield solve(rest, first, number)

    fields = "conv_id long, turn long, role string, digest binary, place long, table binary, audits array<string>"
    return map_arrow(codes, run, fields)


def _cuts(table: pa.Table, most: int) -> np.ndarray:
    """Where segments begin: at a new conversation, and after `most` rows of one."""
    conv = table.column("conv_id")
    null = conv.is_null().to_numpy()
    value = conv.fill_null(0).to_numpy()
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (null[1:] != null[:-1])])
    begins = np.flatnonzero(new)
    since = np.arange(len(value)) - begins[np.cumsum(new) - 1]
    return np.flatnonzero(since % most == 0)


class _Conversation:
    """What one pass over a conversation's tables, audits and rows, in this order, adds up."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.tables: list[tuple[np.ndarray, bytes]] = []
        self.counts, self.illegal, self.last = np.zeros(3, np.int64), 0, None
        self.ways: list[tuple[int, int]] | None = None
        self.audit: list[str] = []
        self.queue, self.state, self.cost = iter(""), 0, 0
        self.hash, self.begun = hashlib.sha256(), False
        self.turn, self.low, self.high, self.turns = None, None, None, 0

    def table(self, blob: bytes) -> None:
        counts = np.frombuffer(blob, "<i8", 6)
        self.counts += counts[:3]
        self.illegal += int(counts[3]) + (self.last is not None and (self.last, int(counts[4])) not in ((0, 1), (1, 2), (2, 1)))
        self.last = int(counts[5])
        self.tables.append((np.frombuffer(blob, "<i4", 16, 48).reshape(4, 4), blob[112:]))

    def segment(self, texts: list[str | None]) -> None:
        if self.ways is None:
            self.cost, ways = chain(self.tables)
            self.ways, self.tables = ways[::-1], []
            self.end = ways[-1][1]
        start, end = self.ways.pop()
        self.audit.append(texts[4 * start + end])

    def _put(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) * self.begun}{role}:{text}".encode())
        self.begun = True

    def _letters(self) -> Iterator[str]:
        """The letters one by one; segments may be added meanwhile."""
        k = 0
        while k < len(self.audit):
            yield from self.audit[k]
            k += 1

    def row(self, turn: int | None, role: str, text: str, code_letters: Iterator[str]) -> None:
        if turn is not None:
            self.turns += turn != self.turn
            self.low = turn if self.low is None else self.low
            self.turn = self.high = turn
        for letter in code_letters:
            self.state_letter(letter, role, text)
            if letter != "I":
                break

    def state_letter(self, letter: str, role: str, text: str) -> None:
        forced = int(FORCED[self.state])
        if letter == "K":
            self.state = int(NEXT[self.state, {"s": 0, "u": 1, "a": 2}[role[:1]]])
            self._put(role, text)
        elif letter != "D":
            self.state = forced
            self._put("user" if forced == 2 else "assistant", text if letter == "R" else "")

    def result(self) -> dict:
        tail = ""
        if self.ways is not None:
            tail = TAIL[self.end]
            for letter in tail:
                self.state_letter(letter, "", "")
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        blank, duplicate, truncated = self.counts.tolist()
        audit = "".join(self.audit) + tail
        return {"conv_id": self.conv_id, "gaps": gaps, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": self.illegal, "cost": self.cost, "audit": audit, "repaired_sha256": self.hash.hexdigest()}


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """A row for each conv_id of rows (conv_id, turn, role, text; a null role marks a row that is gone, which only names its conversation).

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256.  Rows go by turn, nulls first, then by role and by the SHA-256
    of the text; a null conv_id is a conversation of its own.  A row is blank
    without a character other than white space, else a duplicate if an earlier row
    has its role and text, else truncated if its last such character is not one of
    .!?  Initials other than s, u, a fit nowhere, so such a row is reroled or
    deleted; an empty role has none.  An empty table gives no rows.

    Texts are shuffled once, to the task that hashes their conversation: a hash of
    a sequence can only be made in order, so a conversation's texts stream through
    one task, which holds one batch of them.
    """
    codes = _codes(rows)
    segments = saved(_segments(codes, segment))
    none = {"turn": "long", "role": "string", "digest": "binary", "place": "long", "table": "binary", "audits": "array<string>", "text": "string"}

    def shaped(df: DataFrame, first: int, second: int) -> DataFrame:
        return df.select("conv_id", F.lit(first).alias("first"), *(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()), F.lit(second).alias("second"))

    gone = rows.filter("role is null").select("conv_id").distinct()
    every = (
        shaped(gone, 0, 0)
        .unionByName(shaped(segments.select("conv_id", "place", "table"), 1, 0))
        .unionByName(shaped(segments.drop("table"), 2, 0))
        .unionByName(shaped(rows.filter("role is not null").select("conv_id", "turn", "role", _digest().alias("digest"), "text"), 2, 1))
        .select("conv_id", "first", "turn", "role", "digest", "second", "place", "table", "audits", "text")
    )
    # A conversation's tables come first, in order; then its rows, each segment's audits before its first row.
    table_place = F.when(F.col("first") == 1, F.col("place"))
    ordered = every.repartition("conv_id").sortWithinPartitions("conv_id", "first", table_place, "turn", "role", "digest", "second", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        letters: Iterator[str] = iter("")
        for batch in batches:
            done = []
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5, 7, 8, 9)]
            for conv_id, first, turn, role, second, table, texts, text in zip(*columns, strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        done.append(now.result())
                    now = _Conversation(conv_id)
                    letters = now._letters()
                if first == 1:
                    now.table(table)
                elif first == 2 and not second:
                    now.segment(texts)
                elif first == 2:
                    now.row(turn, role, text, letters)
            if done:
                yield pa.RecordBatch.from_pylist(done, result)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.result()], result)

    result = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    return map_arrow(ordered, run, RESULT)


def conversation_repair(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """repair() of the rows after damage()."""
    return repair(damage(conversations), segment)
