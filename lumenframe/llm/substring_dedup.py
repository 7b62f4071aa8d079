"""Substring deduplication by relative Lempel-Ziv parsing over words.

Passages that share a rare n-gram meet in a reference block, so that each document
is parsed against every block that can hold a match of it.  A block is indexed once,
by a suffix array over the names of its words, and every passage is factored
greedily: a factor is the longest match that occurs elsewhere in the block.  The
windows within a factor are duplicate spans.  A window that crosses a factor's end
may still occur elsewhere: these, and only these, are looked up one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenframe.llm import _text
from lumenframe.llm._repeats import Unit, remove_repeats

WIDTH, GRAM = 35, 8
BLANK = np.arange(256) == 0x20
REMOVED = "doc_id long, n_words long, n_removed long, spans array<struct<begin:long,end:long>>, text string"


class Reference:
    """A block's words as one row of symbols, each segment closed by an end of its own; suffix array by doubling."""

    def __init__(self, segments: list[bytes], most: int):
        data = np.frombuffer(b" ".join(segments), np.uint8)
        starts, ends, _ = _text.words(data, np.array([0, len(data)]), BLANK)
        offsets = pa.py_buffer(np.append(starts, len(data) + 1).astype("<i8"))
        # Names of words: equal words, and no others, share one.  All but the last are followed by a blank.
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, offsets, pa.py_buffer(data.tobytes() + b" ")])
        names = words.dictionary_encode().indices.to_numpy()
        sizes = np.array([s.count(b" ") + 1 for s in segments])
        self.ends = np.cumsum(sizes + 1) - 1
        self.begins = self.ends - sizes
        symbols = np.empty(int(self.ends[-1]) + 1, np.int64)
        symbols[self.ends] = np.arange(len(segments)) + len(names)
        inside = np.ones(len(symbols), bool)
        inside[self.ends] = False
        symbols[inside] = names
        n = len(symbols)
        self.levels = [np.unique(symbols, return_inverse=True)[1].astype(np.int64)]
        while 1 << len(self.levels) <= most:
            step, name = 1 << (len(self.levels) - 1), self.levels[-1]
            after = np.zeros(n, np.int64)
            after[: n - step] = name[step:] + 1
            self.levels.append(np.unique(name * (n + 2) + after, return_inverse=True)[1].astype(np.int64))
        self.array = np.argsort(self.levels[-1], kind="stable")
        self.rank = np.empty(n, np.int64)
        self.rank[self.array] = np.arange(n)

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes a and b, by the names of substrings."""
        n, common = len(self.array), np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = a + common, b + common
            fine = (x + (1 << k) <= n) & (y + (1 << k) <= n)
            fine[fine] = self.levels[k][x[fine]] == self.levels[k][y[fine]]
            common[fine] += 1 << k
        return common

    def longest(self, at: np.ndarray) -> np.ndarray:
        """For each place, the length of its longest match elsewhere: that with a neighbour in the suffix array."""
        out = np.zeros(len(at), np.int64)
        for step in (-1, 1):
            other = self.rank[at] + step
            fine = (other >= 0) & (other < len(self.array))
            out[fine] = np.maximum(out[fine], self._common(at[fine], self.array[other[fine]]))
        return out


def repeated_windows(reference: Reference, width: int) -> np.ndarray:
    """A mark for each place of the reference where a window starts that occurs elsewhere: greedy factors of all segments, side by side."""
    marks = np.zeros(len(reference.array) + 1, np.int64)
    last = reference.ends - width  # of the windows of each segment
    looked = reference.begins.copy()  # windows before have been decided
    at = reference.begins.copy()
    go = np.flatnonzero(at <= last)
    crossing: list[np.ndarray] = []
    while len(go):
        long = reference.longest(at[go])
        # Windows within the factor are repeated, without another look.
        upto = np.minimum(at[go] + long - width, last[go]) + 1
        whole = upto > at[go]
        np.add.at(marks, at[go][whole], 1)
        np.add.at(marks, upto[whole], -1)
        after = np.minimum(at[go] + np.maximum(long, 1), last[go] + 1)
        # Those that start within it and end behind it are looked up.
        begin = np.maximum(np.where(whole, upto, at[go] + 1), looked[go])
        begin[(long == 0)] = after[long == 0]
        size = np.maximum(after - begin, 0)
        crossing.append(np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size))
        at[go] += np.maximum(long, 1)
        looked[go] = np.maximum(looked[go], after)
        go = go[at[go] <= last[go]]
    out = np.cumsum(marks[:-1]) > 0
    rest = np.concatenate([*crossing, np.zeros(0, np.int64)])
    rest = rest[~out[rest]]
    out[rest[reference.longest(rest) >= width]] = True
    return out


def solve(segments: list[bytes], width: int) -> list[np.ndarray]:
    """For each segment, the starts of windows that occur elsewhere among all segments."""
    reference = Reference(segments, 2 * width)
    marks = repeated_windows(reference, width)
    return [np.flatnonzero(marks[b : max(b, e - width + 1)]) for b, e in zip(reference.begins.tolist(), reference.ends.tolist(), strict=True)]


def substring_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, spans (of removed words), text (kept words joined by a space) for each row of docs.

    A word goes if a window of `width` words that covers it starts anywhere else as
    well, in whatever row; so repeated rows lose such windows in every copy.  Windows
    are judged on the input, on their text.  A null or empty text has no words; a null
    doc_id stays.  A long text is a step of its own, in about forty times its bytes.
    """

    def finish(table: pa.Table, ranges: list) -> pa.Table:
        data, offsets = _text.utf8(table.column("text"))
        out: list[tuple] = []
        for i, j in _text.steps(offsets):
            part = data[offsets[i] : offsets[j]]
            starts, ends, first = _text.words(part, offsets[i : j + 1] - offsets[i])
            raw = part.tobytes()
            at = list(zip(starts.tolist(), ends.tolist(), strict=True))
            for row in range(i, j):
                a, b = int(first[row - i]), int(first[row - i + 1])
                kept, last = [], a
                for x, y in ranges[row]:
                    kept += at[last : a + x]
                    last = a + y
                kept += at[last:b]
                text = b" ".join([raw[x:y] for x, y in kept]).decode("utf-8", "replace")
                out.append((b - a, b - a - len(kept), [{"begin": x, "end": y} for x, y in ranges[row]], text))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        spans = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        return pa.table([table.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], spans), pa.array(cols[3], pa.string())], names=["doc_id", "n_words", "n_removed", "spans", "text"])

    return remove_repeats(docs, Unit(words=True, width=width, gram=min(GRAM, width)), solve, finish, REMOVED)
