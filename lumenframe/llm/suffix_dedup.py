"""Suffix-array deduplication of byte strings, by linear grouping construction.

The suffix array of a block of passages is built over phrases: substrings cut
where a hash of the eight bytes before is zero modulo PHRASE, so that equal
bytes are cut alike.  Suffixes are first grouped by their longest Lyndon prefix:
groups are processed in descending order, and each extends the contexts that
end where its members begin, found by previous-smaller pointers.  Then each
group's order is emitted by one ascending pass over the array, as a suffix is
ordered within its group by the suffix that follows its Lyndon prefix; nothing
is renamed or sorted recursively.

Strings that occur twice are read off the array: two strings of `width` bytes are
equal if they agree up to their first phrase border, and all neighbours between
their suffixes from there have a common prefix that reaches their end.  What is
found so is then compared byte by byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lumenframe.llm import _text
from lumenframe.llm._repeats import Unit, remove_repeats

WIDTH, GRAM, PHRASE, CONTEXT = 400, 32, 24, 8
REMOVED = "doc_id long, n_bytes long, n_removed long, spans array<struct<begin:long,end:long>>, kept binary"


def suffix_array(symbols: list[int]) -> list[int]:
    """Positions of all suffixes in ascending order; the end of the text orders before every symbol."""
    n = len(symbols)
    if not n:
        return []
    group, end = [0] * n, list(range(1, n + 1))
    members: list[list[int]] = []
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(symbols):
        by_symbol.setdefault(c, []).append(i)
    for c in sorted(by_symbol):
        for i in by_symbol[c]:
            group[i] = len(members)
        members.append(by_symbol[c])
    above, below = list(range(1, len(members) + 1)), list(range(-1, len(members) - 1))
    above[-1] = -1
    top = len(members) - 1
    final = [False] * n
    smaller = list(range(-1, n))  # the open suffix whose context ends here
    now, lowest = top, 0
    while now >= 0:
        own = [i for i in members[now] if group[i] == now]
        members[now] = own
        for i in own:
            final[i] = True
        longer: dict[int, dict[int, list[int]]] = {}
        for i in own:
            j = smaller[i]
            if j < 0 or final[j]:
                continue
            times, at = 1, end[i]
            while at < n and group[at] == now:
                times += 1
                at = end[at]
            end[j] = at
            smaller[at] = j
            longer.setdefault(group[j], {}).setdefault(times, []).append(j)
        for old, splits in longer.items():
            place = old
            for times in sorted(splits):
                new, after = len(members), above[place]
                members.append(splits[times])
                for j in splits[times]:
                    group[j] = new
                above.append(after)
                below.append(place)
                above[place] = new
                if after >= 0:
                    below[after] = new
                place = new
        now = below[now]
    slot, at, now = [0] * len(members), 0, lowest
    while now >= 0:
        slot[now] = at
        at += len(members[now])
        now = above[now]
    order = np.argsort(np.array(end), kind="stable").tolist()
    first = np.searchsorted(np.array(end)[order], np.arange(n + 2)).tolist()
    array = [0] * n
    for j in order[first[n] : first[n + 1]]:
        array[slot[group[j]]] = j
        slot[group[j]] += 1
    for r in range(n):
        i = array[r]
        for j in order[first[i] : first[i + 1]]:
            g = group[j]
            array[slot[g]] = j
            slot[g] += 1
    return array


def common_prefixes(symbols: list[int], array: list[int], starts: np.ndarray, stops: np.ndarray, data: np.ndarray, width: int) -> np.ndarray:
    """For each suffix in the array, the bytes it shares with the one before, exact below width; starts and stops are the symbols' bytes."""
    n = len(symbols)
    rank = [0] * n
    for r, i in enumerate(array):
        rank[i] = r
    whole = np.zeros(n, np.int64)  # phrases in common
    h = 0
    for i in range(n):
        r = rank[i]
        if not r:
            h = 0
            continue
        j = array[r - 1]
        while i + h < n and j + h < n and symbols[i + h] == symbols[j + h]:
            h += 1
        whole[r] = h
        h = max(h - 1, 0)
    at = np.array(array)
    before = np.concatenate([at[:1], at[:-1]])
    size = np.concatenate([[0], np.cumsum(stops - starts)])
    common = size[at + whole] - size[at]
    # The first phrases that differ may begin alike.
    open_ = np.flatnonzero((common < width) & (np.maximum(at, before) + whole < n))
    open_ = open_[open_ > 0]
    a, b = starts[(at + whole)[open_]], starts[(before + whole)[open_]]
    room = np.minimum(stops[(at + whole)[open_]] - a, stops[(before + whole)[open_]] - b)
    t = 0
    while len(open_):
        fine = room > t
        open_, a, b, room = open_[fine], a[fine], b[fine], room[fine]
        fine = data[a + t] == data[b + t]
        open_, a, b, room = open_[fine], a[fine], b[fine], room[fine]
        common[open_] += 1
        t += 1
    common[0] = 0
    return common


def least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo : hi]) of each range, none empty."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        step = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
    level = np.frexp(hi - lo)[1] - 1
    out = np.empty(len(lo), values.dtype)
    for k, own in enumerate(table):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(own[lo[at]], own[hi[at] - (1 << k)])
    return out


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> bool:
    """Whether data has the same width bytes at a and b throughout; a is ascending, and runs that go on in both are read once."""
    if not len(a):
        return True
    new = np.ones(len(a), bool)
    new[1:] = (np.diff(a) != 1) | (np.diff(b) != 1)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(a))) + width - 1
    upto = np.cumsum(size)
    k = 0
    while k < len(first):
        to = max(k + 1, int(np.searchsorted(upto, upto[k] - size[k] + 2_000_000, "right")))
        own = size[k:to]
        inside = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        if (data[np.repeat(a[first[k:to]], own) + inside] != data[np.repeat(b[first[k:to]], own) + inside]).any():
            return False
        k = to
    return True


def solve(segments: list[bytes], width: int) -> list[np.ndarray]:
    """For each segment, the starts of windows of width bytes that occur elsewhere among all segments."""
    sizes = np.array([len(s) for s in segments])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    raw = b"".join(segments)
    data = np.frombuffer(raw, np.uint8)
    n = len(data)
    sums = _text.prefix_sums(data)
    inverse = _text.powers(_text._IP, n + 1)
    # Phrase borders: where the bytes before say so, and both ends of each segment.
    near = np.zeros(n + 1, np.uint64)
    near[CONTEXT:] = _text.mix((sums[CONTEXT:] - sums[: n + 1 - CONTEXT]) * inverse[: n + 1 - CONTEXT])
    cut = near % np.uint64(PHRASE) == 0
    inside = np.arange(n + 1) - np.concatenate([np.repeat(begins, sizes), [n]])
    cut[inside < CONTEXT] = False
    natural = cut.copy()
    cut[begins] = cut[n] = True
    start = np.flatnonzero(cut)[:-1]
    stop = np.append(start[1:], n)
    # Names of phrases, in the order of their bytes.
    phrases = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, n).astype("<i8")), pa.py_buffer(raw)]).dictionary_encode()
    order = pc.sort_indices(phrases.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    # After each segment's phrases comes an end of its own, below all phrases.
    owner = np.searchsorted(ends, start, "right")
    place = np.arange(len(start)) + owner
    last = np.searchsorted(start, ends) + np.arange(len(segments))
    symbols, starts, stops = np.empty(len(start) + len(segments), np.int64), *np.zeros((2, len(start) + len(segments)), np.int64)
    symbols[place] = rank[phrases.indices.to_numpy()] + len(segments)
    symbols[last] = np.arange(len(segments))
    starts[place], stops[place] = start, stop
    array = suffix_array(symbols.tolist())
    common = common_prefixes(symbols.tolist(), array, starts, stops, data, width)
    rank_of = np.empty(len(array), np.int64)
    rank_of[array] = np.arange(len(array))
    # A window is ordered by the bytes up to the first border that its own bytes decide, then by the suffix from there.
    counts = sizes - width + 1
    firsts = np.cumsum(counts) - counts
    window = np.arange(counts.sum()) + np.repeat(begins - firsts, counts)
    borders = np.flatnonzero(natural)
    k = np.searchsorted(borders, window + CONTEXT)
    border = np.append(borders, 4 * n + width)[k]
    border = np.minimum(border, window + width)  # without one, all its bytes are its head
    rest = np.full(len(window), -1, np.int64)
    parted = border < window + width
    rest[parted] = rank_of[place[np.searchsorted(start, border[parted])]]
    head = _text.span_hashes(sums, window, border)
    order = np.lexsort((rest, head))
    lo, hi, left = rest[order[:-1]], rest[order[1:]], width - (border - window)[order[1:]]
    same = head[order[1:]] == head[order[:-1]]
    same &= left == width - (border - window)[order[:-1]]
    ask = np.flatnonzero(same & (left > 0))
    same[ask] = least_between(common, lo[ask] + 1, hi[ask] + 1) >= left[ask]
    # Windows that are the same follow each other; all are held against the first.
    leader = order[np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(order)), 0))]
    first = np.empty(len(window), np.int64)
    first[order] = leader
    others = np.flatnonzero(first != np.arange(len(window)))
    twice = np.zeros(len(window), bool)
    if same_bytes(data, window[others], window[first[others]], width):
        twice[others] = twice[first[others]] = True
    else:  # two heads have one hash: by the strings themselves
        seen: dict[bytes, int] = {}
        for w, at in enumerate(window.tolist()):
            one = seen.setdefault(raw[at : at + width], w)
            twice[w] = twice[one] = one != w or twice[one]
    return [np.flatnonzero(twice[a : a + c]) for a, c in zip(firsts.tolist(), counts.tolist(), strict=True)]


def suffix_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed runs of bytes), kept (the remaining bytes) for each row of docs.

    A byte of the UTF-8 text goes if a string of `width` bytes that covers it starts
    anywhere else as well; matches do not cross rows, and repeated rows lose such
    strings in every copy.  Strings are judged on the input, byte by byte.  A null text
    is empty.  A long text is a step of its own, in about sixty times its bytes.
    kept need not be valid UTF-8.
    """

    def finish(table: pa.Table, ranges: list) -> pa.Table:
        data, offsets = _text.utf8(table.column("text"))
        cols: list[list] = [[], [], [], []]
        for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            kept, last = [], a
            for x, y in ranges[row]:
                kept.append(data[last : a + x].tobytes())
                last = a + y
            kept.append(data[last:b].tobytes())
            out = b"".join(kept)
            for col, v in zip(cols, (b - a, b - a - len(out), [{"begin": x, "end": y} for x, y in ranges[row]], out), strict=True):
                col.append(v)
        spans = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        return pa.table([table.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], spans), pa.array(cols[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return remove_repeats(docs, Unit(words=False, width=width, gram=min(GRAM, width)), solve, finish, REMOVED)
