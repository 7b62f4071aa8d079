import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.llm import _repeats, _spark, line_dedup, substring_dedup, suffix_dedup

BLANK = " \t\n\x0b\f\r"


def word_list(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def brute_windows(rows, width):
    """Marks of units in repeated windows, for lists or bytes."""
    seen = Counter(tuple(u[i : i + width]) for u in rows for i in range(len(u) - width + 1))
    out = []
    for u in rows:
        gone = [False] * len(u)
        for i in range(len(u) - width + 1):
            if seen[tuple(u[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append(gone)
    return out


def as_rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_lines(odd, odd_rows):
    keys = defaultdict(set)
    last = 1 << 63
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(BLANK).translate(lower)
    for d, t, *_ in odd_rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                keys[key(line)].add(last if d is None else d)
    want = []
    for d, t, *_ in odd_rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= 10 and min(keys[key(x)]) != (last if d is None else d))]
        want.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    got = as_rows(line_dedup.line_dedup(odd), "doc_id", "n_lines", "n_dropped", "text")
    assert got == sorted(want, key=repr)
    few = as_rows(line_dedup.line_dedup(odd, salts=1), "doc_id", "n_lines", "n_dropped", "text")
    assert few == got


def test_lines_keep_other_columns(odd, none):
    out = line_dedup.apply_bitmaps(odd, line_dedup.drop_bitmaps(odd))
    assert out.columns == odd.columns and out.count() == odd.count()
    assert line_dedup.line_dedup(none).count() == 0


@pytest.mark.parametrize("width", [35, 5])
def test_words(odd, odd_rows, width):
    rows = [word_list(r[1]) for r in odd_rows]
    want = []
    for r, w, gone in zip(odd_rows, rows, brute_windows(rows, width), strict=True):
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        want.append((r[0], len(w), sum(gone), b" ".join(kept).decode()))
    got = substring_dedup.substring_dedup(odd, width)
    assert as_rows(got, "doc_id", "n_words", "n_removed", "text") == sorted(want, key=repr)


@pytest.mark.parametrize("width", [400, 60])
def test_bytes(odd, odd_rows, width):
    rows = [(r[1] or "").encode() for r in odd_rows]
    want = []
    for r, b, gone in zip(odd_rows, rows, brute_windows(rows, width), strict=True):
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want.append((r[0], len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in suffix_dedup.suffix_dedup(odd, width).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_nothing(none):
    assert substring_dedup.substring_dedup(none).count() == 0
    assert suffix_dedup.suffix_dedup(none).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40))
def test_suffix_array(symbols):
    assert suffix_dedup.suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=12, max_size=80).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6))
def test_solvers(segments):
    brute = Counter(s[i : i + 12] for s in segments for i in range(len(s) - 11))
    want = [[i for i in range(len(s) - 11) if brute[s[i : i + 12]] > 1] for s in segments]
    assert [x.tolist() for x in suffix_dedup.solve(segments, 12)] == want
    words = [b" ".join(b"w%d" % x for x in s) for s in segments]
    assert [x.tolist() for x in substring_dedup.solve(words, 12)] == want


def test_solvers_on_prose():
    rng = np.random.default_rng(7)
    passages = [bytes(rng.integers(97, 123, n, np.uint8)) for n in (500, 90, 300, 64)]
    noise = lambda n: bytes(rng.integers(97, 123, n, np.uint8))
    segments = [noise(int(rng.integers(0, 80))) + passages[int(rng.integers(4))][int(rng.integers(20)) :] + noise(80) for _ in range(60)] + [b"a" * 300, passages[0] + passages[0]]
    brute = Counter(s[i : i + 60] for s in segments for i in range(len(s) - 59))
    want = [[i for i in range(len(s) - 59) if brute[s[i : i + 60]] > 1] for s in segments]
    assert [x.tolist() for x in suffix_dedup.solve(segments, 60)] == want


def test_greedy_factors():
    text = b"a b c d e f x a b c d e y c d e f z q"
    reference = substring_dedup.Reference([text], 8)
    at, factors = 0, []
    while at < 19:
        factors.append(int(reference.longest(np.array([at]))[0]))
        at += max(1, factors[-1])
    assert factors == [5, 1, 0, 5, 0, 4, 0, 0]
    # "c d e f" crosses the end of the first factor and is looked up there.
    assert np.flatnonzero(substring_dedup.repeated_windows(reference, 4)).tolist() == [0, 1, 2, 7, 8, 13]


def test_common_prefixes():
    data = np.frombuffer(b"abcabdabcabe", np.uint8)
    starts, stops = np.array([0, 3, 6, 9]), np.array([3, 6, 9, 12])
    array = suffix_dedup.suffix_array([0, 1, 0, 2])
    assert array == [0, 2, 1, 3] and suffix_dedup.common_prefixes([0, 1, 0, 2], array, starts, stops, data, 99).tolist() == [0, 5, 2, 2]
    assert suffix_dedup.least_between(np.array([5, 3, 4, 9]), np.array([0, 1, 2, 0]), np.array([1, 4, 4, 4])).tolist() == [5, 3, 4, 3]


def test_what_decides(monkeypatch, odd, odd_rows):
    """Without the greedy parse, or the array's common prefixes, nothing is found."""
    monkeypatch.setattr(substring_dedup.Reference, "longest", lambda self, at: np.zeros(len(at), np.int64))
    monkeypatch.setattr(suffix_dedup, "common_prefixes", lambda symbols, array, *_: np.zeros(len(array), np.int64))
    words = [b"p q r s t u v", b"x q r s t u y"]
    assert not any(len(x) for x in substring_dedup.solve(words, 4))
    rng = np.random.default_rng(1)
    one = bytes(rng.integers(97, 123, 400, np.uint8))
    assert not any(len(x) for x in suffix_dedup.solve([b"x" + one, b"y" + one + b"z"], 300))


@pytest.mark.parametrize("operator", ["words", "bytes"])
def test_hot_passage(spark, operator, monkeypatch):
    """A passage in many documents, each with other words around it; its minimisers are hot."""
    rng = random.Random(11)
    own = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    passage = own(30)
    texts = [f"{own(9)} {passage} {own(9)}" for _ in range(60)] + [own(40) for _ in range(30)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(_repeats, "HOT_RUNS", 20)
    monkeypatch.setattr(_repeats, "BLOCK_UNITS", 200)
    monkeypatch.setattr(_spark, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(_repeats.chunked, "__defaults__", (4000,))
    if operator == "words":
        rows = [word_list(t) for t in texts]
        got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(frame, 20).collect()}
        want = brute_windows(rows, 20)
    else:
        got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.suffix_dedup(frame, 150).collect()}
        want = brute_windows([t.encode() for t in texts], 150)
    assert got == {d: sum(x) for d, x in enumerate(want)} and got[0] > 0
