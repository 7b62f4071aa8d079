"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Test items are handled in blocks of bounded size, a stated query set against all
documents.  All n-grams of an item are seeds.  Passages of documents are joined to
items by these seeds; those with enough of an item's words to reach the score are
aligned with it locally, which tolerates replaced, missing and added words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import _text
from lumenframe.llm._spark import map_arrow, unused

SEED_WORDS, MIN_SCORE = 3, 0.5
#: Items, and bytes of their texts, of a block that goes to every task, about; a longer item is a block with few others.
ITEM_BLOCK, ITEM_BYTES = 20_000, 8 << 20
#: Smith-Waterman: what an equal word adds, and what another word or a gap takes.
MATCH, MISMATCH, GAP = 2, -1, -1
ALIGN_BATCH = 128
FOUND = "doc_id long, item_id long, score double, begin long, end long"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Blanks and ASCII signs part words here, so that edits of punctuation do not count.
BORDERS = _text.SPACE.copy()
BORDERS[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def _hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = _LOWER[data]
    starts, ends, first = _text.words(data, offsets, BORDERS)
    return _text.word_hashes(data, starts, ends), first


@dataclass
class Items:
    """A block of items: their word hashes, and for each seed hash the items and positions that have it."""

    ids: list
    words: list[np.ndarray]
    seeds: np.ndarray
    owners: np.ndarray
    places: np.ndarray

    def __post_init__(self) -> None:
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.seeds & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in grams, position in seeds' distinct values) of all grams that are seeds."""
        at = np.flatnonzero(self.filter[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
        k = np.searchsorted(self.seeds, grams[at])
        fine = (k < len(self.seeds)) & (self.seeds[np.minimum(k, len(self.seeds) - 1)] == grams[at])
        return at[fine], k[fine]


def index_items(rows: list[tuple[int, str]], n: int) -> Items:
    """All n-grams of the items are seeds."""
    rows = sorted({(i, t) for i, t in rows if t is not None}, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    raw = [t.encode() for _, t in rows]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    hashes, first = _hashed_words(np.frombuffer(b"".join(raw), np.uint8), offsets)
    grams, at = _text.grams(hashes, first, n)
    owners = np.repeat(np.arange(len(rows)), np.diff(at))
    places = np.arange(len(grams)) - at[owners] if len(grams) else np.zeros(0, np.int64)
    order = np.lexsort((places, owners, grams))
    return Items([i for i, _ in rows], [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)], grams[order], owners[order], places[order])


def align(queries: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair, and the column at which it ends (exclusive)."""
    rows, cols = max(map(len, queries)), max(map(len, passages))
    q, p = np.zeros((len(queries), rows), np.uint64), np.ones((len(queries), cols), np.uint64)
    for a, b, x, y in zip(q, p, queries, passages, strict=True):
        a[: len(x)], b[: len(y)] = x | np.uint64(2), y | np.uint64(2)
    slope = np.arange(cols) * -GAP
    before = np.zeros((len(queries), cols + 1), np.int32)
    best, end = np.zeros(len(queries), np.int32), np.zeros(len(queries), np.int64)
    for i in range(rows):
        diagonal = before[:, :-1] + np.where(q[:, i : i + 1] == p, MATCH, MISMATCH)
        row = np.maximum(np.maximum(diagonal, before[:, 1:] + GAP), 0)
        row = np.maximum.accumulate(row + slope, axis=1) - slope  # gaps within the row
        top = row.argmax(1)
        score = row[np.arange(len(row)), top]
        end = np.where(score > best, top + 1, end)
        best = np.maximum(best, score)
        before[:, 1:] = row
    return best, end


def _passages(items: Items, hashes: np.ndarray, first: np.ndarray, n: int) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, begin, end) of the passages that two different seeds of an item support."""
    grams, at = _text.grams(hashes, first, n)
    where, k = items.hits(grams)
    if not len(where):
        return
    upto = np.searchsorted(items.seeds, items.seeds[k], "right")
    times = upto - k
    entry = np.repeat(k, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    where = np.repeat(where, times)
    row = np.searchsorted(at, where, "right") - 1
    place = where - at[row]
    item, own = items.owners[entry], items.places[entry]
    order = np.lexsort((place, item, row))
    row, item, place, own = row[order], item[order], place[order], own[order]
    size = np.array([len(w) for w in items.words])[item]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (place[1:] - place[:-1] > size[1:])
    starts = np.flatnonzero(new)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(row)], strict=True):
        if len(np.unique(own[a:b])) < min(2, size[a] - n + 1):
            continue
        slack = int(size[a]) // 2
        lead, tail = int((place[a:b] - own[a:b]).min()), int((place[a:b] - own[a:b]).max())
        length = int(first[row[a] + 1] - first[row[a]])
        lead, tail = max(int(place[a]) - int(size[a]), lead), min(int(place[b - 1]), tail)
        yield int(row[a]), int(item[a]), max(0, lead - slack), min(length, max(tail, lead) + int(size[a]) + slack)


def _can_reach(words: np.ndarray, passage: np.ndarray, min_score: float) -> bool:
    """Whether so many of the item's words occur in the passage that an alignment could have min_score."""
    return int(np.isin(words, passage).sum()) / len(words) >= min_score


def _search(docs: DataFrame, items: Items, n: int, min_score: float) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _text.utf8(batch.column(1))
            ids = batch.column(0).to_pylist()
            for i, j in _text.steps(offsets):
                hashes, first = _hashed_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                found: dict[tuple[int, int], tuple] = {}
                todo = sorted((x for x in _passages(items, hashes, first, n) if _can_reach(items.words[x[1]], hashes[first[x[0]] + x[2] : first[x[0]] + x[3]], min_score)), key=lambda x: x[3] - x[2])
                for at in range(0, len(todo), ALIGN_BATCH):
                    part = todo[at : at + ALIGN_BATCH]
                    scores, ends = align([items.words[x[1]] for x in part], [hashes[first[x[0]] + x[2] : first[x[0]] + x[3]] for x in part])
                    for (row, item, begin, _), s, e in zip(part, scores.tolist(), ends.tolist(), strict=True):
                        share = s / (MATCH * len(items.words[item]))
                        if share >= min_score:
                            got = (share, -begin, begin, begin + e)
                            found[row, item] = max(found.get((row, item), got), got)
                out = [(ids[i + row], items.ids[item], x[0], x[2], x[3]) for (row, item), x in sorted(found.items())]
                cols = list(zip(*out, strict=True)) if out else [[]] * 5
                types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "item_id", "score", "begin", "end"])

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), search, FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = SEED_WORDS, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, item_id, score, begin, end: passages (in words) of rows of docs that hold a test item or an edited copy.

    score is the alignment's score by that of an unchanged copy.  Null and empty
    texts on either side match nothing, nor do items of fewer than n words; equal
    items count once; repeated rows of docs are searched each for itself.  Of passages
    with equal scores the first counts.  Texts are searched whole; each block of items
    is one scan of docs.
    """
    spark = docs.sparkSession
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull())
    n_items, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(n_items // ITEM_BLOCK, size // ITEM_BYTES) + 1
    found = spark.createDataFrame([], FOUND)
    for b in range(blocks):
        own = [(r["item_id"], r["text"]) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]
        items = index_items(own, n)
        if len(items.seeds):
            found = found.unionByName(_search(docs, items, n, min_score))
    return found


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id is in no finding; rows without doc_id stay.

    Null and empty texts have no findings, so they stay, and so do repeated rows if one does.
    """
    name = unused(docs, "found")
    found = contaminated(docs, benchmark, **settings).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found, docs["doc_id"].cast("long") == F.col(name), "left_anti")
