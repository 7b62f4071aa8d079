"""Retrieval packing: sequences whose documents are lexical neighbours.

Documents are tokenised once.  Whole windows of a long document are sequences of
their own; what remains is an item that carries its token terms (and, for the
document frequencies, the windows' other terms) and the CRCs of its prefixes at
every GRAIN tokens, so that it can later be cut without its ids.

Items are dealt to shards by content: they are ordered by their rarest terms that
another document has as well (the route), so that copies and documents about the
same rare things lie side by side, and each range of about SHARD_ITEMS items is a
shard.  As the order ends with the row, a route that very many items share goes
to several shards.  A shard holds a BM25 inverted index of its items, with
document frequencies of all documents; each seed's query returns unused
neighbours, which fill its window greedily; the one that no longer fits is cut
and starts the next window.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import _text
from lumenframe.llm._spark import group_arrow, map_arrow, saved, trim

WINDOW, GRAIN, SHARD_ITEMS, K1, B = 4096, 32, 2048, 1.2, 0.75
#: Shards that a task packs one after the other; rarest terms of a route.
TASK_SHARDS, ROUTE = 4, 4
#: Terms of more items of a shard than one in so many are scored as rows of a matrix.
COMMON = 16
#: Follows the ids of every document.
END_ID = 2
#: Distinct words whose ids a worker keeps between two steps, and bytes of text of a step.
CACHE_WORDS, STEP = 150_000, 1 << 19
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ITEMS = "row long, doc_id long, n long, whole binary, prefixes binary, terms binary, counts binary, more binary"
# Fixed value: how the tokenizer's file splits words.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Letters (ASCII and U+00C0 to U+00FF), ASCII signs but the apostrophe, and digits: the tokenizer always parts a text between two classes, and two digits.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = 2
_CLASS[48:58] = 3
#: By the product of two neighbours' classes.
_PARTED = np.isin(np.arange(10), [2, 3, 6, 9])
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Second bytes of the letters from U+00C0 on, whose first one is 0xC3, and of the capitals among them.
_LATIN = np.isin(np.arange(256), [b for b in range(0x80, 0xC0) if chr(b + 0x40).isalpha()])
_CAPITAL = _LATIN & (np.arange(256) < 0x9F)
#: First bytes from here on are of U+0300 and beyond, where marks are that join the letter before; what comes of it differs by case.
_MARKS = 0xCC
#: Words that the BPE model takes at once.
GROUP = 100


def _folded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes with small letters, but for letters that a mark may follow, and the class of each byte."""
    out, kind = _FOLD[data], _CLASS[data]
    if not len(data):
        return out, kind
    lead = np.flatnonzero((data[:-1] == 0xC3) & _LATIN[data[1:]])
    kind[lead] = kind[lead + 1] = 1
    capital = lead[_CAPITAL[data[lead + 1]]] + 1
    out[capital] += 32
    marked = np.flatnonzero(data[1:] >= _MARKS)
    out[marked] = data[marked]
    return out, kind


class WordEncoder:
    """The ids of words (bytes without white space), as the tokenizer gives them; kept by 64-bit hash of the word.

    The tokenizer never joins two words, nor letters and signs, so a text's ids are
    those of such parts.  The store is a sorted array of hashes beside all ids in a
    row; when it is full, what the last step did not use goes.
    Plain words go to its BPE model in groups, without the costly normaliser; all
    others go through the tokenizer as they are.  Words of one class are cut out,
    handed over and taken back as arrays.
    """

    def __init__(self, path: str):
        # A task has one core: threads only add CPU time and memory of their own.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.split = regex.compile(PIECE)
        self.last = np.zeros(self.whole.get_vocab_size() + 1, bool)
        for token, i in self.whole.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        # The byte alphabet: printable bytes stand for themselves, the others follow from 256 on.
        same = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in set(same)]
        self.alphabet = {b: chr(b) for b in same} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.letters = np.array([ord(self.alphabet[b]) for b in range(256)], "<u4")
        #: Sorted hashes; word k's ids are flat[begins[k] : begins[k] + sizes[k]].
        self.keys, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.uint16)
        self.begins, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _slow(self, word: str) -> bytes:
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u2").tobytes()

    def _ids(self, words: list[bytes]) -> Iterator[bytes]:
        """Little-endian 16-bit ids of each word."""
        split: list[list[str] | bytes] = []
        new: set[str] = set()
        pieces: dict[str, bytes] = {}
        for w in words:
            s = w.decode("utf-8", "replace")
            if s.isascii():
                if s.isalpha():
                    parts = [s.lower()]
                elif "<|" in s or not s.isprintable():
                    split.append(self._slow(s))
                    continue
                else:
                    parts = self.split.findall(s.lower())
            elif "<|" in s or not s.isprintable() or max(s) >= "\u0250" or any(c in s for c in "\u0130\u0085\u00a0\u00ad"):
                split.append(self._slow(s))
                continue
            else:
                s = s.lower()
                parts = [s] if s.isalpha() else self.split.findall(s)
            split.append(parts)
            new.update(parts)
        todo = list(new)
        mapped = [p.encode().decode("latin-1").translate(self.alphabet) for p in todo]
        flat, sizes = self._bpe([" ".join(mapped[i : i + GROUP]) for i in range(0, len(mapped), GROUP)])
        raw, ends = flat.tobytes(), (np.cumsum(sizes) * 2).tolist()
        for p, x, y in zip(todo, [0, *ends], ends, strict=False):
            pieces[p] = raw[x:y]
        for parts in split:
            yield parts if isinstance(parts, bytes) else pieces[parts[0]] if len(parts) == 1 else b"".join([pieces[p] for p in parts])

    def _bpe(self, groups: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of pieces in the model's alphabet, several in a string with a space between two, and the number of each piece's."""
        out = self.model.encode_batch_fast(groups, add_special_tokens=False)
        flat = np.fromiter(chain.from_iterable(x.ids for x in out), np.uint16)
        return flat, np.diff(np.flatnonzero(self.last[flat]), prepend=-1)

    def _plain(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words of one class, and the number of each word's."""
        size = ends - starts + 1
        upto = np.cumsum(size)
        at = np.arange(upto[-1]) + np.repeat(starts - upto + size, size)
        at[upto - 1] = 0
        chars = self.letters[data[at]]
        chars[upto - 1] = ord(" ")
        text = chars.tobytes().decode("utf-32-le")
        borders = [0, *upto[GROUP - 1 : -1 : GROUP].tolist(), len(text)]
        return self._bpe([text[x : y - 1] for x, y in zip(borders[:-1], borders[1:], strict=True)])

    def _store(self, used: np.ndarray, keys: np.ndarray, flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> None:
        """Take in the ids of new keys (sorted, not yet stored); a full store first drops all but the used keys."""
        if len(self.keys) + len(keys) > CACHE_WORDS:
            keep = np.isin(self.keys, used, assume_unique=True)
            size = self.sizes[keep]
            upto = np.cumsum(size) - size
            self.flat = self.flat[np.arange(size.sum()) + np.repeat(self.begins[keep] - upto, size)]
            self.keys, self.begins, self.sizes = self.keys[keep], upto, size
        at = np.searchsorted(self.keys, keys)
        self.keys, self.sizes = np.insert(self.keys, at, keys), np.insert(self.sizes, at, sizes)
        self.begins = np.insert(self.begins, at, begins + len(self.flat))
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows' texts, each text followed by END_ID, and len + 1 offsets."""
        raw = data.tobytes()
        if b"<|" in raw:  # there may be special tokens, which are what they are as a whole
            kind = np.zeros(len(data), np.uint8)
            starts, ends, first = _text.words(data, offsets)
        else:
            data, kind = _folded(data)
            starts, ends, first = _text.words(data, offsets, borders=_PARTED[kind[1:] * kind[:-1]])
        keys, where, which = np.unique(_text.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        missing = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(missing):
            b, e = starts[where[missing]], ends[where[missing]]
            odd = np.concatenate([[0], np.cumsum(kind == 0)])
            odd = odd[b] < odd[e]
            flat, sizes = np.zeros(0, np.uint16), np.zeros(len(missing), np.int64)
            if not odd.all():
                flat, sizes[~odd] = self._plain(data, b[~odd], e[~odd])
            begins = np.cumsum(sizes) - sizes
            if odd.any():
                new = list(self._ids([raw[x:y] for x, y in zip(b[odd].tolist(), e[odd].tolist(), strict=True)]))
                size = np.array([len(x) // 2 for x in new], np.int64)
                sizes[odd], begins[odd] = size, len(flat) + np.cumsum(size) - size
                flat = np.concatenate([flat, np.frombuffer(b"".join(new), np.uint16)])
            self._store(keys, keys[missing], flat, begins, sizes)
        slot = np.searchsorted(self.keys, keys)[which]
        begins, size, flat = self.begins[slot], self.sizes[slot], self.flat
        upto = np.concatenate([[0], np.cumsum(size)])
        rows = upto[first] + np.arange(len(first))
        out = np.full(rows[-1], END_ID, np.uint32)
        fill = np.arange(upto[-1])
        row = np.repeat(np.arange(len(first) - 1), np.diff(upto[first]))
        out[fill + row] = flat[fill + np.repeat(begins - upto[:-1], size)]
        return out, rows


@lru_cache(maxsize=1)
def worker_encoder(tokenizer: str) -> WordEncoder:
    """A worker's only encoder: a function of the module, as what a nested one refers to is sent, and made anew, with each task."""
    return WordEncoder(tokenizer)


def token_items(docs: DataFrame, tokenizer: str) -> DataFrame:
    """An item for each row of docs; a null text is empty and has the end id alone."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        crc, row, most = zlib.crc32, TaskContext.get().partitionId() << 40, WINDOW * 4
        for batch in batches:
            data, offsets = _text.utf8(batch.column(1))
            for i, j in _text.steps(offsets, STEP):
                every, at = encoder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                cols: list[list] = [[], [], [], [], [], [], []]
                raw, bounds = every.astype("<u4").tobytes(), (at * 4).tolist()
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    n = (b - a) // 4
                    rest = a + n // WINDOW * most
                    whole = array("I", [crc(raw[x : x + most]) for x in range(a, rest, most)])
                    prefixes, c = array("I"), 0
                    for x in range(rest, b, GRAIN * 4):
                        c = crc(raw[x : min(x + GRAIN * 4, b)], c)
                        prefixes.append(c)
                    terms, counts = np.unique(every[rest // 4 : b // 4], return_counts=True)
                    more = np.setdiff1d(every[a // 4 : rest // 4], terms) if rest > a else terms[:0]
                    for col, v in zip(cols, (row, n, whole.tobytes(), prefixes.tobytes(), terms.astype("<u2").tobytes(), counts.astype("<u2").tobytes(), more.astype("<u2").tobytes()), strict=True):
                        col.append(v)
                    row += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), batch.column(0)[i:j], pa.array(cols[1], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[2:])],
                    names=["row", "doc_id", "n", "whole", "prefixes", "terms", "counts", "more"],
                )

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), items, ITEMS)


def document_frequencies(items: DataFrame, vocabulary: int) -> np.ndarray:
    """In how many documents each token id occurs; the result is as large as the vocabulary, not as the input."""
    part = 4096
    slices = -(-vocabulary // part)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slices * part, np.int64)
        for batch in batches:
            for column in batch.columns:  # no term is in both
                for terms in column:
                    total[np.frombuffer(terms.as_py(), "<u2")] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([x.tobytes() for x in total.reshape(slices, part)], pa.binary())], names=["slice", "counts"])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": [total.tobytes()]})

    out = group_arrow(map_arrow(items.select("terms", "more"), partial, "slice int, counts binary"), ["slice"], merge, "slice int, counts binary")
    total = np.zeros((slices, part), np.int64)
    for r in out.collect():
        total[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    return total.ravel()


def routed(items: DataFrame, df: np.ndarray) -> DataFrame:
    """items with route: its ROUTE rarest terms that another document has too, the rarest first, as bytes that sort so."""
    shared = np.flatnonzero(df > 1)
    rank = np.zeros(len(df), ">u2")
    rank[shared[np.argsort(df[shared], kind="stable")]] = np.arange(len(shared))
    fine = df > 1

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [np.frombuffer(x, "<u2") for x in batch.column(batch.schema.get_field_index("terms")).to_pylist()]
            routes = [np.sort(rank[t[fine[t]]])[:ROUTE].tobytes() for t in every]
            yield batch.append_column("route", pa.array(routes, pa.binary()))

    return map_arrow(items, route, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in items.schema)}, route binary")


_ZEROS = bytes(WINDOW * 4)


def range_crc(prefix: int, until: int, length: int) -> int:
    """CRC of `length` ids whose preceding ids have the CRC prefix, and prefix and range together until."""
    zeros = _ZEROS[: length * 4]
    return until ^ zlib.crc32(zeros, prefix) ^ zlib.crc32(zeros, 0)


class Index:
    """BM25 inverted index of one shard's items; terms that many items have are rows of a matrix, all others posting lists."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], lengths: np.ndarray, df: np.ndarray, n: int, mean: float):
        self.size, self.queries = len(terms), terms
        owner = np.repeat(np.arange(self.size), [len(t) for t in terms])
        term = np.concatenate(terms).astype(np.int64) if terms else np.zeros(0, np.int64)
        tf = np.concatenate(counts).astype(np.float32) if counts else np.zeros(0, np.float32)
        idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
        weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[owner] / mean))).astype(np.float32)
        order = np.argsort(term, kind="stable")
        term, self.owner, self.weight = term[order], owner[order].astype(np.int32), weight[order]
        self.first = np.searchsorted(term, np.arange(len(df) + 1))
        common = np.flatnonzero(np.diff(self.first) > max(64, self.size // COMMON))
        self.place = np.full(len(df), -1, np.int64)
        self.place[common] = np.arange(len(common))
        self.matrix = np.zeros((self.size, len(common)), np.float32)
        many = self.place[term] >= 0
        self.matrix[self.owner[many], self.place[term[many]]] = self.weight[many]

    def scores(self, item: int) -> np.ndarray:
        """The item's BM25 scores as a query, for all items."""
        terms = self.queries[item]
        place = self.place[terms]
        asked = np.zeros(self.matrix.shape[1], np.float32)
        asked[place[place >= 0]] = 1
        spans = [slice(self.first[t], self.first[t + 1]) for t in terms[place < 0].tolist()]
        out = self.matrix @ asked
        if spans:
            out = out + np.bincount(np.concatenate([self.owner[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.size)
        return out

    def neighbours(self, item: int, unused: np.ndarray) -> list[int]:
        """Unused items that share a term with the seed, best first; ties to the smaller item."""
        few = np.flatnonzero(unused)
        scores = self.scores(item)[few]
        order = np.argsort(-scores, kind="stable")
        return few[order[: np.count_nonzero(scores > 0)]].tolist()


def fill_windows(lengths: np.ndarray, index: Index) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of (item, start, length); every token of every item is in exactly one."""
    unused = lengths > 0
    seeds = iter(np.flatnonzero(unused).tolist())
    carry: tuple[int, int] | None = None
    while True:
        window: list[tuple[int, int, int]] = []
        space, near = WINDOW, iter(())
        if carry:
            item, start = carry
            window.append((item, start, int(lengths[item]) - start))
            space -= int(lengths[item]) - start
            near, carry = iter(index.neighbours(item, unused)), None
        while space >= GRAIN:
            item = next((x for x in near if unused[x]), None)
            if item is None:
                item = next((x for x in seeds if unused[x]), None)
                if item is None:
                    break
                unused[item] = False
                near = iter(index.neighbours(item, unused))
            unused[item] = False
            n = int(lengths[item])
            take = n if n <= space else space // GRAIN * GRAIN
            window.append((item, 0, take))
            space -= take
            if take < n:
                carry = (item, take)
                break
        if not window:
            return
        yield window


def pack(docs: DataFrame, tokenizer: str, vocabulary: int = 49408) -> DataFrame:
    """The pieces of all rows of docs: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every row lies in exactly one piece; a sequence has 4096 ids at
    most.  Rows, also repeated ones and those without doc_id, are packed each for
    itself; a null or empty text is the end id alone.
    """
    items = saved(token_items(docs, tokenizer))
    n, tokens = items.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df, mean = document_frequencies(items, vocabulary), max(1.0, tokens / max(n, 1))
    names = [x.split()[0] for x in PIECES.split(", ")]

    def packed(table: pa.Table, sequence: int) -> tuple[pa.RecordBatch, int]:
        """The pieces of a shard's items, and the next free sequence id."""
        ids, total = table.column("doc_id").to_pylist(), table.column("n").to_numpy()
        whole, prefixes, terms, counts = (
            [np.frombuffer(x, t) for x in table.column(c).to_pylist()] for c, t in (("whole", "<u4"), ("prefixes", "<u4"), ("terms", "<u2"), ("counts", "<u2"))
        )
        rest = total % WINDOW
        out: list[tuple] = []
        for d, n_tokens, crcs in zip(ids, total.tolist(), whole, strict=True):
            for k, c in enumerate(crcs.tolist()):
                out.append((d, k * WINDOW, WINDOW, c, n_tokens, sequence, 0))
                sequence += 1
        for window in fill_windows(rest, Index(terms, counts, rest, df, n, mean)):
            offset = 0
            for item, start, length in window:
                until = int(prefixes[item][-(-(start + length) // GRAIN) - 1])
                c = range_crc(int(prefixes[item][start // GRAIN - 1]), until, length) if start else until
                n_tokens = int(total[item])
                out.append((ids[item], n_tokens - int(rest[item]) + start, length, c, n_tokens, sequence, offset))
                offset += length
            sequence += 1
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 7)], names=names), sequence

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_encoder.cache_clear()  # a worker that has tokenised needs its memory for the shards now
        trim()
        sequence, held = TaskContext.get().partitionId() << 40, []
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= 2 * SHARD_ITEMS:
                table = pa.Table.from_batches(held)
                out, sequence = packed(table.slice(0, SHARD_ITEMS), sequence)
                yield out
                held = table.slice(SHARD_ITEMS).combine_chunks().to_batches()
        if held:
            yield packed(pa.Table.from_batches(held), sequence)[0]

    order = ["route", "row"]
    near = routed(items.drop("more"), df).repartitionByRange(n // (TASK_SHARDS * SHARD_ITEMS) + 1, *order).sortWithinPartitions(*order)
    return map_arrow(near, shards, PIECES)
