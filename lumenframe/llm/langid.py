"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams (subwords; a run
of blanks counts as one border), followed by a linear layer.  Both are trained by
stochastic gradient descent in numpy on a bounded sample of labelled rows.  As
everything up to the softmax is linear, prediction folds the two layers into one
table of class weights for each bucket.  A temperature is fitted on rows kept
back from training.

Rejection is calibrated on the same rows, by two tests: the calibrated score, and
how familiar the text is, which is the mean log frequency of its subwords in
training against what is usual for so many subwords.  (A softmax alone is sure of
languages that it has never met.)  Each threshold is the score that all but
REJECT_SHARE of the kept-back rows with a right prediction reach, so a few odd rows
do not switch rejection off.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import _text
from lumenframe.llm._spark import map_arrow, trim

BUCKET_BITS, DIMS, ORDERS, EPOCHS, RATE = 15, 16, (3, 4), 5, 8.0
#: About so many labelled rows are taken for training and calibration.
SAMPLE_ROWS = 4000
#: Fewer, if the bags of so many would take more bytes than this in the driver, by the lengths of all labelled texts.
SAMPLE_BYTES = 96 << 20
#: The most that one bag takes: a number of two bytes and a share of four for each bucket.
BAG_BYTES = 6 << BUCKET_BITS
#: Share of right kept-back rows that each test may reject, and the slack below in standard deviations of familiarity.
REJECT_SHARE, SLACK = 0.005, 2.0
#: No calibrated score above this is rejected.
SURE = 0.9
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[_text.SPACE] = 32
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def subwords(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of the n-gram that starts at each byte, and which of them lie in one row."""
    folded = _FOLD[data]
    n = len(folded)
    for k, order in enumerate(ORDERS):
        if n < order:
            yield np.zeros(0, np.uint32), np.zeros(0, bool)
            continue
        h = np.full(n - order + 1, 0x165667B1 * (k + 1) & 0xFFFFFFFF, np.uint32)
        for j in range(order):
            h ^= folded[j : n - order + 1 + j] * _MULTIPLIERS[j]
            h *= np.uint32(0x2C1B3C6D)
        fine = np.ones(len(h), bool)
        for j in range(1, order):  # those that begin less than `order` bytes before a border
            cut = offsets[1:-1] - j
            fine[cut[(cut >= 0) & (cut < len(h))]] = False
        yield h >> np.uint32(32 - BUCKET_BITS), fine


@dataclass
class Model:
    """table has a column of weights for each language, and at last the log frequency of each bucket."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    #: Mean familiarity, its variance and that part which falls with the number of subwords, and the least one accepted.
    usual: tuple[float, float, float] = (0.0, 1.0, 0.0)
    least: float = -np.inf

    def sums(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Means of the table's columns over each text's subwords, and how many these are."""
        rows, wide = len(offsets) - 1, self.table.shape[1]
        total, count = np.zeros((rows, wide)), np.zeros(rows)
        filled = np.flatnonzero(np.diff(offsets))
        for h, fine in subwords(data, offsets):
            if not len(h) or not len(filled):
                continue
            weights = np.zeros((len(data), wide), np.float32)
            weights[: len(h)] = self.table[h]
            weights[: len(h)][~fine] = 0
            total[filled] += np.add.reduceat(weights, offsets[filled], axis=0, dtype=np.float64)
            one = np.zeros(len(data), np.int64)
            one[: len(h)] = fine
            count[filled] += np.add.reduceat(one, offsets[filled])
        return total / np.maximum(count, 1)[:, None], count

    def judged(self, means: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities, a row for each text (even ones without subwords), and standardised familiarity."""
        z = (means[:, :-1] + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        mean, fixed, falling = self.usual
        return z / z.sum(1, keepdims=True), (means[:, -1] - mean) / np.sqrt(fixed + falling / np.maximum(count, 1))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.judged(*self.sums(data, offsets))


#: A text as its buckets, the share of its subwords that each has, and how many these are.
Bag = tuple[np.ndarray, np.ndarray, int]


def bag(text: bytes) -> Bag:
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for h, fine in subwords(np.frombuffer(text, np.uint8), np.array([0, len(text)])):
        counts += np.bincount(h[fine], minlength=1 << BUCKET_BITS)
    at = np.flatnonzero(counts)
    return at, (counts[at] / max(1, counts.sum())).astype(np.float32), int(counts.sum())


def train(bags: list[Bag], langs: list[str], seed: int = 0) -> Model | None:
    """None if there is no row to learn from."""
    names = sorted(set(langs))
    if not names:
        return None
    y = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(bags))
    kept, fit = order[: len(order) // 5], order[len(order) // 5 :]
    emb = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMS)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (DIMS, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    steps, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            at, w, _ = bags[i]
            rate = RATE * (1 - done / steps)
            done += 1
            if not len(at):
                continue
            hidden = w @ emb[at]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            emb[at] -= rate * w[:, None] * (out @ p)
            out -= 0.05 * rate * np.outer(hidden, p)
            bias -= 0.01 * rate * p
    seen = sum((np.bincount(bags[i][0], bags[i][1], 1 << BUCKET_BITS) for i in fit), np.zeros(1 << BUCKET_BITS))
    rarity = np.log2((seen + 1e-7 * max(len(fit), 1)) / max(len(fit), 1))
    model = Model(names, np.column_stack([emb @ out, rarity]).astype(np.float32), bias)
    if not len(kept):
        return model
    return calibrated(model, [bags[i] for i in kept], y[kept])


def calibrated(model: Model, bags: list[Bag], y: np.ndarray) -> Model:
    """model with the temperature and thresholds that rows kept back from training give."""
    means, count = np.array([w @ model.table[at] for at, w, _ in bags]), np.array([n for *_, n in bags])
    rows = np.arange(len(y))

    def loss(t: float) -> float:
        return -np.log(np.maximum(replace(model, temperature=t).judged(means, count)[0][rows, y], 1e-12)).mean()

    model = replace(model, temperature=float(min(np.geomspace(0.1, 10, 41), key=loss)))
    p, _ = model.judged(means, count)
    right = (p.argmax(1) == y) & (count > 0)
    if not right.any():
        return model
    familiar, one = means[right, -1], 1 / count[right]
    apart = (familiar - np.median(familiar)) ** 2
    # Squared distances as a + b / n, without the hundredth that lies furthest off.
    near = apart <= np.quantile(apart, 0.99)
    b, a = np.polyfit(one[near], apart[near], 1) if np.ptp(one[near]) > 0 else (0.0, apart[near].mean())
    model = replace(model, usual=(float(np.median(familiar)), float(max(a, 1e-4)), float(max(b, 0.0))))
    p, z = model.judged(means[right], count[right])
    at = np.quantile(p.max(1), REJECT_SHARE), np.quantile(z, REJECT_SHARE)
    return replace(model, threshold=min(SURE, float(at[0])), least=float(at[1]) - SLACK)


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32(doc_id as text) mod folds; null for a null doc_id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def fit_language_id(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Learns from text and non-null lang of rows outside fold 0; about sample_rows of them, chosen by a hash of doc_id.

    Their bags of subwords come to the driver, each of at most BAG_BYTES.  The share of
    rows drawn is lowered where all bags together, by the lengths of all labelled texts,
    would make it more than sample_bytes; in the order of the hash, no more rows are
    taken than twice sample_rows, and none after the bags have reached twice sample_bytes.
    """
    usable = docs.select("doc_id", "text", "lang").filter((fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    size = F.least(F.octet_length("text").cast("long") * (6 * len(ORDERS)), F.lit(BAG_BYTES))
    n, whole = usable.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    draw = F.xxhash64(F.lit("language sample"), "doc_id")
    share = min(1.0, sample_rows / max(n, 1), sample_bytes / max(whole, 1))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [bag(t.encode()) for t in batch.column(2).to_pylist()]
            cols = [pa.array([at.astype("<u2").tobytes() for at, _, _ in made], pa.binary()), pa.array([w.tobytes() for _, w, _ in made], pa.binary()), pa.array([k for *_, k in made], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["draw", "lang", "buckets", "shares", "n"])

    drawn = usable.filter(F.pmod(draw, F.lit(1 << 30)) < int(share * (1 << 30))).select(draw.alias("draw"), "lang", "text")
    rows = map_arrow(drawn, bags, "draw long, lang string, buckets binary, shares binary, n long").orderBy("draw", "lang", "buckets", "shares").limit(2 * sample_rows)
    # Arrays over the bytes as they come; what the driver took for them is given back.
    own, langs, held = [], [], 0
    for r in rows.select("lang", "buckets", "shares", "n").toLocalIterator():
        own.append((np.frombuffer(r["buckets"], "<u2"), np.frombuffer(r["shares"], np.float32), r["n"]))
        langs.append(r["lang"])
        held += len(r["buckets"]) + len(r["shares"])
        if held > 2 * sample_bytes:
            break
    model = train(own, langs)
    del own
    trim()
    return model


def _judged(data: np.ndarray, offsets: np.ndarray, model: Model | None) -> tuple[list[str], np.ndarray, list[bool]]:
    """Language, score and acceptance of each text."""
    names: list[str] = []
    scores: list[np.ndarray] = []
    familiar: list[np.ndarray] = []
    for i, j in _text.steps(offsets, _text.STEP_BYTES // 2):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        sums = np.concatenate([[0], np.cumsum(_LETTER[part])])
        letters = sums[at[1:]] > sums[at[:-1]]
        for k in np.flatnonzero(~letters):
            letters[k] = any(map(str.isalpha, part[at[k] : at[k + 1]].tobytes().decode("utf-8", "replace")))
        if model is None:
            names += [UNKNOWN] * (j - i)
            scores.append(np.zeros(j - i))
            familiar.append(np.zeros(j - i))
            continue
        p, own = model.scores(part, at)
        familiar.append(own)
        best = p.argmax(1)
        names += [model.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
        scores.append(np.where(letters, p[np.arange(j - i), best], 0.0))
    score = np.concatenate(scores) if scores else np.zeros(0)
    if model is None:
        return names, score, [False] * len(names)
    fine = (score >= model.threshold) & (np.concatenate([*familiar, np.zeros(0)]) >= model.least)
    return names, score, [n != UNKNOWN and bool(ok) for n, ok in zip(names, fine, strict=True)]


def language_id(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for each row of docs.

    `und`, score 0 and not accepted if the text is null or has no letter, or if
    there was nothing to learn from.  held_out is false for a null doc_id.  Of
    languages with equal scores the first by name is told.  Repeated rows are judged
    each for itself.  A text is judged whole, and takes its task some forty bytes
    for each of its own.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, accepted = _judged(*_text.utf8(batch.column(2)), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "accepted"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text")
    return map_arrow(rows, predict, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def crc_fold(doc_id: int, folds: int = 5) -> int:
    """fold() for a single value, for tests."""
    return zlib.crc32(str(doc_id).encode()) % folds


def known_language(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, with all their columns, whose language is told with enough confidence."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _text.utf8(batch.column(batch.schema.get_field_index("text")))
            _, _, accepted = _judged(data, offsets, model)
            yield batch.filter(pa.array(accepted, pa.bool_()))

    return map_arrow(docs, keep, docs.schema)
