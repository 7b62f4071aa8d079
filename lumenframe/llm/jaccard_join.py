"""N-gram Jaccard join by MinHash banding.

Texts with the same set of n-grams of words are one class, found by a 128-bit
hash of the set with map-side aggregation; only one member of each class goes on.
Band and row counts are chosen for a target recall.  Rows are shuffled on their
band hashes.  Within a bucket, a first round verifies each member against the one
that meets most others in all its buckets, which resolves large groups of near
copies in linear work.  In buckets whose members are still in different
components, a class can have a link only if enough of its n-grams occur in any
other class there; those that can, and are outside their leader's component, are
held against the bucket's members block by block, and each returns one link to
every other component it reaches.  So each pair that shares a bucket is in one
component or known to be below the threshold, and rows stay in proportion to
members.  Links are counted once components are known: a component's classes are
dealt to blocks, and each pair of blocks is one task's work that compares all its
pairs and gives counts, so no group's pairs are emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import _text
from lumenframe.llm._components import components
from lumenframe.llm._spark import group_arrow, map_arrow, saved, unused

WORDS, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.998, 128
#: Classes and n-grams of one block of a component, about.
BLOCK_SETS, BLOCK_GRAMS = 2048, 2_000_000


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): as many rows as most_hashes allows while a pair at the threshold shares a bucket with this probability."""
    for rows in range(most_hashes, 0, -1):
        hit = threshold**rows
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-hit))) if hit < 1 else 1
        if bands * rows <= most_hashes:
            return bands, rows
    raise ValueError("most_hashes is too small for this recall")


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct n-gram hashes in order, and len + 1 offsets.

    A row with fewer than n words, but one, has its whole word sequence as its only n-gram.
    """
    starts, ends, first = _text.words(data, offsets)
    hashes = _text.word_hashes(data, starts, ends)
    grams, at = _text.grams(hashes, first, n)
    out = []
    counts = np.diff(first)
    for i, few in enumerate(counts < n):
        if not few:
            out.append(np.unique(grams[at[i] : at[i + 1]]))
        elif counts[i]:
            g, _ = _text.grams(hashes[first[i] : first[i + 1]], np.array([0, counts[i]]), int(counts[i]))
            out.append(_text.mix(g + np.uint64(counts[i])))
        else:
            out.append(np.zeros(0, np.uint64))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def _set_hashes(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for salt in (0x51ED270B, 0xB492B66FBE98F273):
        sums = np.zeros(len(sets) + 1, np.uint64)
        np.cumsum(_text.mix(sets ^ np.uint64(salt)), out=sums[1:])
        both.append((sums[at[1:]] - sums[at[:-1]]).astype(np.int64))
    return both[0], both[1]


def _band_hashes(sets: np.ndarray, at: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """bands columns for each row that has n-grams."""
    rng = np.random.default_rng(5)
    factors = rng.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    addends = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)
    filled = at[:-1][np.diff(at) > 0]
    x = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(filled), bands), np.int64)
    h = np.empty_like(x)
    for b in range(bands):
        key = np.full(len(filled), b + 1, np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            np.multiply(x, factors[k], out=h)
            h += addends[k]
            key = _text.mix(key) + np.minimum.reduceat(h, filled) if len(filled) else key
        out[:, b] = _text.mix(key).astype(np.int64)
    return out


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """row, key, doc_id, n_grams, s1, s2, bands for each row of docs; key is doc_id or, where that is null, a hash of the text."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets = _text.utf8(batch.column(2))
            for i, j in _text.steps(offsets):
                sets, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
                s1, s2 = _set_hashes(sets, at)
                hashes = _band_hashes(sets, at, bands, rows)
                ends = np.concatenate([[0], np.cumsum((np.diff(at) > 0) * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + j - i)), batch.column(0)[i:j], batch.column(1)[i:j], pa.array(np.diff(at)), pa.array(s1), pa.array(s2), pa.ListArray.from_arrays(ends, pa.array(hashes.ravel()))],
                    names=["row", "key", "doc_id", "n_grams", "s1", "s2", "bands"],
                )
                row += j - i

    return map_arrow(_keyed(docs), sign, "row long, key long, doc_id long, n_grams long, s1 long, s2 long, bands array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.xxhash64("text")).alias("key"), doc_id.alias("doc_id"), "text")


def _gram_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """cls and grams of the wanted classes (cls, key, n_grams, s1, s2)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _text.utf8(batch.column(0))
            for i, j in _text.steps(offsets):
                grams, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
                s1, s2 = _set_hashes(grams, at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.diff(at)), pa.array(s1), pa.array(s2), pa.ListArray.from_arrays(at.astype(np.int32), pa.array(grams.astype(np.int64)))],
                    names=["n_grams", "s1", "s2", "grams"],
                )

    texts = _keyed(docs).join(wanted.select("key").distinct(), "key", "left_semi").select("text")
    found = map_arrow(texts, sets, "n_grams long, s1 long, s2 long, grams array<long>")
    return found.join(wanted.select("cls", "n_grams", "s1", "s2"), ["n_grams", "s1", "s2"]).dropDuplicates(["cls"]).select("cls", "grams")


def _able(sets: DataFrame, threshold: float) -> DataFrame:
    """The classes (cls) of which a share of threshold n-grams or more occur in another of these classes.

    Two classes that reach the threshold share that many n-grams, so all others have
    no link here.  N-grams travel in blocks, not as rows.
    """
    entries = sets.agg(F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()[0]
    shards = int(entries // 2_000_000) + 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            grams = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            cls = np.repeat(batch.column(0).to_numpy(), lists.value_lengths().to_numpy())
            home = (grams.view(np.uint64) >> np.uint64(33)).astype(np.int64) % shards
            order = np.argsort(home, kind="stable")
            ends = np.searchsorted(home[order], np.arange(shards + 1))
            parts = [(h, order[ends[h] : ends[h + 1]]) for h in np.flatnonzero(np.diff(ends)).tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in parts], pa.int32()), pa.array([grams[k].tobytes() for _, k in parts], pa.binary()), pa.array([cls[k].tobytes() for _, k in parts], pa.binary())],
                names=["shard", "grams", "cls"],
            )

    def judge(key: tuple, table: pa.Table) -> pa.Table:
        grams, cls = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("grams", "cls"))
        order = np.argsort(grams, kind="stable")
        same = grams[order][1:] == grams[order][:-1]
        twice = np.zeros(len(grams), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        found, times = np.unique(cls[twice], return_counts=True)
        return pa.table({"cls": found, "n": times})

    sent = map_arrow(sets.select("cls", "grams"), send, "shard int, grams binary, cls binary")
    counts = group_arrow(sent, ["shard"], judge, "cls long, n long").groupBy("cls").agg(F.sum("n").alias("n"))
    return sets.select("cls", F.size("grams").alias("size")).join(counts, "cls").filter(F.col("n") >= F.lit(threshold - 1e-9) * F.col("size")).select("cls")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose n-gram sets have a Jaccard similarity of threshold or more, with it."""
    both = pairs.join(sets.select(F.col("cls").alias("u"), F.col("grams").alias("a")), "u").join(sets.select(F.col("cls").alias("v"), F.col("grams").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.select("u", "v", (common / (F.size("a") + F.size("b") - common)).alias("jaccard")).filter(F.col("jaccard") >= threshold)


def _common(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> np.ndarray:
    """How many n-grams each set of a shares with each set of b, of no meaning for a set and itself; a set's n-grams are distinct."""
    na, nb = len(a_at) - 1, len(b_at) - 1
    names, times = np.unique(a, return_counts=True)
    names = names[times > 1] if a is b else np.intersect1d(names, b)
    out = np.zeros((na, nb), np.float32)
    if not len(names):
        return out

    def entries(grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        name = np.minimum(np.searchsorted(names, grams), len(names) - 1)
        fine = names[name] == grams
        row, name = np.repeat(np.arange(len(at) - 1), np.diff(at))[fine], name[fine]
        order = np.argsort(name, kind="stable")
        return row[order], name[order], np.searchsorted(name[order], np.arange(len(names) + 1))

    (ra, ka, fa), (rb, kb, fb) = entries(a, a_at), entries(b, b_at)
    # N-grams that many sets have go through matrices, all others through their pairs of sets.
    many = np.diff(fa) * np.diff(fb) > 4096
    rare = np.flatnonzero(~many[ka])
    size = np.diff(fb)[ka[rare]]
    upto = np.concatenate([[0], np.cumsum(size)])
    i = 0
    while i < len(rare):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + 4_000_000, "right")) - 1)
        at = np.arange(upto[i], upto[j]) + np.repeat(fb[ka[rare[i:j]]] - upto[i:j], size[i:j])
        out += np.bincount(np.repeat(ra[rare[i:j]], size[i:j]) * nb + rb[at], minlength=na * nb).reshape(na, nb)
        i = j
    wide = np.cumsum(many) - 1
    for lo in range(0, int(many.sum()), 2048):
        x, y = np.zeros((na, 2048), np.float32), np.zeros((nb, 2048), np.float32)
        for m, row, name in ((x, ra, ka), (y, rb, kb)):
            own = many[name] & (wide[name] >= lo) & (wide[name] < lo + 2048)
            m[row[own], wide[name[own]] - lo] = 1
        out += x @ y.T
    return out


def _links(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each set of a, and for each of b, how many of the other side reach the threshold."""
    common, sizes = _common(a, a_at, b, b_at), np.diff(b_at)
    if a is b:
        np.fill_diagonal(common, 0)
    left, right = np.zeros(len(a_at) - 1, np.int64), np.zeros(len(sizes), np.int64)
    for i in range(0, len(left), 256):
        part = common[i : i + 256].astype(np.float64)
        hit = part / (np.diff(a_at)[i : i + 256, None] + sizes - part) >= threshold
        left[i : i + 256] = hit.sum(1)
        right += hit.sum(0)
    return left, right


def bucket_links(opened: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links u, v between components, of buckets' members (band, hash, cls, component, out).

    Each class that is out is compared with all members of its buckets; of its links
    to one other component it gives the one to the least class.
    """
    sized = saved(opened.join(sets.select("cls", F.size("grams").alias("grams")), "cls"))
    # Buckets with the same members are compared once.
    name = [F.sum(F.xxhash64(F.lit(salt), "cls", "out").cast("decimal(38,0)")).alias(f"s{salt}") for salt in (1, 2)]
    size = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("grams") / BLOCK_GRAMS)).cast("int").alias("blocks")
    buckets = (
        sized.groupBy("band", "hash").agg(F.count("*").alias("n"), F.sum("grams").alias("total"), size, *name)
        .groupBy("n", "s1", "s2").agg(F.min(F.struct("band", "hash")).alias("b"), F.first("blocks").alias("blocks"), F.first("total").alias("total"))
    )
    entries = buckets.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    shards = int(entries // BLOCK_GRAMS) + 1
    placed = (
        sized.join(buckets.select("b.band", "b.hash", "blocks"), ["band", "hash"])
        .withColumns({"bucket": F.xxhash64("band", "hash"), "own": F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"), "every": F.expr("sequence(0, blocks - 1)")})
    )
    home = F.when(F.col("blocks") > 1, F.col("bucket")).otherwise(F.pmod(F.col("bucket"), F.lit(shards)))
    columns = ["band", "hash", "cls", "component", home.alias("home")]
    asking = placed.filter("out").select(*columns, F.lit(0).alias("side"), F.col("own").alias("i"), F.explode("every").alias("j"))
    asked = placed.select(*columns, F.lit(1).alias("side"), F.explode("every").alias("i"), F.col("own").alias("j"))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("band", "hash", "side", "cls")]).combine_chunks()
        lists = table.column("grams").combine_chunks()
        grams, at = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        band, hashes, side, cls, component = (table.column(c).to_numpy() for c in ("band", "hash", "side", "cls", "component"))
        new = np.flatnonzero((band[1:] != band[:-1]) | (hashes[1:] != hashes[:-1])) + 1
        found = []
        for x, z in zip([0, *new.tolist()], [*new.tolist(), len(cls)], strict=True):
            y = x + int(np.searchsorted(side[x:z], 1))
            if x == y or y == z:
                continue
            a, b = at[x : y + 1], at[y : z + 1]
            common = _common(grams[a[0] : a[-1]], a - a[0], grams[b[0] : b[-1]], b - b[0]).astype(np.float64)
            hit = common / (np.diff(a)[:, None] + np.diff(b) - common) >= threshold
            u, v = np.nonzero(hit & (component[x:y, None] != component[None, y:z]))
            first = np.unique(np.stack([u, component[y + v]]), axis=1, return_index=True)[1]
            found.append((cls[x + u[first]], cls[y + v[first]]))
        u, v = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return pa.table({"u": u, "v": v})

    return group_arrow(asking.unionByName(asked).join(sets, "cls"), ["home", "i", "j"], compare, "u long, v long").distinct()


def link_counts(labels: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """cls and n_links of each class in labels (node, component), by its n-grams in sets: all pairs of a component are compared."""
    placed = labels.select(F.col("node").alias("cls"), "component")
    sizes = saved(
        sets.select("cls", F.size("grams").alias("grams")).join(placed, "cls")
        .groupBy("component").agg(F.count("*").alias("n"), F.sum("grams").alias("grams"))
    )
    entries = sizes.filter("n > 2").agg(F.coalesce(F.sum("grams"), F.lit(0))).first()[0]
    shards = int(entries // BLOCK_GRAMS) + 1
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_SETS, F.col("grams") / BLOCK_GRAMS)).cast("int")
    placed = placed.join(sizes.select("component", "n", blocks.alias("blocks")), "component")
    # Small components share groups, in which each is compared for itself.
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    groups = (
        placed.filter("n > 2").withColumn("block", own)
        .withColumn("other", F.explode(F.when(F.col("blocks") > 1, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(-1)))))
        .select(
            "cls", "component", "block",
            F.when(F.col("blocks") > 1, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(shards))).alias("home"),
            F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        )
    )

    def count(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        table = table.sort_by([("component", "ascending"), ("block", "ascending")]).combine_chunks()
        lists = table.column("grams").combine_chunks()
        grams, at = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        part = table.column("component" if i < 0 else "block").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]).tolist()
        n = np.zeros(len(part), np.int64)
        sides = [(grams[at[x] : at[y]], at[x : y + 1] - at[x], x, y) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        if i < 0 or i == j:
            for g, own_at, x, y in sides:
                n[x:y] = _links(g, own_at, g, own_at, threshold)[0]
        elif len(sides) == 2:
            (a, a_at, x, y), (b, b_at, _, z) = sides
            n[x:y], n[y:z] = _links(a, a_at, b, b_at, threshold)
        return pa.table({"cls": table.column("cls"), "n": n})

    counted = group_arrow(groups.join(sets, "cls"), ["home", "i", "j"], count, "cls long, n long")
    # Two classes in a component have the one link between them.
    pairs = placed.filter("n = 2").select("cls", F.lit(1).cast("long").alias("n"))
    return counted.unionByName(pairs).groupBy("cls").agg(F.sum("n").alias("n_links"))


def jaccard_join(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, labels, sets).

    members has for each row of docs: row, key, doc_id, cls (texts with the same n-gram
    set share it), component (linked classes share it).  labels has node and component
    of the classes that have a link, and sets the n-grams of all that share a bucket;
    link_counts takes both.  Rows without a word (null, empty) are alone.  Repeated rows are members of one class.  Words are as they stand,
    of whole texts.
    """
    bands, rows = choose_bands(threshold, recall)
    docs = docs.select("doc_id", "text")
    signed = saved(signatures(docs, n, bands, rows))
    classes = signed.filter("n_grams > 0").groupBy("n_grams", "s1", "s2").agg(F.min(F.struct("row", "key")).alias("least")).select(F.col("least.row").alias("cls"), F.col("least.key").alias("key"), "n_grams", "s1", "s2")
    buckets = (
        signed.select(F.col("row").alias("cls"), "bands")
        .join(classes.select("cls"), "cls")
        .select("cls", F.posexplode("bands").alias("band", "hash"))
    )
    shared = buckets.groupBy("band", "hash").agg(F.count("*").alias("size")).filter("size > 1")
    inside = saved(buckets.join(shared, ["band", "hash"]))
    met = inside.groupBy("cls").agg(F.sum("size").alias("met"))
    best = F.max(F.struct("met", (-F.col("cls")).alias("cls")))
    leaders = inside.join(met, "cls").groupBy("band", "hash").agg((-best["cls"]).alias("leader"))
    members = saved(inside.join(leaders, ["band", "hash"]).select("band", "hash", "leader", "cls"))
    sets = saved(_gram_sets(docs, classes.join(members.select("cls").distinct(), "cls", "left_semi"), n))
    stars = members.filter("cls != leader").select(F.least("leader", "cls").alias("u"), F.greatest("leader", "cls").alias("v")).distinct()
    links = saved(_verified(stars, sets, threshold))
    labels = saved(components(links))
    label = members.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    heads = labels.select(F.col("node").alias("leader"), F.col("component").alias("head"))
    label = label.join(heads, "leader", "left").withColumn("head", F.coalesce("head", "leader"))
    # Those outside their leader's component, and all members of their buckets.
    rest = label.filter("component != head")
    open_buckets = rest.select("band", "hash").distinct()
    opened = saved(label.join(open_buckets, ["band", "hash"]).select("band", "hash", "cls", "component", (F.col("component") != F.col("head")).alias("out")))
    able = _able(sets.join(opened.select("cls").distinct(), "cls", "left_semi"), threshold)
    opened = saved(opened.join(able, "cls", "left_semi"))
    more = saved(bucket_links(opened, sets, threshold))
    if not more.isEmpty():
        # The stars found before stand for the links they were made of.
        labels = saved(components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)))
    out = (
        signed.select("row", "key", "doc_id", "n_grams", "s1", "s2")
        .join(classes.select("n_grams", "s1", "s2", "cls"), ["n_grams", "s1", "s2"], "left")
        .select("row", "key", "doc_id", F.coalesce("cls", "row").alias("cls"))
        .join(labels.select(F.col("node").alias("cls"), "component"), "cls", "left")
        .select("row", "key", "doc_id", "cls", F.coalesce("component", "cls").alias("component"))
    )
    return out, labels, sets


def _marked(members: DataFrame) -> DataFrame:
    members = members.withColumn("order", F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    by_component = members.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.min("order").alias("first"))
    return members.join(by_component, "component").select("row", "key", "doc_id", "cls", "class_id", (F.col("order") == F.col("first")).alias("kept"))


def near_duplicates(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """row, key, doc_id, class_id, copy_id, n_links, kept for each row of docs.

    class_id and copy_id are the least doc_id of the row's component and of the
    rows with its n-gram set, n_links the other sets in its component that reach
    the threshold with that set, and kept marks one row of each component: that
    with the least doc_id and row.  Null and empty texts are alone, each row a
    component of its own; a row without doc_id is never the least one of a
    component that has a row with one.  A text is held whole in its task, in about
    twenty times its bytes.
    """
    members, labels, sets = jaccard_join(docs, n, threshold, recall)
    by_class = members.groupBy("cls").agg(F.min("doc_id").alias("copy_id"))
    return (
        _marked(members)
        .join(by_class, "cls")
        .join(link_counts(labels, sets, threshold), "cls", "left")
        .select("row", "key", "doc_id", "class_id", "copy_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "kept")
    )


def one_of_each(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of docs, with all their columns, of the document that each group of near copies keeps.

    Rows that share a doc_id, or have none and share the text, are one document.
    """
    found = _marked(jaccard_join(docs, n, threshold, recall)[0])
    stay = found.filter("kept").select("key")
    key = unused(docs, "key")
    gone = found.filter("not kept").select("key").distinct().join(stay, "key", "left_anti").withColumnRenamed("key", key)
    return docs.withColumn(key, F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(docs["text"]))).join(gone, key, "left_anti").select(docs.columns)
