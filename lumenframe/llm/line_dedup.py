"""Line deduplication with DataFrame functions alone.

Lines become fixed-size rows (128-bit key hash, document, position), which are
written first, so that texts are split once; texts are not shuffled for it.  A first range partitioning by hash and salt, sorted by
document and position, streams the first document of each hash and salt with a
window.  The salt splits a key that a large share of all documents hold; every
salt then sends only its first document's lines to a second range partitioning
by hash alone, which streams the first document of all.  The result is one
compressed bitmap for each document that loses lines: 64-bit words, of which
those without a dropped line are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm._spark import saved, unused

#: What is stripped from both ends of a line to get its key.
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The documents of one key are dealt to so many groups before its first document is sought.
SALTS = 32


def line_key(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _owned(docs: DataFrame) -> DataFrame:
    """doc (doc_id, where null orders last) and row_hash tell rows apart; equal rows share them and get equal results."""
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("row_hash"), "text")


def _later() -> Column:
    """Whether doc comes after first."""
    return F.col("first").isNotNull() & (F.col("doc").isNull() | (F.col("doc") > F.col("first")))


def drop_bitmaps(docs: DataFrame, min_chars: int = 10, salts: int = SALTS) -> DataFrame:
    """Columns doc, row_hash, words: array of struct(word, bits), where bit b of
    word w set means that line 64 * w + b is dropped; only documents that lose a line.

    A line goes if its key has min_chars code points or more, is found in two
    documents at least, and a smaller doc_id holds it.  Rows of one doc_id are
    one document; rows without doc_id are one document that comes last.  A null
    or empty text is one empty line, which has too short a key to go.
    """
    rows = saved(
        _owned(docs)
        .select("doc", "row_hash", F.posexplode(_lines(F.col("text"))).alias("at", "line"))
        .select("doc", "row_hash", "at", line_key(F.col("line")).alias("key"))
        .filter(F.char_length("key") >= min_chars)
        .select(
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit("second"), "key").alias("h2"),
            F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int").alias("salt"),
            "doc",
            "row_hash",
            "at",
        )
    )
    order = [F.col("doc").asc_nulls_last(), "at"]
    near = Window.partitionBy("h1", "h2", "salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near_first = rows.repartitionByRange("h1", "h2", "salt").withColumn("first", F.first("doc").over(near))
    far = Window.partitionBy("h1", "h2").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = (
        near_first.filter(F.col("doc").eqNullSafe(F.col("first")))
        .select("h1", "h2", "doc", "row_hash", "at")
        .repartitionByRange("h1", "h2")
        .withColumn("first", F.first("doc").over(far))
    )
    gone = near_first.filter(_later()).select("doc", "row_hash", "at").unionByName(heads.filter(_later()).select("doc", "row_hash", "at"))
    return (
        gone.groupBy("doc", "row_hash", F.shiftright("at", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, at & 63))").alias("bits"))
        .groupBy("doc", "row_hash")
        .agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
    )


def _with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> tuple[DataFrame, str]:
    """docs and a column of the name given: the bitmap's words from 0 to its last, null if no line goes."""
    doc, row_hash, bits = (unused(docs, c) for c in ("doc", "row_hash", "bits"))
    dense = bitmaps.select(
        F.col("doc").alias(doc),
        F.col("row_hash").alias(row_hash),
        # Words without a dropped line are filled in, each from the step between two that have one.
        F.expr(
            "flatten(transform(words, (x, i) -> concat(array_repeat(0L, int(x.word - if(i = 0, -1, words[i - 1].word)) - 1), array(x.bits))))"
        ).alias(bits),
    )
    same = docs["doc_id"].cast("long").eqNullSafe(dense[doc]) & (F.xxhash64(docs["text"]) == dense[row_hash])
    return docs.join(dense, same, "left").drop(doc, row_hash), bits


def _kept(bits: str) -> Column:
    return F.when(F.col(bits).isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(
            F.filter(
                _lines(F.col("text")),
                lambda x, i: F.coalesce(F.get(bits, F.shiftright(i, 6)), F.lit(0).cast("long")).bitwiseAND(_bit(i)) == 0,
            ),
            "\n",
        )
    )


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.bitwiseAND(63))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with the dropped lines taken out of text; all other columns stay as they are.  A null text stays null."""
    out, bits = _with_bitmaps(docs, bitmaps)
    return out.withColumn("text", F.when(F.col("text").isNotNull(), _kept(bits))).select(docs.columns)


def line_dedup(docs: DataFrame, min_chars: int = 10, salts: int = SALTS) -> DataFrame:
    """Columns doc_id, n_lines, n_dropped, text: the text without the lines that an earlier document holds.

    The rows of docs, each once, also repeated ones; of its columns only doc_id and
    text are read.  A null text counts as one empty line and gives an empty text.
    A text is held whole by its task while its lines are joined; its lines are rows.
    """
    docs = docs.select("doc_id", "text")
    out, bits = _with_bitmaps(docs, drop_bitmaps(docs, min_chars, salts))
    return out.select(
        "doc_id",
        F.size(_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a + F.bit_count(x)), F.lit(0).cast("long")).alias("n_dropped"),
        _kept(bits).alias("text"),
    )
