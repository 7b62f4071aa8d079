"""What each filter removes, in every order of the filters.

All orders form a trie: an edge applies one more filter to what is left.  The trie
is walked depth first; each node's survivors are a persisted DataFrame that the
next filter is applied to.  What is left does not depend on the order in which the
same filters came, so nodes with the same set of filters are one state, executed
once (32 states for the 326 nodes of five filters), and only the states on the
path from the root are persisted at a time.  The edges out of a state are counted
from its survivors together, by part; the counts go to the shared folder.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm._spark import remove, saved
from lumenframe.session import shared_dir

#: White space, and the signs of filter D.
SPACE, SIGNS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
#: When a document fails a filter, in the columns of measures().
FILTERS: dict[str, Column | str] = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_upper > 3 * n_chars",
    "D": "signs",
    "E": "copy",
}


def measures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, and what the filters look at, for each row of docs.

    A null text is empty, a null lang the part "".  copy: a row with a smaller
    doc_id has the same text; a row without doc_id comes after all others, and rows
    of one doc_id are no copies of each other.  Labels of one doc_id are joined by
    or; a row without doc_id has none.  A text is held whole by its task.  Of docs
    doc_id, text and lang are read, of labels doc_id, quality and toxic.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    own = saved(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), words.alias("words")).select(
            "doc_id",
            "part",
            F.size("words").cast("long").alias("n_words"),
            F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
            F.char_length("text").cast("long").alias("n_chars"),
            F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
            F.col("text").rlike(SIGNS).alias("signs"),
            F.unhex(F.sha2("text", 256)).alias("digest"),
        )
    )
    # Only texts that two rows have can be copies; the others need no partner in the join.
    # They are written first, so that the join deals both of its sides and can split a text that a third of all rows have.
    firsts = saved(own.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).filter("rows > 1 and first is not null").drop("rows"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    return (
        own.join(firsts, "digest", "left")
        .join(marks, "doc_id", "left")
        .select(
            "part",
            *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")),
            "n_words",
            "n_distinct",
            "n_chars",
            "n_upper",
            "signs",
            (F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))).alias("copy"),
        )
    )


def audit(rows: DataFrame, filters: Mapping[str, Column | str] = FILTERS) -> DataFrame:
    """A row for each part, filter_order (all orders of the filters' letters) and step, zeros included.

    rows has part, good, toxic and the columns of the filters: conditions under
    which a row fails; a condition that is null fails nobody.  Counts are of rows
    of the part: kept after the step, removed by it, redundant (failing its filter,
    but removed before), unique_fails (failing its filter only), good_lost and
    toxic_lost among the removed, and shapley (rows that its filter removes, summed
    over all orders).  An empty table gives no rows.
    """
    spark = rows.sparkSession
    letters = sorted(filters)
    fails = {f: F.coalesce(F.expr(c) if isinstance(c, str) else c, F.lit(False)) for f, c in filters.items()}
    folder = f"{shared_dir(spark)}/filter-audit-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/rows")
    root = spark.read.schema(rows.schema).parquet(f"{folder}/rows")
    done: set[frozenset[str]] = set()

    def edge(f: str, state: frozenset[str]) -> Column:
        """The counts of the edge that applies f; those of the failing ones only where all filters are still to come."""
        alone = fails[f]
        for g in letters:
            alone = alone & ~fails[g] if g != f else alone
        return F.struct(
            F.lit(f).alias("letter"),
            F.count_if(~fails[f]).alias("kept"),
            F.count_if(fails[f]).alias("removed"),
            F.count_if(fails[f] & F.col("good")).alias("good_lost"),
            F.count_if(fails[f] & F.col("toxic")).alias("toxic_lost"),
            (F.lit(0).cast("long") if state else F.count_if(alone)).alias("unique_fails"),
        )

    def visit(state: frozenset[str], survivors: DataFrame) -> None:
        """Count the edges out of a state, and go down those whose end was not reached by another order."""
        done.add(state)
        ahead = [f for f in letters if f not in state]
        if not ahead:
            return
        survivors.persist()
        counts = survivors.groupBy("part").agg(F.array(*(edge(f, state) for f in ahead)).alias("edges"))
        # A row for each part, so that one file is enough.
        counts.select("part", F.lit(_name(state)).alias("state"), F.inline("edges")).coalesce(1).write.mode("append").parquet(f"{folder}/edges")
        for f in ahead:
            if state | {f} not in done:
                visit(state | {f}, survivors.filter(~fails[f]))
        survivors.unpersist()

    visit(frozenset(), root)
    edges = spark.read.parquet(f"{folder}/edges")
    base = edges.filter(F.col("state") == "").select("part", "letter", F.col("removed").alias("fails"), "unique_fails")
    orders = [(f, "".join(order), step + 1, _name(order[:step])) for order in itertools.permutations(letters) for step, f in enumerate(order)]
    # As many rows as orders times steps, whatever the input.
    steps = F.broadcast(spark.createDataFrame(orders, "letter string, filter_order string, step int, state string"))
    zero = F.lit(0).cast("long")
    counted = (
        base.join(steps, "letter")
        .join(edges.drop("unique_fails"), ["part", "state", "letter"], "left")
        .select("part", "filter_order", "step", "letter", *(F.coalesce(c, zero).alias(c) for c in ("kept", "removed")), (F.col("fails") - F.coalesce("removed", zero)).alias("redundant"), "unique_fails", *(F.coalesce(c, zero).alias(c) for c in ("good_lost", "toxic_lost")))
        .withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter")))
    )
    out = saved(counted.drop("letter"))
    remove(spark, folder)
    return out


def _name(state: Iterable[str]) -> str:
    return "".join(sorted(state))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """audit() of the five filters over all documents."""
    return audit(measures(docs, labels))
