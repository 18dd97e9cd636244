"""How document filters interact: what each removes in every order in which they can be applied.

All orders of the filters form a trie. A node of it is a prefix, and what has survived a prefix does
not depend on the prefix's order, so prefixes with the same filters share one state: a DataFrame of
survivors, persisted while the trie below it is walked and left out where it was met before. The
walk goes depth first, so at most as many states are persisted as there are filters. At each state
one aggregation counts, for every filter that is still to come, what it would remove: the edges of
the trie. With k filters that is 2^k - 1 aggregations for the k! orders.

A state is a narrow table (part, one flag a filter, one a label); texts are read once, before the
walk. Counts are written as tables and put together by a last plan, however many parts there are.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelgraph.sources.shared import delete, shared_dir

from . import util


def word_filters(text: Column) -> dict[str, Column]:
    """The failure conditions that look at a text alone; ``text`` must not be null."""
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * 50,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * 2,
        "D": text.rlike("[#$%&*|]"),
    }


def _copies(flagged: DataFrame, salts: int) -> DataFrame:
    """``flagged`` (with _id, _hash) and whether a smaller id has the same text.

    A group's rows are dealt over ``salts`` parts, of which only those that occur get a copy of the
    group's smallest id, so one text that is a third of all rows meets in no single task.
    """
    salted = flagged.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(salts)))
    part = salted.groupBy("_hash", "_salt").agg(F.min("_id").alias("_low"))
    low = part.groupBy("_hash").agg(F.min("_low").alias("_low"), F.collect_set("_salt").alias("_salts"))
    low = low.select("_hash", "_low", F.explode("_salts").alias("_salt"))
    return salted.join(low, ["_hash", "_salt"]).withColumn("_copy", F.col("_id") > F.col("_low")).drop("_hash", "_salt", "_low")


def flag_documents(docs: DataFrame, labels: DataFrame, salts: int = 64, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", marks: Mapping[str, Column] | None = None) -> DataFrame:
    """One row for each row of ``docs``: _part, a boolean for each filter A to E, and each mark.

    ``marks`` are conditions on columns of ``labels``; a document has a mark if one of its labels
    has. Null texts are empty ones, null parts the empty string. A null id is no copy and has no
    marks. Texts are read once and compared by their SHA-256 and length in bytes.
    """
    marks = marks or {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("_part"), text.alias("_text"))
    seen = own.select("_id", "_part", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("_hash"), *(c.alias(k) for k, c in word_filters(F.col("_text")).items()))
    seen = util.materialize(seen, "audit-texts")
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(*(F.coalesce(F.max(c), F.lit(False)).alias(k) for k, c in marks.items()))
    flagged = _copies(seen.where("_id is not null"), salts).withColumnRenamed("_copy", "E")
    with_id = flagged.join(known, "_id", "left").select("_part", *"ABCDE", *(F.coalesce(F.col(k), F.lit(False)).alias(k) for k in marks))
    without = seen.where("_id is null").select("_part", *"ABCD", *(F.lit(False).alias(k) for k in ("E", *marks)))
    made = util.materialize(with_id.unionByName(without), "audit-flags")
    util.drop_table(seen)
    return made


def walk(flags: DataFrame, filters: Sequence[str], marks: Sequence[str], to: str) -> None:
    """Write the counts of all edges below ``to``: part, state (bits of the filters applied), filter
    (its bit), left (survivors before it), removed and what it removes of each mark."""

    def visit(survivors: DataFrame, state: int, done: set[int]) -> None:
        ahead = [k for k in range(len(filters)) if not state >> k & 1]
        sums = [F.count_if(c).alias(f"{filters[k]}_{name}") for k in ahead for name, c in [("removed", F.col(filters[k])), *((m, F.col(filters[k]) & F.col(m)) for m in marks)]]
        found = survivors.groupBy("_part").agg(F.count("*").alias("left"), *sums)
        edges = [F.struct(F.lit(1 << k).alias("filter"), F.col(f"{filters[k]}_removed").alias("removed"), *(F.col(f"{filters[k]}_{m}").alias(m) for m in marks)) for k in ahead]
        found = found.select("_part", "left", F.explode(F.array(*edges)).alias("e"))
        found.select(F.col("_part").alias("part"), F.lit(state).alias("state"), "e.filter", "left", "e.removed", *(f"e.{m}" for m in marks)).coalesce(1).write.mode("append").parquet(to)
        for k in ahead:
            after = state | 1 << k
            if after not in done and after != (1 << len(filters)) - 1:
                done.add(after)
                below = survivors.where(~F.col(filters[k])).persist(StorageLevel.MEMORY_AND_DISK)
                visit(below, after, done)
                below.unpersist()

    visit(flags, 0, {0})


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step and the counts of that step, for every order of the filters A to E.

    kept: left after this step; removed: by it; redundant: fails its filter, but went earlier;
    unique_fails: fails its filter alone; good_lost and toxic_lost: removed here and labelled so;
    shapley: what its filter removes, summed over all orders. A part is a value of ``part_col``,
    the empty string for null; each row of ``docs`` counts in one part, repeated rows each. A row
    fails E if its text is that of a row with a smaller id anywhere in the table: rows that share
    the smallest id don't, nor do rows with a null id. Null texts are empty ones; empty and very
    long texts are counted like others, whole. Labels of ids that ``docs`` lacks count nowhere. An
    empty table gives no rows; other columns, whatever their names, are not read.
    """
    filters, marks = "ABCDE", ("good", "toxic")
    flags = flag_documents(docs, labels, id_col=id_col, text_col=text_col, part_col=part_col)
    spark = docs.sparkSession
    to = f"{shared_dir(spark)}/audit-edges-{uuid.uuid4().hex}"
    walk(flags, filters, marks, to)
    edges = spark.read.parquet(to)

    fails = lambda f: F.col(f)
    alone = lambda f: fails(f) & ~F.greatest(*(fails(g) for g in filters if g != f))
    parts = flags.groupBy(F.col("_part").alias("part")).agg(F.array(*(F.count_if(alone(f)) for f in filters)).alias("unique"), F.array(*(F.count_if(fails(f)) for f in filters)).alias("fails"))
    k = len(filters)
    orders = []
    for order in itertools.permutations(range(k)):
        state = 0
        for step, f in enumerate(order, 1):
            orders.append(F.struct(F.lit("".join(filters[i] for i in order)).alias("filter_order"), F.lit(step).alias("step"), F.lit(f).alias("f"), F.lit(state).alias("state")))
            state |= 1 << f
    # all orders with the steps of each: a fixed k! * k rows, made once and sent to every task
    steps = spark.range(1).select(F.inline(F.array(*orders)))
    weight = F.element_at(F.array(*(F.lit(math.factorial(n) * math.factorial(k - 1 - n)) for n in range(k))), F.bit_count("state").cast("int") + 1)
    shapley = edges.groupBy("part", "filter").agg(F.sum(F.col("removed") * weight).alias("shapley"))
    f1 = F.col("f") + 1
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    wide = parts.select("part", "unique", "fails", F.explode(F.array(*(F.lit(i) for i in range(k)))).alias("f"))
    wide = wide.withColumn("filter", F.element_at(F.array(*(F.lit(1 << i) for i in range(k))), f1)).join(shapley, ["part", "filter"], "left")
    # one row for each part, filter and state; an order's step reads the one of its filter and state
    states = wide.withColumn("state", F.explode(F.filter(F.array(*(F.lit(s) for s in range(1 << k))), lambda s: s.bitwiseAND(F.col("filter")) == 0)))
    found = states.join(edges, ["part", "filter", "state"], "left")
    made = found.join(F.broadcast(steps), ["f", "state"]).select(
        "part",
        "filter_order",
        "step",
        (none("left") - none("removed")).alias("kept"),
        none("removed").alias("removed"),
        (F.element_at("fails", f1) - none("removed")).cast("long").alias("redundant"),
        F.element_at("unique", f1).cast("long").alias("unique_fails"),
        none("good").alias("good_lost"),
        none("toxic").alias("toxic_lost"),
        none("shapley").alias("shapley"),
    )
    made = util.materialize(made, "audit")
    util.drop_table(flags)
    delete(spark, to)
    return made
