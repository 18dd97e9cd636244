"""Landlords linked by name and similar address, without comparing all that share a name.

Landlords that agree in every compared column are one *class*; only classes are compared. A class's
address enters an inverted index by its rarest trigrams: two sets of grams as similar as wanted share
one of the first ``n - least * n + 1`` of them in any fixed order, so pairs meet only in the posting
lists of such grams (prefix filter), and only if their sizes allow the similarity (length filter).
What is left is verified on the whole sets. Members come back as counts: how many others a landlord
is linked with, and with what mean weight, follows from the sizes of the linked classes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgraph.functions.text import trigrams


def gram_candidates(rows: DataFrame, block: Sequence[str], least: float) -> DataFrame:
    """(a, b), a < b: ids of one block whose gram sets may be ``least`` similar (Jaccard), each pair once.

    rows: id, the block's columns, grams (a set). Pairs whose similarity is at least ``least`` are all
    among them. Sets without grams are similar to nothing.
    """
    grams = rows.where(F.size("grams") > 0)
    common = grams.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    listed = grams.select("id", *block, F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(common, "gram")
    ordered = listed.groupBy("id", *block, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "gram"))), lambda s: s["gram"]).alias("ordered"))
    length = F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1
    index = ordered.select("id", *block, "n", F.slice("ordered", F.lit(1), length).alias("prefix")).withColumn("gram", F.explode("prefix"))
    other = index.select(F.col("id").alias("b"), *block, F.col("n").alias("n_b"), F.col("prefix").alias("prefix_b"), "gram")
    met = index.withColumnsRenamed({"id": "a", "n": "n_a"}).join(other, [*block, "gram"]).where("a < b")
    fits = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * least - 1e-9
    # a pair is taken from the first of the lists in which it meets
    first = F.element_at(F.array_intersect("prefix", "prefix_b"), 1) == F.col("gram")
    return met.where(fits & first).select("a", "b")


def similar(rows: DataFrame, block: Sequence[str], least: float) -> DataFrame:
    """(a, b, similarity) of the pairs of :func:`gram_candidates` that are at least ``least`` similar."""
    sets = rows.select("id", "grams")
    pairs = gram_candidates(rows, block, least)
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b")
    scored = both.select("a", "b", (F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("similarity"))
    return scored.where(F.col("similarity") >= least)


def without_busy(nodes: DataFrame, busy: DataFrame) -> DataFrame:
    """Nodes (house, street_name, zip) that are not at one of the ``busy`` addresses (house, street, zip)."""
    return nodes.join(busy.select("house", F.col("street").alias("street_name"), "zip"), ["house", "street_name", "zip"], "left_anti")


def name_classes(nodes: DataFrame, busy: DataFrame) -> DataFrame:
    """(id, name_norm, zip, street, apt, members): what is compared by name; id is the smallest node."""
    keep = without_busy(nodes.where("name_norm != ''"), busy)
    return keep.groupBy("name_norm", "zip", "street", "apt").agg(F.min("nodeid").alias("id"), F.count("*").alias("members"))


def name_class_links(classes: DataFrame, high: float = 0.9, with_apartment: float = 0.8) -> DataFrame:
    """(a, b, weight) of classes with one name and zip whose streets are more similar than ``high``, or
    than ``with_apartment`` with the same apartment. A class of several members is linked with itself
    (a = b): its members are."""
    rows = classes.where("street is not null and zip is not null").withColumn("grams", trigrams(F.col("street")))
    pairs = similar(rows.select("id", "name_norm", "zip", "grams"), ["name_norm", "zip"], min(high, with_apartment))
    facts = classes.select("id", "apt")
    pairs = pairs.join(facts.withColumnsRenamed({"id": "a", "apt": "apt_a"}), "a").join(facts.withColumnsRenamed({"id": "b", "apt": "apt_b"}), "b")
    own = rows.where((F.col("members") > 1) & (F.size("grams") > 0)).select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"), F.col("apt").alias("apt_a"), F.col("apt").alias("apt_b"))
    together = F.coalesce(F.col("apt_a") == F.col("apt_b"), F.lit(False))
    linked = pairs.unionByName(own).where((F.col("similarity") > high) | ((F.col("similarity") > with_apartment) & together))
    return linked.select("a", "b", (1 + F.col("similarity") + F.when(together, 0.5).otherwise(0.0)).alias("weight"))


def class_averages(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, n, mean): how many nodes a member of each class is linked with, and the mean weight."""
    sizes = classes.select("id", "members")
    ends = links.select("a", "b", "weight").unionByName(links.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    others = ends.join(sizes.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), (F.col("members") - F.when(F.col("a") == F.col("b"), 1).otherwise(0)).alias("k"), "weight")
    return others.groupBy("id").agg(F.sum("k").alias("n"), (F.sum(F.col("k") * F.col("weight")) / F.sum("k")).alias("mean"))


def members_of(nodes: DataFrame, busy: DataFrame) -> DataFrame:
    """(nodeid, id): the class of each node that has one."""
    keep = without_busy(nodes.where("name_norm != ''"), busy)
    by = ["name_norm", "zip", "street", "apt"]
    ids = keep.groupBy(*by).agg(F.min("nodeid").alias("id"))
    same = [keep[c].eqNullSafe(ids[c]) for c in by]
    condition = same[0] & same[1] & same[2] & same[3]
    return keep.join(ids, condition).select("nodeid", "id")
