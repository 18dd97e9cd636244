"""Joins, deduplication and versioned writes as DataFrame operators."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from parcelgraph.functions.text import trigram_similarity
from parcelgraph.sources.shared import shared_dir, write

#: Nodes of a class that are paired with as many others in one row.
CHUNK = 1024


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def known_only(events: DataFrame, buildings: DataFrame, key: str = "bbl") -> DataFrame:
    """Events of buildings that exist."""
    return events.join(buildings.select(key), key, "left_semi")


def missing_keys(events: DataFrame, buildings: DataFrame, key: str = "bbl") -> DataFrame:
    """Distinct keys of events without a building."""
    return events.select(key).join(buildings.select(key), key, "left_anti").distinct()


def counted_known(events: DataFrame, buildings: DataFrame, counts: Observation, skip: Column, key: str = "bbl") -> DataFrame:
    """Events of buildings that exist and for which ``skip`` is not true; what is written of them is
    observed on the way: processed, missing (no building), skipped and written.

    buildings has each key once. The observation is there when the write is done.
    """
    marked = events.join(buildings.select(key, F.lit(True).alias("_known")), key, "left")
    known, skipped = F.col("_known").isNotNull(), F.coalesce(skip, F.lit(False))
    seen = marked.observe(counts, F.count(F.lit(1)).alias("processed"), F.count_if(~known).alias("missing"), F.count_if(known & skipped).alias("skipped"), F.count_if(known & ~skipped).alias("written"))
    return seen.where(known & ~skipped).drop("_known")


def resolve_references(references: DataFrame, documents: DataFrame) -> DataFrame:
    """(document, target): by document id, else the smallest document with the file number.

    references: document, by_id, by_number; documents: document, number. Blank references, unknown
    documents and references to oneself are dropped.
    """
    by_number = documents.where("number is not null").groupBy("number").agg(F.min("document").alias("numbered"))
    known = documents.select(F.col("document").alias("target")).distinct()
    out = references.join(by_number, references["by_number"] == by_number["number"], "left")
    out = out.select("document", F.coalesce(F.nullif(F.trim("by_id"), F.lit("")), "numbered").alias("target"))
    return out.where("target is not null and target != document").distinct().join(known, "target", "left_semi")


def party_strings(parties: DataFrame, key: str, name: str) -> DataFrame:
    """Names of each key in order, joined by bars."""
    return parties.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(name)), " | ").alias("names"))


def busy_addresses(contacts: DataFrame, least: int = 50) -> DataFrame:
    """(house, street, zip) with at least ``least`` contacts over all apartments."""
    return contacts.groupBy("house", "street", "zip").agg(F.sum("contacts").alias("contacts")).where(F.col("contacts") >= least)


def node_classes(nodes: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., ids): nodes that agree in all of ``by``, in rows of up to :data:`CHUNK` of them."""
    ids = nodes.groupBy(*by).agg(F.collect_list("nodeid").alias("ids"))
    cuts = F.sequence(F.lit(1), F.size("ids"), F.lit(CHUNK))
    return ids.select(*by, F.explode(F.transform(cuts, lambda at: F.slice("ids", at, F.lit(CHUNK)))).alias("ids"))


def _pairs_of_classes(found: DataFrame) -> DataFrame:
    """(src, dst, weight), src < dst, of linked classes (ids, ids2, weight) in both directions.

    The rows that stand for many pairs are few, so they are dealt to a number of tasks that Spark
    doesn't reduce by their size.
    """
    tasks = 4 * found.sparkSession.sparkContext.defaultParallelism
    dealt = found.repartition(tasks, "ids", "ids2")
    return dealt.select("weight", "ids2", F.explode("ids").alias("src")).select("src", F.explode("ids2").alias("dst"), "weight").where("src < dst")


def name_edges(nodes: DataFrame, busy: DataFrame, high: float = 0.9, with_apartment: float = 0.8) -> DataFrame:
    """(src, dst, weight), src < dst, of nodes with one name and zip and similar streets.

    nodes: nodeid, name_norm, house, street_name, street, apt, zip. Busy addresses are removed
    before the join, so no address of an agent makes a hub; the rest is an equi-join on (name, zip)
    of classes of equal nodes, with the similarity as residual: it is computed once for two classes,
    whose members then make the pairs.
    """
    keep = nodes.where("name_norm != ''").join(busy.select("house", F.col("street").alias("street_name"), "zip"), ["house", "street_name", "zip"], "left_anti")
    keep = node_classes(keep, ["name_norm", "street", "apt", "zip"])
    other = keep.select(F.col("ids").alias("ids2"), "name_norm", "zip", F.col("street").alias("street2"), F.col("apt").alias("apt2"))
    near = keep.join(other, ["name_norm", "zip"]).withColumn("similarity", trigram_similarity(F.col("street"), F.col("street2")))
    apartment = F.coalesce(F.col("apt") == F.col("apt2"), F.lit(False))
    near = near.where((F.col("similarity") > high) | ((F.col("similarity") > with_apartment) & apartment))
    return _pairs_of_classes(near.select("ids", "ids2", (1 + F.col("similarity") + F.when(apartment, 0.5).otherwise(0.0)).alias("weight")))


def address_edges(nodes: DataFrame, busy: DataFrame) -> DataFrame:
    """(src, dst, weight), src < dst, of nodes at one street and zip whose apartments agree."""
    keep = nodes.join(busy.select("house", F.col("street").alias("street_name"), "zip"), ["house", "street_name", "zip"], "left_anti")
    keep = node_classes(keep, ["name", "street", "apt", "zip"])
    other = keep.select(F.col("ids").alias("ids2"), F.col("name").alias("name2"), "street", F.col("apt").alias("apt2"), "zip")
    near = keep.join(other, ["street", "zip"]).where("apt = apt2 or apt = '' or apt2 = ''")
    return _pairs_of_classes(near.select("ids", "ids2", (2 + F.coalesce(trigram_similarity(F.col("name"), F.col("name2")), F.lit(0.0))).alias("weight")))


def strongest_edges(edges: DataFrame) -> DataFrame:
    """One undirected edge a pair, with the greatest weight."""
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight"))


def best_jaccard(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """For each left set the right set of greatest Jaccard similarity, ``least`` at least.

    left, right: id, bbl (one row an element). Only sets that share an element meet: each left set is
    sent the lists of the right sets that have its elements, and counts them where it is; of the counts
    only those leave that could be enough for the left set's size.
    """
    spark = left.sparkSession
    sides = left.select("id", "bbl", F.lit(True).alias("is_left")).unionByName(right.select("id", "bbl", F.lit(False).alias("is_left")))
    held = lambda side: F.collect_set(F.when(side, F.col("id")))
    lists = sides.groupBy("bbl").agg(held(F.col("is_left")).alias("ids"), held(~F.col("is_left")).alias("others"))
    lists = write(lists, f"{shared_dir(spark)}/elements-{uuid.uuid4().hex}")
    sizes_a = lists.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("na"))
    sizes_b = lists.select(F.explode("others").alias("other")).groupBy("other").agg(F.count("*").alias("nb"))
    sent = lists.where("bbl is not null and size(others) > 0").select(F.explode("ids").alias("id"), "others").repartition("id")
    shared = sent.select("id", F.explode("others").alias("other")).groupBy("id", "other").agg(F.count("*").alias("shared"))
    shared = shared.join(sizes_a, "id").where(F.col("shared") / F.col("na") >= least)
    scored = shared.join(sizes_b, "other").withColumn("score", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")))
    return scored.where(F.col("score") >= least).groupBy("id").agg(F.min_by(F.struct("other", "shared"), F.struct(-F.col("score"), "other")).alias("m")).select("id", F.col("m.other").alias("other"), F.col("m.shared").alias("shared"))


def set_once_upsert(old: DataFrame, new: DataFrame, key: str, once: Sequence[str], always: Sequence[str]) -> DataFrame:
    """Keyed upsert: ``once`` columns keep their first value, ``always`` columns take the new one."""
    fresh = new.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in [*once, *always]))
    joined = old.join(fresh, key, "full_outer")
    return joined.select(key, *(F.coalesce(c, f"_{c}").alias(c) for c in once), *(F.coalesce(f"_{c}", c).alias(c) for c in always))


def version_diff(active: DataFrame, evaluated: DataFrame, key: str, value: str) -> DataFrame:
    """(key, action): insert, close, supersede or keep, from active claims and a new evaluation."""
    old = active.select(key, F.col(value).alias("_old"), F.lit(True).alias("_was"))
    new = evaluated.select(key, F.col(value).alias("_new"), F.lit(True).alias("_is"))
    action = F.when(F.col("_was").isNull(), "insert").when(F.col("_is").isNull(), "close").when(F.col("_old").eqNullSafe(F.col("_new")), "keep").otherwise("supersede")
    return old.join(new, key, "full_outer").select(key, action.alias("action"))
