"""How many pairs share something, without making the pairs.

Items that share a key are linked. A key that n items have makes n(n-1)/2 pairs, and a pair that
shares several keys has to be counted once. Keys are told apart by the number of items they have:

* *Common* keys are counted by inclusion and exclusion. Items with the same set of common keys are one
  class; each class adds its size to every subset of its keys, and a subset with n items counts its
  n(n-1)/2 pairs with a sign by its size. No pair is made, however large the key.
* *Rare* keys, of at most ``common`` items each, are listed pair by pair: at most ``common`` rows an
  item and key. A pair counts at the first rare key it shares, and only if it shares no common one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pairs(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("long")


def _subsets(keys: Column) -> Column:
    """All subsets of an array that are not empty."""
    start = F.array(F.slice(keys, 1, 0))
    return F.filter(F.aggregate(keys, start, lambda found, k: F.concat(found, F.transform(found, lambda s: F.array_append(s, k)))), lambda s: F.size(s) > 0)


def key_pairs(members: DataFrame) -> DataFrame:
    """(grp, shared): over all pairs of a group's items the keys that they share. members: grp, item, key."""
    sizes = members.select("grp", "item", "key").distinct().groupBy("grp", "key").agg(F.count("*").alias("n"))
    return sizes.groupBy("grp").agg(F.sum(_pairs(F.col("n"))).alias("shared"))


def linked_pairs(members: DataFrame, common: int = 64) -> DataFrame:
    """(grp, pairs): the unordered pairs of a group's items that share a key, each counted once.

    members: grp, item, key; repeated rows have no effect; groups without a shared key have no row.
    The work of a class is two to the number of common keys that its items have, so ``common`` should
    be such that an item has few.
    """
    rows = members.select("grp", "item", "key").distinct()
    sizes = rows.groupBy("grp", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, ["grp", "key"])
    is_common = F.col("n") > common
    held = rows.groupBy("grp", "item").agg(F.sort_array(F.collect_list(F.when(is_common, F.col("key")))).alias("many"), F.sort_array(F.collect_list(F.when(~is_common, F.col("key")))).alias("few"))
    classes = held.where(F.size("many") > 0).groupBy("grp", "many").agg(F.count("*").alias("n"))
    subsets = classes.select("grp", "n", F.explode(_subsets(F.col("many"))).alias("s")).groupBy("grp", "s").agg(F.sum("n").alias("n"))
    sign = F.when(F.size("s") % 2 == 1, 1).otherwise(-1)
    by_many = subsets.groupBy("grp").agg(F.sum(sign * _pairs(F.col("n"))).alias("pairs"))
    listed = held.withColumn("key", F.explode("few"))
    other = listed.select("grp", "key", F.col("item").alias("item_b"), F.col("many").alias("many_b"), F.col("few").alias("few_b"))
    met = listed.join(other, ["grp", "key"]).where("item < item_b")
    new = (F.element_at(F.array_intersect("few", "few_b"), 1) == F.col("key")) & ~F.arrays_overlap("many", "many_b")
    by_few = met.where(new).groupBy("grp").agg(F.count("*").alias("pairs"))
    return by_many.unionByName(by_few).groupBy("grp").agg(F.sum("pairs").alias("pairs")).where("pairs > 0")
