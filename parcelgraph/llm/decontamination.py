"""Benchmark decontamination: which documents hold a test item.

A size-partitioned MinHash containment search. Documents are partitioned by the power of two above
the size of their set of word shingles. In each partition one hash function with one bin for every
``1 / load`` shingles of the partition's upper size gives a one-permutation MinHash sketch: the
least hash in each bin. Items are sketched with the bins of every partition. As the number of bins
grows with the size bound, a shingle of a short item keeps its bin in a long document with the same
probability as in a short one, so one law calibrates all partitions: how many of an item's least
values have to be looked up for a contaminated document to share one with the wanted recall.

Pairs that share a value are verified by exact containment of shingles, as strings.

Everything is column expressions. One pass over the documents looks the sketches up; a second reads
the texts of the documents that were found.
"""

from __future__ import annotations

from math import ceil, exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import util

#: Sketch values of all items and partitions up to which they are broadcast (16 bytes each and
#: overhead); larger benchmarks are joined by a shuffle.
BROADCAST_VALUES = 500_000
#: Ids of found documents up to which they are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 200_000
_HASH_BITS = 63


def _at(words: Column, i: Column, width: int) -> list[Column]:
    return [F.get(words, i + k) for k in range(width)]


def _windows(words: Column, width: int, one) -> Column:
    """``one(list of words)`` for each shingle; with fewer words, of all of them and nulls."""
    n = F.size(words)
    last = F.greatest(n - F.lit(width), F.lit(0))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: one(_at(words, i, width))))


def shingle_hashes(words: Column, width: int) -> Column:
    """Non-negative hashes of the shingles, in order; null without words."""
    return _windows(words, width, lambda ws: F.shiftrightunsigned(F.xxhash64(*ws), 1))


def shingle_texts(words: Column, width: int) -> Column:
    """The distinct shingles, words joined by blanks; null without words."""
    return F.array_distinct(_windows(words, width, lambda ws: F.concat_ws(" ", *ws)))


def survival(load: float) -> float:
    """The chance that a value is the least of its bin when others fall there ``load`` on average."""
    return (1 - exp(-load)) / load


def calibrate(least_size: int, containment: float, recall: float) -> tuple[int, int]:
    """(bins for each shingle, as a power of two's exponent; values of an item to look up)."""
    bits = 1
    while (1 - survival(2.0**-bits)) ** ceil(containment * least_size) > 1 - recall:
        bits += 1
    return bits, ceil(log(1 - recall) / log(1 - containment * survival(2.0**-bits)))


def _shift(value: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, by)


def contaminated(docs: DataFrame, items: DataFrame, containment: float = 0.75, width: int = 5, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row (id, item, n_item_shingles, n_shared) for each pair where the document holds at
    least ``containment`` (in hundredths) of the item's distinct shingles.

    Shingles are ``width`` words of the ASCII-lower-cased text, words being what stands between
    ASCII white space; a text of fewer words is one shingle as a whole. Null, empty and blank texts
    of documents or items match nothing. Rows that repeat an id are one document (the union of what
    they hold counts for each row apart); null ids are reported as null. Other columns are not
    read; empty tables give no rows; texts of any length are searched whole.
    """
    percent = round(100 * containment)
    wanted = items.select(F.col(item_col).alias("item"), shingle_texts(util.words(F.col(item_text_col)), width).alias("shingles"), F.sort_array(F.array_distinct(shingle_hashes(util.words(F.col(item_text_col)), width))).alias("values"))
    wanted = util.materialize(wanted, "items").where("shingles is not null")
    least, longest = wanted.agg(F.min(F.size("shingles")), F.count("*")).first()
    held = docs.select(F.col(id_col).alias("id"), util.words(F.col(text_col)).alias("words"))
    if not longest:
        return held.select(F.col("id").alias(id_col), F.lit(None).cast(items.schema[item_col].dataType).alias(item_col), F.lit(0).cast("long").alias("n_item_shingles"), F.lit(0).cast("long").alias("n_shared")).where("false")
    bits, looked_up = calibrate(least, containment, recall)
    # documents: the partition is the exponent of the power of two at or above the set's size
    hashed = held.select("id", F.sort_array(F.array_distinct(shingle_hashes(F.col("words"), width))).alias("values"))
    partition = F.ceil(F.log2(F.size("values").cast("double"))).cast("int")
    shift = F.lit(_HASH_BITS) - F.least(F.col("part") + F.lit(bits), F.lit(_HASH_BITS))
    bin_of = lambda x: _shift(x, shift)
    sketch = F.filter("values", lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col("values"), F.greatest(i - 1, F.lit(0))))))
    # explode_outer, and the partition inside what is exploded: the optimizer would else add filters
    # on the array or the join key and push them below, where the whole expression that makes the
    # array is evaluated again inside its own lambda
    probes = hashed.withColumn("part", partition).select("id", F.explode_outer(F.transform(sketch, lambda x: F.struct(F.col("part"), x.alias("value")))).alias("key")).select("id", "key.part", "key.value")
    # items: the same bins for each partition that a document can be in; of each sketch the values
    # that a second hash puts first, so that every item looks up as many as recall needs
    parts = F.explode(F.sequence(F.lit(0), F.lit(40))).alias("part")
    known = wanted.select("item", "values", parts).select("item", "part", sketch.alias("sketch"))
    picked = F.slice(F.transform(F.array_sort(F.transform("sketch", lambda x: F.struct(F.xxhash64(x).alias("by"), x.alias("x")))), lambda s: s["x"]), 1, looked_up)
    known = known.select("item", "part", F.explode_outer(picked).alias("value"))
    if longest * looked_up * 41 <= BROADCAST_VALUES:
        known = F.broadcast(known)
    pairs = util.materialize(probes.join(known, ["part", "value"]).select("id", "item").distinct(), "found")
    # exact containment: texts are read again, of the documents that were found alone, and split
    # after the join; items' shingles come last
    shared = F.size(F.array_intersect("texts", "shingles")).cast("long")
    ids = pairs.select(F.col("id").alias("doc")).distinct()
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(ids) if few else ids, F.col("id").eqNullSafe(F.col("doc")), "left_semi")
    # words are made below the join: inside the shingles' own expression they'd be split for each
    sets = texts.select(F.col("id").alias("doc"), util.words(F.col("text")).alias("words"))
    joined = sets.join(pairs, F.col("doc").eqNullSafe(F.col("id"))).join(wanted.select("item", "shingles"), "item")
    checked = joined.select("doc", "item", "shingles", shingle_texts(F.col("words"), width).alias("texts")).select("doc", "item", F.size("shingles").cast("long").alias("n"), shared.alias("shared"))
    # the condition stands on aggregates, so it isn't evaluated inside the join as well
    counted = checked.groupBy("doc", "item").agg(F.max("n").alias("n_item_shingles"), F.max("shared").alias("n_shared"))
    kept = counted.where(F.lit(100) * F.col("n_shared") >= F.lit(percent) * F.col("n_item_shingles"))
    return kept.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "n_item_shingles", "n_shared")
