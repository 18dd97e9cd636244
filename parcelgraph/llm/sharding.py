"""Sharding by histogram sort.

Documents are ordered by a key (a hash of the text, then one of the id), so copies of a text lie
next to each other. Which keys cut that order into shards of equal bytes is found by histograms:
each round counts, in one aggregation, the exact bytes below many candidate boundaries at once,
and only the intervals that hold a splitter which isn't within tolerance yet are probed again, 4096
times finer. Only when all splitters stand are the documents exchanged, once.

A boundary cuts a group of equal texts only where that group alone is larger than the tolerance;
then the hash of the id orders the rows of the group, and among rows that are equal in both, which
are interchangeable, the hash of a row number, so that the wanted share of them lies below.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import util

#: Candidate boundaries per interval and round, as bits of the key.
PROBE_BITS = 12
_KEY_BITS = 63


@dataclass(frozen=True)
class Interval:
    """Keys whose ``level``-th 63-bit word starts with ``prefix``; ``first`` is the word before."""

    level: int  # 0: the text's hash; 1: the id's hash, among equal first words
    first: int
    prefix: int
    bits: int


def _keys(id_col: str, text_col: str) -> list[Column]:
    """Hashes of the text and of the id, in 0 to 2**63 - 1."""
    return [F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), 1), F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit("shard")), 1)]


def _search(sizes: DataFrame, total: int, targets: list[int], slack: float) -> list[tuple[int, int, int]]:
    """For each target the smallest boundary (keys) with about that many bytes below it."""
    found: dict[int, tuple[int, int, int]] = {}
    open_at = {k: (Interval(0, 0, 0, 0), 0) for k in range(len(targets))}  # splitter: interval, bytes below it
    while open_at:
        spaces = sorted({i for i, _ in open_at.values()}, key=lambda i: (i.level, i.first, i.prefix, i.bits))
        probes = None
        for level, bits in sorted({(i.level, i.bits) for i in spaces}):
            at = [i for i in spaces if (i.level, i.bits) == (level, bits)]
            word, more = F.col(f"k{level}"), min(PROBE_BITS, _KEY_BITS - bits)
            rows = sizes
            if level:
                rows = rows.where(F.col("k0").isin([i.first for i in at]))
            if bits:
                rows = rows.where(F.shiftrightunsigned(word, _KEY_BITS - bits).isin([i.prefix for i in at]))
            digit = F.shiftrightunsigned(word, _KEY_BITS - bits - more)
            part = rows.groupBy((F.col("k0") if level else F.lit(0).cast("long")).alias("first"), digit.alias("digit")).agg(F.sum("size").alias("size"), F.min(word).alias("lo"), F.max(word).alias("hi")).select(F.lit(level).alias("level"), F.lit(bits).alias("bits"), "*")
            probes = part if probes is None else probes.unionByName(part)
        counted: dict[Interval, list] = {i: [] for i in spaces}
        for r in probes.collect():  # at most 4096 rows for each splitter
            more = min(PROBE_BITS, _KEY_BITS - r.bits)
            counted.get(Interval(r.level, r.first, r.digit >> more, r.bits), []).append(r)
        for rows in counted.values():
            rows.sort(key=lambda r: (r.first, r.digit))
        for k, (interval, below) in list(open_at.items()):
            more = min(PROBE_BITS, _KEY_BITS - interval.bits)
            shift = _KEY_BITS - interval.bits - more
            for r in counted[interval]:
                if below + r.size >= targets[k]:
                    break
                below += r.size
            left, right = targets[k] - below, below + r.size - targets[k]
            at = (interval.first, r.digit << shift) if interval.level else (r.digit << shift, 0)
            if min(left, right) <= slack:
                # the boundary stands before this bucket, or behind it
                step = 0 if left <= right else 1 << shift
                found[k] = (at[0], at[1] + step, 0) if interval.level else (at[0] + step, 0, 0)
                del open_at[k]
            elif interval.level and r.lo == r.hi:
                # rows that are equal in both words: so large a share of them lies below
                found[k] = (interval.first, r.lo, left * (1 << _KEY_BITS) // r.size)
                del open_at[k]
            elif interval.level == 0 and r.lo == r.hi:
                open_at[k] = (Interval(1, r.lo, 0, 0), below)
            else:
                open_at[k] = (Interval(interval.level, interval.first, r.digit, interval.bits + more), below)
    return [found[k] for k in range(len(targets))]


def _choose(splitters: list[tuple[int, int, int]], keys: list[Column], low: int = 0) -> Column:
    """The number of splitters at or below the key, by binary search as nested conditions."""
    if not splitters:
        return F.lit(low)
    mid = len(splitters) // 2
    a, b, c = splitters[mid]
    last = (keys[1] > b) | ((keys[1] == b) & (keys[2] >= c)) if c else keys[1] >= b
    above = (keys[0] > a) | ((keys[0] == a) & last)
    return F.when(above, _choose(splitters[mid + 1 :], keys, low + mid + 1)).otherwise(_choose(splitters[:mid], keys, low))


def shard_by_bytes(docs: DataFrame, shards: int = 40, tolerance: float = 0.005, overhead: int = 16, slot_rows: int = 50_000, slot_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its columns and size, shard (0 to shards - 1) and slot.

    A row's size is the UTF-8 bytes of its text (null: none) plus ``overhead``. The sizes of the
    shards differ from their mean by ``tolerance`` of it at most at either end, or by one row where
    rows are larger than that. Slots of a shard have no gaps and begin at 0. Null texts count as
    empty ones; null ids have a key like any other. Rows that repeat id and text are
    interchangeable: where they have to be cut, each side gets its share by the hash of a row number
    (within chance, a share of one over the root of their count). An empty table gives no rows.
    Columns named size, shard or slot are replaced, others may have any name. Slots are numbered in
    parts of about ``slot_rows`` rows or ``slot_bytes`` bytes.
    """
    keys = _keys(id_col, text_col)
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + F.lit(overhead)
    sizes = util.materialize(docs.select(keys[0].alias("k0"), keys[1].alias("k1"), size.alias("size")), "sizes")
    rows, total = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    targets = [total * i // shards for i in range(1, shards)]
    splitters = _search(sizes, total, targets, tolerance * total / shards) if rows else []
    util.drop_table(sizes)
    # parts of a shard are numbered apart, so that no shard has to be ordered in one task
    parts = max(1, -(-rows // (shards * slot_rows)), -(-total // (shards * slot_bytes)))
    kept = [c for c in docs.columns if c.lower() not in ("size", "shard", "slot")]
    k0, k1, k2 = F.col("k0"), F.col("k1"), F.col("k2")
    number = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 1)
    keyed = docs.select(F.struct(*kept).alias("row"), size.alias("size"), keys[0].alias("k0"), keys[1].alias("k1"), number.alias("k2"))
    # row numbers hold within one reading of the rows: where they decide, what they decided is written
    cut = any(c for _, _, c in splitters)
    at = keyed.select("row", "size", "k0", "k1", _choose(splitters, [k0, k1, k2]).cast("int").alias("shard"), F.pmod(F.xxhash64(k0, k1, *([k2] if cut else [])), F.lit(parts)).alias("part"))
    at = util.materialize(at, "numbered") if cut else at
    counts = at.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(W.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    numbered = at.withColumn("number", F.row_number().over(W.partitionBy("shard", "part").orderBy("k0", "k1")))
    return numbered.join(before, ["shard", "part"]).select("row.*", "size", "shard", (F.col("before") + F.col("number") - 1).alias("slot"))
