"""Near-duplicate vectors by collision counting over one-dimensional projections.

Vectors are normalised and projected onto many random directions. Two vectors collide in a
projection if one lies in the window centred on the other; near vectors collide in most
projections, others in few. A pair whose collisions reach a calibrated count is verified by its
cosine in double precision. The count is chosen from the binomial law so that a pair exactly at the
threshold is missed with a probability below ``1 - recall``; nearer pairs are missed far less.

Where to look: along a few orthonormal directions, vectors within the distance that the cosine
allows lie in the same or in neighbouring cells of that width, without exception. Cells are cut
into blocks of bounded size by a hash, and each pair of blocks that can hold a near pair is one
group: it sorts its projections, counts windows, verifies, and returns degrees and a spanning
forest only, never all pairs of a group of copies.
"""

from __future__ import annotations

from itertools import product
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parcelgraph.operators.components import connected_components

from . import util


def collision_threshold(projections: int, half_width: float, distance: float, recall: float) -> int:
    """The largest count that a pair at ``distance`` reaches with probability ``recall``.

    Differences of Gaussian projections are normal with that distance as deviation.
    """
    p = erf(half_width / distance / sqrt(2))
    tail, k = 0.0, projections
    while k > 0:
        tail += comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if tail >= recall:
            return k
        k -= 1
    return 0


def count_collisions(queries: np.ndarray, targets: np.ndarray, half_width: float) -> np.ndarray:
    """Collisions of each query with each target; columns are projections.

    Each projection is sorted once; a query's window is a run of the sorted targets.
    """
    n, m = len(queries), len(targets)
    total = np.zeros((n, m), np.int16)
    for k in range(queries.shape[1]):
        order = np.argsort(targets[:, k], kind="stable")
        line = targets[order, k]
        edges = np.zeros((n, m + 1), np.int8)
        rows = np.arange(n)
        first, behind = np.searchsorted(line, queries[:, k] - half_width, "left"), np.searchsorted(line, queries[:, k] + half_width, "right")
        edges[rows, first] += 1
        edges[rows, behind] -= 1
        total[:, order] += np.cumsum(edges[:, :m], axis=1, dtype=np.int8)
    return total


def near_pairs(a: np.ndarray, b: np.ndarray, directions: np.ndarray, half_width: float, least: int, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine at least ``cosine``; of one block with itself each pair once."""
    hits = count_collisions(a @ directions, b @ directions, half_width) >= least
    if same:
        hits = np.triu(hits, 1)
    i, j = np.nonzero(hits)
    keep = np.einsum("ij,ij->i", a[i], b[j]) >= cosine if len(i) else np.zeros(0, bool)
    return i[keep], j[keep]


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Positions of pairs that form a spanning forest."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(k)
    return np.array(kept, np.int64)


def link_vectors(vectors: DataFrame, cosine: float = 0.98, projections: int = 32, half_width_in_distances: float = 2.0, recall: float = 0.9999, block_rows: int = 768, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label") -> DataFrame:
    """id, n_links, component_id and kept for every row of ``vectors``.

    Rows link if their groups are equal and not null and their cosine is at least ``cosine``.
    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing;
    so do vectors of different dimensions. Ids that repeat are one node whose rows' links add up
    (links between rows of one id are counted for both); rows with a null id link with nothing.
    Other columns are not read; an empty table gives no rows. kept marks the component's smallest
    id.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(group_col).alias("g"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = rows.where(F.col("id").isNotNull() & F.col("g").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))
    distance = sqrt(2 - 2 * cosine) + 1e-9
    half_width = half_width_in_distances * distance
    least = collision_threshold(projections, half_width, distance, recall)
    id_type, cells = vectors.schema[id_col].dataType, 2

    def directions(d: int) -> tuple[np.ndarray, np.ndarray]:
        draw = np.random.default_rng([seed, d])
        ortho, _ = np.linalg.qr(draw.standard_normal((d, min(d, cells))))
        return ortho, draw.standard_normal((d, projections))

    schema = T.StructType([T.StructField("id", id_type), util.field(vectors, group_col, "g"), T.StructField("d", T.IntegerType()), *(T.StructField(f"c{k}", T.IntegerType()) for k in range(cells)), T.StructField("u", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def place(batches):
        for batch in batches:
            out = []
            for v in batch.column(2):
                v = np.array(v.as_py())
                v = v / np.abs(v).max()
                v /= np.linalg.norm(v)
                at = np.floor((v @ directions(len(v))[0] if len(v) > 0 else v) / distance).astype(int).tolist()
                out.append((len(v), *(at + [0] * cells)[:cells], v.tobytes()))
            cols = list(zip(*out, strict=True)) or [()] * (2 + cells)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), batch.column(1).cast(arrow.field(1).type), *(pa.array(c, arrow.field(k + 2).type) for k, c in enumerate(cols))], schema=arrow)

    placed = util.materialize(valid.mapInArrow(place, schema), "vectors")
    cell = ["g", "d", *(f"c{k}" for k in range(cells))]
    parts = placed.groupBy(*cell).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
    # the cells that a cell is compared with: itself and half of its neighbours, the other half
    # compare themselves with it
    ahead = [o for o in product((-1, 0, 1), repeat=cells) if o >= (0,) * cells]
    plan = None
    for number, o in enumerate(ahead):
        other = parts.select("g", "d", *((F.col(f"c{k}") - F.lit(o[k])).alias(f"c{k}") for k in range(cells)), F.col("parts").alias("other"))
        here = parts.join(other, cell).select(*cell, "other", F.lit(number).alias("o"))
        plan = here if plan is None else plan.unionByName(here)
    # a row's own part, then the groups (cell, neighbour, part, part of the neighbour) it belongs to
    own = placed.join(parts, cell).withColumn("part", F.pmod(F.xxhash64("id", "u"), F.col("parts")).cast("int"))
    left = own.join(plan, cell).withColumn("task", F.explode(F.when(F.col("o") == 0, F.expr("sequence(part, other - 1)")).otherwise(F.expr("sequence(0, other - 1)")))).select(*cell, "o", F.col("part").alias("pa"), F.col("task").alias("pb"), F.lit(0).alias("side"), "id", "u")
    right = None
    for number, o in enumerate(ahead):
        back = own.drop("parts").select("g", "d", *((F.col(f"c{k}") - F.lit(o[k])).alias(f"c{k}") for k in range(cells)), "id", "u", F.col("part").alias("pb"))
        tasks = F.sequence(F.lit(0), (F.col("pb") if number == 0 else F.col("parts")) - 1)
        more = back.join(parts, cell).where(F.col("pb") > 0 if number == 0 else F.lit(True)).withColumn("pa", F.explode(tasks)).select(*cell, F.lit(number).alias("o"), "pa", "pb", F.lit(1).alias("side"), "id", "u")
        right = more if right is None else right.unionByName(more)

    found_schema = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type), T.StructField("n", T.LongType())])
    found_arrow = to_arrow_schema(found_schema)

    def compare(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        ids = table["id"].combine_chunks()
        d = table["d"][0].as_py()
        same = table["o"][0].as_py() == 0 and table["pa"][0].as_py() == table["pb"][0].as_py()
        unit = np.frombuffer(b"".join(table["u"].to_pylist()), float).reshape(-1, d)
        at = np.nonzero(side == 0)[0], np.nonzero(side == (0 if same else 1))[0]
        if not len(at[0]) or not len(at[1]):
            return found_arrow.empty_table()
        i, j = near_pairs(unit[at[0]], unit[at[1]], directions(d)[1], half_width, least, cosine, same)
        x, y = at[0][i], at[1][j]
        degree = np.bincount(np.concatenate([x, y]), minlength=len(side))
        linked = np.nonzero(degree)[0]
        tree = _forest(x, y, len(side))
        a = pa.concat_arrays([ids.take(pa.array(linked)), ids.take(pa.array(x[tree]))])
        b = pa.concat_arrays([pa.nulls(len(linked), ids.type), ids.take(pa.array(y[tree]))])
        n = np.concatenate([degree[linked], np.zeros(len(tree), np.int64)]).astype(np.int64)
        return pa.Table.from_arrays([a.cast(found_arrow.field(0).type), b.cast(found_arrow.field(1).type), pa.array(n)], schema=found_arrow)

    groups = left.unionByName(right).withColumn("key", F.xxhash64(*cell, "o", "pa", "pb"))
    found = util.materialize(groups.groupBy("key", *cell, "o", "pa", "pb").applyInArrow(compare, found_schema), "links")
    degrees = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n_links"))
    components = connected_components(found.where("b is not null").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    out = vectors.select(F.col(id_col).alias("id")).join(degrees.withColumnRenamed("a", "id"), "id", "left").join(components.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
