"""Connected components by alternating large-star and small-star steps.

Each step is one aggregation and one equi-join over the remaining edges, the number of rounds grows
with the logarithm of the longest path, and every round is written to the folder that the cluster
shares, so a lost executor costs one round at most.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgraph.sources.shared import delete, shared_dir, write


#: Edges that a task contracts at once.
HELD_EDGES = 1 << 20
#: Contracted edges up to which one task finishes the components.
LAST_EDGES = 1 << 22


def _mins(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _mins(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _mins(down)
    moved = down.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of ``n`` nodes reaches by the edges (i, j)."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        live = a != b
        if not live.any():
            return root
        i, j, a, b = i[live], j[live], a[live], b[live]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _contract(edges: DataFrame, most: int | None = None) -> DataFrame:
    """Edges (u, v) of integers, those that a task holds (of each ``most``, if it has more) replaced by an
    edge of each node to the smallest one that it reaches by them."""
    most = HELD_EDGES if most is None else most

    def run(batches):
        def stars(held):
            table = pa.Table.from_batches(held)
            u, v = (table[c].to_numpy() for c in ("u", "v"))
            ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            root = _roots(at[: len(u)], at[len(u) :], len(ids))
            below = root != np.arange(len(ids))
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids[below], ids[root[below]]), table.schema, strict=True)], schema=table.schema)

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield stars(held)
                held, n = [], 0
        if n:
            yield stars(held)

    return edges.mapInArrow(run, edges.schema)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 40, contract: bool = False) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Edges are undirected; repeated ones, loops and edges with a null end are of no effect, but a
    loop's node is a component of its own. Nodes need an order (integers, strings, ...). With
    ``contract``, for which they have to be integers, each task contracts the edges that it reads before
    the first round, which saves rounds, and one task does the rest once ``LAST_EDGES`` are left.
    """
    spark = edges.sparkSession
    base = f"{shared_dir(spark)}/components-{uuid.uuid4().hex}"
    start = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("u"), F.col(dst).alias("v"))
    nodes = start.where("u = v").select("u", F.col("v"))
    state_of = lambda rows: rows.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    down = start.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    at = write((_contract(down) if contract else down).distinct(), f"{base}/0")
    # contracted edges may be stars from the start
    before = state_of(at) if contract else None
    for k in range(1, max_rounds + 1):
        if contract and before[0] <= LAST_EDGES:
            at = write(_contract(at.coalesce(1), LAST_EDGES + 1), f"{base}/{k}")
            delete(spark, f"{base}/{k - 1}")
            break
        at = write(_small_star(_large_star(at)), f"{base}/{k}")
        state = state_of(at)
        if k > 1:
            delete(spark, f"{base}/{k - 1}")
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = at.select(F.col("v").alias("u"), "v").distinct()
    found = at.unionByName(roots).unionByName(nodes)
    return found.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
