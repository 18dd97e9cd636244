"""Near-duplicate documents by a chosen-path set similarity join.

Each document's set of word shingles gets a minwise signature. A tree starts with all documents; at
a node, a few signature places are chosen (by a hash of the node's path) and a document goes to one
child for each chosen place, named by the place and the document's value there. On average
``1 / similarity`` places are chosen, so a pair at the threshold stays together along one path at
every level in expectation, and dissimilar documents part quickly. Nodes of a few documents are
compared exhaustively; larger ones branch further, up to a depth at which what is left together are
groups of copies, which are compared in blocks. A node whose members are copies of one another
does not part by branching, so it is compared at once. Independent trees are repeated until the chance of
missing a pair, that of the signatures' estimates included, is below ``1 - recall``.

Equal sets are one node from the start. Comparing a node's signatures yields candidates, of which
only a spanning forest leaves the task; the forests' components are clusters, and every candidate
pair lies within one. A cluster's full sets then meet in blocks, where all pairs are counted
exactly, and of the links again a spanning forest leaves. So no step makes a row for each pair of a
group, and no link between components is left out, but for what trees and estimates miss (see
calibrate).
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parcelgraph.operators.components import connected_components

from . import shingles, util

#: Signature places.
PLACES = 128
#: Members of a group of several blocks that all others are compared with first.
HUBS = 4
#: Members of a node agree in this share of the similarity, at least, where it is compared without
#: branching: three more levels would leave (2 / 3) ** 3 of its pairs, at least.
DENSE = 2 / 3
#: Ids up to which the documents of clusters are looked up by a broadcast; beyond it by a shuffle.
BROADCAST_IDS = 200_000
#: Pairs that a task gathers before it thins them out.
HELD_PAIRS = 1 << 20
#: Bytes of sets that one task's group holds, about.
GROUP_BYTES = 8 << 20


def signatures(docs: DataFrame, width: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """id, n (size of the set), fp (16 bytes that name the set) and sig (minwise values, see _planes)."""
    schema = T.StructType([util.field(docs, id_col, "id"), T.StructField("n", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("sig", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        draws = shingles.multipliers(PLACES, seed)
        for batch in batches:
            n, fp, sig = [], [], []
            for text in batch.column(1):
                found = shingles.shingle_set(text.as_py() or "", width)
                n.append(len(found))
                fp.append(xxhash.xxh3_128_digest(found.tobytes()))
                sig.append(_planes(shingles.minhash(found, draws)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())], schema=arrow)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def _planes(values: np.ndarray) -> bytes:
    """Minwise values as planes of equal bytes, the lowest first: what compares members needs that plane alone."""
    return values.view(np.uint8).reshape(PLACES, 4).T.tobytes()


def _values(sigs: list[bytes]) -> np.ndarray:
    """The minwise values of signatures, a row each."""
    planes = np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, 4, PLACES)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.uint32).reshape(-1, PLACES)


def _brief(places: int = PLACES) -> Column:
    """The lowest bytes of the first minwise values. Equal values have equal bytes, so a pair agrees in as
    many places as before, or in a few more (one in 256 of the others); what that adds are candidates,
    which are decided by their full sets."""
    return F.substring("sig", 1, places)


def chosen_places(path: int, similarity: float) -> list[int]:
    """The signature places that the node with this path branches by: 1 / similarity on average."""
    h = xxhash.xxh3_64_intdigest(path.to_bytes(8, "little"), seed=11)
    more = (h >> 40) / (1 << 24) < 1 / similarity - int(1 / similarity)
    first, second = h % PLACES, (h >> 20) % (PLACES - 1)
    return [first, second + (second >= first)] if more else [first]


def survival(similarity: float, depth: int, agreement: float | None = None) -> float:
    """The chance that a pair shares a node at ``depth`` of one tree made for ``similarity``: a pair at
    the threshold, or one whose signatures agree in the share ``agreement`` of places."""
    two, f = 1 / similarity - 1, 1.0
    for _ in range(depth):
        p = (similarity if agreement is None else agreement) * f
        f = (1 - two) * p + two * (1 - (1 - p) ** 2)
    return f


def _binomial(n: int, p: float) -> list[float]:
    return [comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]


def calibrate(similarity: float, recall: float, depth: int) -> tuple[int, int, int]:
    """(trees, places, quarter): how many trees, and in how many of all places and of the first quarter
    a pair has to agree to be tested, so that all three together miss a pair at the threshold with a
    chance of at most ``1 - recall``: half of it by the trees, a quarter by each estimate.

    All trees branch by the same places, so their misses are independent only given the number of
    places that agree; over that the chance is averaged.
    """
    miss = 1 - recall

    def least(places: int) -> int:
        k, below = 0, 0.0
        for chance in _binomial(places, similarity):
            below += chance
            if below > miss / 4:
                return k
            k += 1
        return places

    agree = _binomial(PLACES, similarity)
    part = [1 - survival(similarity, depth, k / PLACES) for k in range(PLACES + 1)]
    trees = 1
    while sum(a * m**trees for a, m in zip(agree, part, strict=True)) > miss / 2:
        trees += 1
    return trees, least(PLACES), least(PLACES // 4)


def _child(path: int, place: int, values: np.ndarray) -> np.ndarray:
    salt = np.uint64(xxhash.xxh3_64_intdigest(path.to_bytes(8, "little") + place.to_bytes(2, "little")))
    return shingles.mix(values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt).view(np.int64)


def _branch(rows: DataFrame, similarity: float, trees: int | None) -> DataFrame:
    """Children (node, id, tree) of rows (id, sig), for roots, or (node, id, tree, sig)."""
    schema = T.StructType([T.StructField("node", T.LongType()), util.field(rows, "id"), T.StructField("tree", T.IntegerType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _values(batch.column("sig").to_pylist())
            if trees is not None:
                parents = [(t, t + 1, np.arange(len(values))) for t in range(trees)]
            else:
                node, tree = batch.column("node").to_numpy(), batch.column("tree").to_numpy()
                order = np.argsort(node, kind="stable")
                cuts = np.flatnonzero(np.diff(node[order])) + 1
                parents = [(int(tree[at[0]]), int(node[at[0]]) & ((1 << 64) - 1), at) for at in np.split(order, cuts)]
            nodes, at, which = [], [], []
            for tree_no, path, rows_at in parents:
                for place in chosen_places(path, similarity):
                    nodes.append(_child(path, place, values[rows_at, place]))
                    at.append(rows_at)
                    which.append(np.full(len(rows_at), tree_no, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), batch.column("id").take(pa.array(np.concatenate(at))).cast(arrow.field(1).type), pa.array(np.concatenate(which))], schema=arrow)

    return rows.mapInArrow(run, schema)


def _dense(large: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The nodes, of rows (node, id), whose members agree with the node's hubs in the share ``least`` of the
    first places, on average. Of a node's pairs a level of branching leaves the share of places in which
    they agree, over the similarity: those of such a node stay together, with a row for each child."""
    places = PLACES // 4
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("same", T.LongType()), T.StructField("of", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own, hubs = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, places) for x in (batch.column("s"), batch.column("hubs").flatten()))
            owner = np.repeat(np.arange(len(own)), batch.column("hubs").value_lengths().to_numpy())
            nodes, at = np.unique(batch.column("node").to_numpy()[owner], return_inverse=True)
            same = np.bincount(at, (own[owner] == hubs).sum(1), len(nodes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(same), pa.array(places * np.bincount(at, minlength=len(nodes)))], schema=arrow)

    first = sets.select("id", _brief(places).alias("s"))
    hubs = _hubs(large.select("node", "id", F.lit(2).alias("parts")), "node").join(first, "id").groupBy("node").agg(F.collect_list("s").alias("hubs"))
    # written, so that the join can be split at a node that holds many documents
    hubs = util.materialize(hubs, "node_hubs")
    counts = large.select("node", "id").join(first, "id").join(hubs, "node").select("node", "s", "hubs").mapInArrow(run, schema)
    sums = counts.groupBy("node").agg(F.sum("same").alias("same"), F.sum("of").alias("of"))
    found = util.materialize(sums.where(F.col("same") >= least * F.col("of")).select("node"), "dense")
    util.drop_table(hubs)
    return found


def leaves(sets: DataFrame, similarity: float, trees: int, leaf_rows: int, depth: int) -> DataFrame:
    """(node, id, size) for all leaves with two documents at least, as a written table.

    sets: id, sig. Children are counted after each level; those of up to ``leaf_rows`` documents are
    leaves, those of copies of one another (see _dense), and all at ``depth``. A node that is a leaf earlier
    loses no pair. Counts are written before they are joined, so that both
    sides of the join are exchanges and Spark can split a node that holds many documents.
    """
    done, level, written = None, _branch(sets.select("id", "sig"), similarity, trees), []
    for k in range(1, depth + 1):
        level = util.materialize(level, f"level{k}")
        sizes = util.materialize(level.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), f"sizes{k}")
        written += [level, sizes]
        held = level.join(sizes, "node")
        leaf = held if k == depth else held.where(F.col("size") <= leaf_rows)
        leaf = leaf.select("node", "id", "size")
        done = leaf if done is None else done.unionByName(leaf)
        if k < depth:
            # few rows, read several times
            large = util.materialize(held.where(F.col("size") > leaf_rows).select("node", "id", "tree", "size"), f"large{k}")
            written.append(large)
            if large.isEmpty():
                break
            dense = _dense(large, sets, DENSE * similarity)
            written.append(dense)
            done = done.unionByName(large.join(dense, "node", "left_semi").select("node", "id", "size"))
            large = large.join(dense, "node", "left_anti").drop("size")
            level = _branch(large.join(sets.select("id", "sig"), "id"), similarity, None)
    made = util.materialize(done, "leaves")
    for table in written:
        util.drop_table(table)
    return made


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Positions of pairs that form a spanning forest over ``n`` nodes; earlier pairs go first.

    All components choose their first pair to another one at once and merge, until none is left.
    """
    label, kept, live = np.arange(n), [], np.arange(len(i))
    while True:
        live = live[label[i[live]] != label[j[live]]]
        if not len(live):
            break
        a, b = label[i[live]], label[j[live]]
        first = np.full(n, len(i))
        np.minimum.at(first, a, live)
        np.minimum.at(first, b, live)
        at = np.flatnonzero(first < len(i))
        pick = first[at]
        kept.append(np.unique(pick))
        x, y = label[i[pick]], label[j[pick]]
        to = np.arange(n)
        to[at] = np.where(x == at, y, x)
        # two that chose each other: the smaller one is the root
        both = (to[to] == np.arange(n)) & (np.arange(n) < to)
        to[both] = np.flatnonzero(both)
        while (to[to] != to).any():
            to = to[to]
        label = to[label]
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def _first_hub(i: np.ndarray, j: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links (member i, hub j) the one of each member whose hub has the smallest ``k``."""
    order = np.lexsort((k[j], i))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
    return i[first], j[first]


def _named(ids: pa.Array, i: np.ndarray, j: np.ndarray, arrow: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([ids.take(pa.array(x)).cast(f.type) for x, f in zip((i, j), arrow, strict=True)], schema=arrow)


def _pair_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("a", id_type), T.StructField("b", id_type)])


def _hubs(rows: DataFrame, group: str) -> DataFrame:
    """(group, id, k): up to HUBS members of each group of several blocks (parts), by chance."""
    k = F.pmod(F.xxhash64("id"), F.lit(HUBS)).cast("int")
    first = F.min(F.struct(F.xxhash64("id", F.lit(9)).alias("h"), "id")).alias("first")
    return rows.where("parts > 1").groupBy(group, k.alias("k")).agg(first).select(group, "first.id", "k")


def _beside_hubs(rows: DataFrame, group: str) -> DataFrame:
    """(group, id, k, blocks): the members of groups of several blocks, each with its block and k null,
    and the hubs with all blocks of their group and their k. What is compared is joined to these, so
    that it is copied for hubs alone."""
    large = rows.where("parts > 1").select(group, "id", "parts").distinct()
    block = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    members = large.select(group, "id", F.lit(None).cast("int").alias("k"), F.array(block).alias("blocks"))
    hubs = large.join(_hubs(large, group), [group, "id"]).select(group, "id", "k", F.sequence(F.lit(0), F.col("parts") - 1).alias("blocks"))
    return members.unionByName(hubs)


def _placed(rows: DataFrame, group: str, linked: DataFrame | None) -> DataFrame:
    """(group, id, block, others): the block of each row (group, id, parts) of its group's blocks, and
    the blocks that it is to be compared with; rows without any are left out.

    ``linked`` has the hub (k) that a member is linked with. Those of one hub are connected by it, so
    they lie in blocks of their own and these are not compared with one another, but with all others:
    the copies of one text make a number of rows that grows with them, and not with its square.
    """
    if linked is None:
        return rows.select(group, "id", F.lit(0).alias("block"), F.array(F.lit(0)).alias("others"))
    mine = util.materialize(rows.join(linked.select(group, "id", "k"), [group, "id"], "left"), "members")
    per = F.ceil(F.col("m") / F.col("parts"))
    count = mine.groupBy(group).agg(F.first("parts").alias("parts"), F.count("*").alias("m"), *(F.count_if(F.col("k") == j).alias(f"c{j}") for j in range(HUBS)))
    own = [F.when((F.col("parts") > 1) & (F.col(f"c{j}") * 2 >= per), F.col(f"c{j}")).otherwise(0) for j in range(HUBS)]
    count = count.withColumn("sizes", F.array(*own)).withColumn("sizes", F.concat("sizes", F.array(F.col("m") - F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))))
    count = count.withColumn("nb", F.transform("sizes", lambda x: F.ceil(x / per).cast("int")))
    upto = lambda j: F.aggregate(F.slice("nb", 1, j), F.lit(0), lambda a, x: a + x) if j else F.lit(0)
    count = count.select(group, "nb", F.array(*(upto(j) for j in range(HUBS + 1))).alias("off"), upto(HUBS + 1).alias("total"))
    mine = mine.join(count, group)
    slot = F.when(F.col("k").isNotNull() & (F.get("nb", F.col("k")) > 0), F.col("k")).otherwise(HUBS)
    mine = mine.withColumn("slot", slot).withColumns({"from": F.get("off", F.col("slot")), "n_own": F.get("nb", F.col("slot"))})
    others = F.filter(F.sequence(F.lit(0), F.col("total") - 1), lambda x: (F.col("slot") == HUBS) | (x < F.col("from")) | (x >= F.col("from") + F.col("n_own")))
    return mine.select(group, "id", (F.col("from") + F.pmod(F.xxhash64("id"), F.col("n_own"))).cast("int").alias("block"), others.alias("others")).where(F.size("others") > 0)


def _pairs(rows: DataFrame, group: str, buckets: int) -> DataFrame:
    """``rows`` (block, others, ...) once for each pair (p, q) of blocks that they are in, and the
    bucket of pairs that go to one task."""
    pairs = rows.withColumn("other", F.explode("others")).drop("others").withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other"))
    return pairs.withColumn("bucket", F.pmod(F.xxhash64(group, "p", "q"), F.lit(buckets)))


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places at which each row of ``a`` and each of ``b`` agree; rows of ``a.T`` are places."""
    out = np.zeros((len(a), len(b)), np.uint8)
    for x, y in zip(a.T, b.T, strict=True):
        out += x[:, None] == y[None]
    return out


def candidate_forest(leaf: DataFrame, sets: DataFrame, similarity: float, block_rows: int, buckets: int, least: int, first_least: int) -> DataFrame:
    """Pairs (a, b) that span what is connected by pairs of members (node, id, size) of one node whose
    sets (id, n, sig) agree in ``least`` places, and in ``first_least`` of the first quarter.

    Nodes of more than ``block_rows`` members are compared with a few of them first, and then block by
    block where these don't connect them already; nodes are dealt into ``buckets`` groups, so that
    small ones are compared many at once.
    """
    schema = _pair_schema(leaf.schema["id"].dataType)
    arrow = to_arrow_schema(schema)
    quarter, percent = PLACES // 4, round(100 * similarity)

    def likely(sig, i, j) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pairs those that agree in enough places, and in how many."""
        out = []
        for s in range(0, len(i), 1 << 14):
            x, y = i[s : s + (1 << 14)], j[s : s + (1 << 14)]
            keep = (sig[x, :quarter] == sig[y, :quarter]).sum(1) >= first_least
            x, y = x[keep], y[keep]
            same = (sig[x] == sig[y]).sum(1)
            out.append((x[same >= least], y[same >= least], same[same >= least]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3

    def small_nodes(starts, sizes, n, sig):
        """All pairs of nodes of few members, those of one size at once."""
        for size in np.unique(sizes):
            x, y = np.triu_indices(int(size), 1)
            mine = starts[sizes == size]
            step = max(1, HELD_PAIRS // len(x))
            for s in range(0, len(mine), step):
                at = mine[s : s + step, None]
                i, j = (at + x).ravel(), (at + y).ravel()
                keep = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
                yield likely(sig, i[keep], j[keep])

    def large_node(at, to, one, n, sig):
        """Pairs of a block with itself (``one``) or with another block."""
        small, large = np.minimum(n[at][:, None], n[to][None]), np.maximum(n[at][:, None], n[to][None])
        may = 100 * small >= percent * large
        if one:
            may &= np.arange(len(at))[:, None] < np.arange(len(to))[None]
        if may.any():
            may &= _agreement(sig[at, :quarter], sig[to, :quarter]) >= first_least
        i, j = np.nonzero(may)
        return likely(sig, at[i], to[j])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("node", "ascending"), ("p", "ascending"), ("q", "ascending"), ("id", "ascending")])
        ids = table["id"].combine_chunks()
        node, p, q, n, block = (table[c].to_numpy() for c in ("node", "p", "q", "n", "block"))
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(-1, PLACES)
        starts = np.flatnonzero(np.r_[True, (np.diff(node) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)])
        sizes = np.diff(np.r_[starts, len(node)])
        few = (sizes <= 32) & (p[starts] == q[starts])
        coded = ids.dictionary_encode()
        code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        found, held, most = [], 0, HELD_PAIRS

        def pairs_found():
            yield from small_nodes(starts[few & (sizes > 1)], sizes[few & (sizes > 1)], n, sig)
            for start, size in zip(starts[~few].tolist(), sizes[~few].tolist(), strict=True):
                rows = np.arange(start, start + size)
                at, to = rows[block[rows] == p[start]], rows[block[rows] == q[start]]
                if len(at) and len(to):
                    yield large_node(at, to, p[start] == q[start], n, sig)

        def forest(parts):
            i, j, same = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.argsort(-same.astype(np.int64), kind="stable")
            keep = order[spanning(i[order], j[order], len(names))]
            return i[keep], j[keep], same[keep]

        for i, j, same in pairs_found():
            found.append((code[i], code[j], same.astype(np.uint8)))
            held += len(i)
            if held > most:
                found = [forest(found)]
                held = len(found[0][0])
                most = HELD_PAIRS + held
        if not found:
            return arrow.empty_table()
        i, j, _ = forest(found)
        return _named(names, i, j, arrow)

    star_schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("id", leaf.schema["id"].dataType), T.StructField("k", T.IntegerType()), T.StructField("hub", leaf.schema["id"].dataType)])
    star_arrow = to_arrow_schema(star_schema)

    def star(table: pa.Table) -> pa.Table:
        """Each member with the first hub that it likely links with."""
        table = table.sort_by([("node", "ascending"), ("block", "ascending"), ("k", "ascending")])
        node, block, n = (table[c].to_numpy() for c in ("node", "block", "n"))
        k = table["k"].fill_null(-1).to_numpy()
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(-1, PLACES)
        starts = np.flatnonzero(np.r_[True, (np.diff(node) != 0) | (np.diff(block) != 0)])
        found = []
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(node)], strict=True):
            rows = np.arange(start, end)
            mine, hubs = rows[k[rows] < 0], rows[k[rows] >= 0]
            if len(mine) and len(hubs):
                i, j, _ = large_node(mine, hubs, False, n, sig)
                found.append(_first_hub(i, j, k))
        i, j = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        ids = table["id"].combine_chunks()
        return pa.Table.from_arrays([pa.array(node[i]), ids.take(pa.array(i)).cast(star_arrow.field(1).type), pa.array(k[j].astype(np.int32)), ids.take(pa.array(j)).cast(star_arrow.field(3).type)], schema=star_arrow)

    sets = sets.select("id", "n", _brief().alias("sig"))
    sized = leaf.select("node", "id", F.ceil(F.col("size") / block_rows).cast("int").alias("parts"))
    linked = None
    if not leaf.where(F.col("size") > block_rows).isEmpty():
        dealt = _beside_hubs(sized, "node").join(sets, "id").withColumn("block", F.explode("blocks"))
        dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("node", "block"), F.lit(buckets)))
        linked = dealt.select("bucket", "node", "block", "k", "id", "n", "sig").groupBy("bucket").applyInArrow(star, star_schema)
        linked = util.materialize(linked.dropDuplicates(["node", "id"]), "starred")
    pairs = _pairs(_placed(sized, "node", linked).join(sets, "id"), "node", buckets)
    found = pairs.select("bucket", "node", "p", "q", "id", "n", "block", "sig").groupBy("bucket").applyInArrow(run, schema)
    return found if linked is None else found.unionByName(linked.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")))


def clusters(forest: DataFrame, sets: DataFrame) -> DataFrame:
    """(grp, id, n): groups of ids such that the ends of each candidate pair share one: the components
    of the forest."""
    component = connected_components(forest, "a", "b").select(F.col("node").alias("id"), F.xxhash64("component").alias("grp"))
    return component.join(sets.select("id", "n").distinct(), "id").select("grp", "id", "n")


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each of the sets ``a`` shares with each of the sets ``b``.

    Elements in many sets of both lists are counted by a matrix product, the others by listing the
    pairs of sets that each is in.
    """
    out = np.zeros((len(a), len(b)), np.int64)
    values = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b)]
    owner = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    order = [np.argsort(v, kind="stable") for v in values]
    values, owner = [v[o] for v, o in zip(values, order, strict=True)], [w[o] for w, o in zip(owner, order, strict=True)]
    known, at, n = [], [], []
    for v in values:
        first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, np.int64)
        known.append(v[first])
        at.append(first)
        n.append(np.diff(np.r_[first, len(v)]))
    _, x, y = np.intersect1d(*known, assume_unique=True, return_indices=True)
    ax, ay, nx, ny = at[0][x], at[1][y], n[0][x], n[1][y]
    many = nx * ny >= 1024
    for s in range(0, int(many.sum()), 1024):
        k = np.flatnonzero(many)[s : s + 1024]
        seen = []
        for size, starts, counts, own in ((len(a), ax[k], nx[k], owner[0]), (len(b), ay[k], ny[k], owner[1])):
            m = np.zeros((size, len(k)), np.float32)
            places = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            m[own[places], np.repeat(np.arange(len(k)), counts)] = 1
            seen.append(m)
        out += (seen[0] @ seen[1].T).astype(np.int64)
    ax, ay, nx, ny = ax[~many], ay[~many], nx[~many], ny[~many]
    each = nx * ny
    cuts = np.searchsorted(np.cumsum(each), np.arange(0, each.sum(), HELD_PAIRS)) if len(each) else []
    for s, e in zip(cuts, [*cuts[1:], len(each)], strict=True):
        k = np.repeat(np.arange(s, e), each[s:e])
        r = np.arange(len(k)) - np.repeat(np.cumsum(each[s:e]) - each[s:e], each[s:e])
        i, j = owner[0][ax[k] + r // ny[k]], owner[1][ay[k] + r % ny[k]]
        out += np.bincount(i * len(b) + j, minlength=out.size).reshape(out.shape)
    return out


def links(groups: DataFrame, docs: DataFrame, similarity: float, width: int, block_rows: int, id_col: str, text_col: str) -> DataFrame:
    """Pairs (a, b) that span what is connected by pairs of a group (grp, id, n) whose full sets are
    similar enough, exactly; None without groups."""
    id_type = groups.schema["id"].dataType
    sizes = util.materialize(groups.groupBy("grp").agg(F.count("*").alias("m"), F.sum("n").alias("total")), "group_sizes")
    parts = F.greatest(F.ceil(F.col("m") / block_rows), F.ceil(F.col("total") * 8 / GROUP_BYTES)).cast("int")
    wanted = util.materialize(groups.join(sizes.select("grp", parts.alias("parts")), "grp").select("id", "grp", "parts").distinct(), "wanted")
    rows, large, total = sizes.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in (F.col("m"), F.when(parts > 1, F.col("m")).otherwise(0), F.col("total") * 8))).first()
    if not rows:
        return None
    few = max(64, total // GROUP_BYTES, rows // 1024)
    out_schema = _pair_schema(id_type)
    out_arrow, percent = to_arrow_schema(out_schema), round(100 * similarity)

    def with_sets(places: DataFrame, n: int) -> DataFrame:
        """``places`` (id, grp, ...), about ``n`` of them, with s, the shingles of each id's texts."""
        columns = [c for c in places.columns]
        schema = T.StructType([*(T.StructField(c, places.schema[c].dataType) for c in columns), T.StructField("s", T.BinaryType())])
        arrow = to_arrow_schema(schema)

        def sets(batches):
            for batch in batches:
                s = [shingles.shingle_set(t.as_py() or "", width).tobytes() for t in batch.column("text")]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).cast(f.type) for f in list(arrow)[:-1]), pa.array(s, pa.binary())], schema=arrow)

        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        return texts.join(F.broadcast(places) if n <= BROADCAST_IDS else places, "id").select(*columns, "text").mapInArrow(sets, schema)

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("grp", "ascending"), ("p", "ascending"), ("q", "ascending")])
        ids = table["id"].combine_chunks().dictionary_encode()
        code, names = ids.indices.to_numpy().astype(np.int64), ids.dictionary
        grp, p, q, block = (table[c].to_numpy() for c in ("grp", "p", "q", "block"))
        held = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["s"]]
        n = np.array([len(x) for x in held], np.int64)
        starts = np.flatnonzero(np.r_[True, (np.diff(grp) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)])
        found = []
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(grp)], strict=True):
            rows = np.arange(start, end)
            at, to = rows[block[rows] == p[start]], rows[block[rows] == q[start]]
            if len(at) and len(to):
                both = shared_counts([held[k] for k in at], [held[k] for k in to])
                near = 100 * both >= percent * (n[at][:, None] + n[to][None] - both)
                if p[start] == q[start]:
                    near = np.triu(near, 1)
                i, j = np.nonzero(near)
                keep = spanning(at[i] - start, to[j] - start, end - start)
                found.append((code[at[i[keep]]], code[to[j[keep]]]))
        i, j = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return _named(names, i, j, out_arrow)

    star_schema = T.StructType([T.StructField("grp", T.LongType()), T.StructField("id", id_type), T.StructField("k", T.IntegerType()), T.StructField("hub", id_type)])
    star_arrow = to_arrow_schema(star_schema)

    def star(table: pa.Table) -> pa.Table:
        """Each member with the first hub whose full set is similar enough."""
        table = table.sort_by([("grp", "ascending"), ("block", "ascending"), ("k", "ascending")])
        grp, block = table["grp"].to_numpy(), table["block"].to_numpy()
        k = table["k"].fill_null(-1).to_numpy()
        held = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["s"]]
        n = np.array([len(x) for x in held], np.int64)
        starts = np.flatnonzero(np.r_[True, (np.diff(grp) != 0) | (np.diff(block) != 0)])
        found = []
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(grp)], strict=True):
            at = np.arange(start, end)
            mine, hubs = at[k[at] < 0], at[k[at] >= 0]
            if len(mine) and len(hubs):
                both = shared_counts([held[x] for x in mine], [held[x] for x in hubs])
                i, j = np.nonzero(100 * both >= percent * (n[mine][:, None] + n[hubs][None] - both))
                found.append(_first_hub(mine[i], hubs[j], k))
        i, j = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        ids = table["id"].combine_chunks()
        return pa.Table.from_arrays([pa.array(grp[i]), ids.take(pa.array(i)).cast(star_arrow.field(1).type), pa.array(k[j].astype(np.int32)), ids.take(pa.array(j)).cast(star_arrow.field(3).type)], schema=star_arrow)

    linked = None
    if large:
        dealt = with_sets(_beside_hubs(wanted, "grp"), large).withColumn("block", F.explode("blocks")).withColumn("bucket", F.pmod(F.xxhash64("grp", "block"), F.lit(few)))
        linked = dealt.select("bucket", "grp", "block", "k", "id", "s").groupBy("bucket").applyInArrow(star, star_schema)
        # an id that repeats is one member of its group, but each of its texts is compared
        linked = util.materialize(linked.dropDuplicates(["grp", "id"]), "starred-sets")
    places = util.materialize(_placed(wanted, "grp", linked), "places")
    pairs = _pairs(with_sets(places, places.count()), "grp", few)
    found = pairs.select("bucket", "grp", "p", "q", "block", "id", "s").groupBy("bucket").applyInArrow(compare, out_schema)
    return found if linked is None else found.unionByName(linked.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")))


def near_duplicates(docs: DataFrame, similarity: float = 0.75, width: int = 5, recall: float = 0.9999, leaf_rows: int = 128, depth: int = 4, block_rows: int = 512, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id and kept for every row of ``docs``.

    Documents link if the Jaccard similarity of their shingle sets is at least ``similarity`` (in
    hundredths). A null or empty text, or one of white space, has an empty set and links with
    nothing; with fewer words than ``width`` the whole sequence is the one shingle. component_id is
    the smallest id reachable by links, itself included; kept marks it. Rows with a null id link
    with nothing and have a null component; an id that repeats is one node that has the links of
    all its rows. Other columns are not read; an empty table gives no rows; texts are read whole.
    """
    trees, least_places, least_quarter = calibrate(similarity, recall, depth)
    table = util.materialize(signatures(docs, width, seed, id_col, text_col), "signatures")
    own = table.where("id is not null and n > 0")
    # the first id of each set with its signature, which moves once; copies meet before they do
    first = own.groupBy("fp").agg(F.min(F.struct("id", "n", "sig")).alias("first"))
    sets = util.materialize(first.select("fp", "first.*"), "representatives")
    # written, so that joins with it can be split where a set is common
    least = util.materialize(sets.select("fp", F.col("id").alias("rep")), "first_ids")
    # the signatures of all rows are of no more use
    whole, table = table, util.materialize(table.select("id", "n", "fp"), "shingled")
    own = table.where("id is not null and n > 0")
    util.drop_table(whole)
    leaf = leaves(sets, similarity, trees, leaf_rows, depth)
    buckets = max(8, leaf.count() // 8192)
    forest = candidate_forest(leaf, sets, similarity, block_rows, buckets, least_places, least_quarter)
    forest = util.materialize(forest.distinct(), "candidates")
    groups = util.materialize(clusters(forest, sets), "groups")
    for done in (leaf, sets):
        util.drop_table(done)
    found = links(groups, docs, similarity, width, block_rows, id_col, text_col)
    found = None if found is None else util.materialize(found, "links")
    # texts that share an id are one node
    texts = F.xxhash64("fp")
    again = own.groupBy("id").agg(F.min(texts).alias("x"), F.max(texts).alias("y")).where("x != y").select("id")
    same = own.join(again, "id", "left_semi").join(least, "fp").select(F.col("rep").alias("a"), F.col("id").alias("b")).where("a != b")
    component = connected_components(same if found is None else found.unionByName(same), "a", "b")
    named = least.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    node = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("fp"))
    out = table.select("id", "n", node.alias("fp")).join(named, "fp", "left")
    to = F.coalesce("component", "id")
    made = util.materialize(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), to.alias("component_id"), F.coalesce(F.col("id") == to, F.lit(False)).alias("kept")), "near_duplicates")
    for done in (table, least, groups, forest):
        util.drop_table(done)
    return made
