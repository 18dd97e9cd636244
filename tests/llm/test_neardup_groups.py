"""Large groups of near copies: components as by brute force, rows in proportion to members."""

import random

import numpy as np
from pyspark.sql import functions as F

from parcelgraph.llm import neardup


def shingles(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_components_of_large_groups(spark):
    draw = random.Random(4)
    pool = [f"w{k}" for k in range(3000)]
    rows = []
    for base in range(3):
        text = draw.choices(pool, k=150)
        for k in range(220):
            own = list(text)
            for _ in range(draw.choice([0, 0, 1, 2, 4])):
                own[draw.randrange(150)] = draw.choice(pool)
            rows.append((1000 * base + k, " ".join(own)))
    # a chain, each link at the threshold and the ends far apart
    text = draw.choices(pool, k=150)
    for k in range(120):
        text = text[2:] + draw.choices(pool, k=2)
        rows.append((9000 + k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, leaf_rows=24, block_rows=32).collect()}
    assert found == brute(rows)


def test_copies_of_one_text_make_rows_in_proportion(spark):
    n, parts = 20_000, 40
    rows = spark.range(n).select(F.lit(1).cast("long").alias("grp"), F.lit(parts).alias("parts"), "id")
    linked = rows.where("id % 100 != 0").select("grp", "id", F.lit(0).alias("k"))
    made = lambda found: neardup._pairs(neardup._placed(rows, "grp", found), "grp", 64)
    assert made(linked).count() < 6 * n
    pairs = made(rows.select("grp", "id", (F.col("id") % 2).cast("int").alias("k")))
    # two hubs that no link joins: the one's blocks meet the other's, none its own
    assert pairs.where("p = q").count() == 0 and pairs.count() == n * parts / 2
    assert made(rows.select("grp", "id", F.lit(2).alias("k"))).count() == 0
    dealt = neardup._beside_hubs(rows, "grp")
    assert dealt.select(F.sum(F.size("blocks"))).first()[0] == n + neardup.HUBS * parts


def test_members_of_large_groups_do_not_branch(spark):
    """Pipeline's item of round 3: near copies branched at all levels, about 110 rows a member; as a leaf
    of the first level each has one row for each tree and place."""
    draw = random.Random(8)
    pool = [f"w{k}" for k in range(3000)]
    text = draw.choices(pool, k=200)
    copy = lambda: " ".join(draw.choice(pool) if draw.random() < 0.02 else w for w in text)
    rows = [(k, copy()) for k in range(400)] + [(1000 + k, " ".join(draw.choices(pool, k=60))) for k in range(40)]
    sets = neardup.signatures(spark.createDataFrame(rows, "doc_id long, text string"), 5, 5, "doc_id", "text").select("id", "n", "sig").cache()
    found = neardup.leaves(sets, 0.75, 16, 24, 4)
    first = neardup._branch(sets, 0.75, 16).where("id < 1000").count()
    assert found.where("id < 1000").count() <= 1.05 * first


def test_members_are_compared_by_a_byte_of_each_place(spark):
    """Items of round 3 for op8 and the pipeline: comparing needs the lowest plane of a signature, and whole
    ones, four times as long, were sent to every pair of blocks."""
    draw = np.random.default_rng(3)
    whole = draw.integers(0, 1 << 32, (3, neardup.PLACES), np.uint32)
    whole[1, ::4], whole[1, 1::4], whole[1, 2::4] = whole[0, ::4], whole[0, 1::4], whole[0, 2::4]
    packed = [neardup._planes(x) for x in whole]
    assert (neardup._values(packed) == whole).all()
    sets = spark.createDataFrame([(k, 40, bytearray(x[: neardup.PLACES])) for k, x in enumerate(packed)], "id long, n long, sig binary")
    leaf = spark.createDataFrame([(7, k, 3) for k in range(3)], "node long, id long, size long")
    for block_rows in (512, 1):
        found = neardup.candidate_forest(leaf, sets, 0.75, block_rows, 8, 75, 13).collect()
        assert {tuple(sorted(r)) for r in found} == {(0, 1)}
