"""Linkage, pair counts and ranks against all pairs and plain Python."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from parcelgraph.functions.text import trigrams
from parcelgraph.operators import linkage, pair_counts, portfolio, ranks


def grams(text):
    out = set()
    for word in "".join(c if c.isalnum() else " " for c in text.lower()).split():
        padded = f"  {word} "
        out |= {padded[k : k + 3] for k in range(len(padded) - 2)}
    return out


@pytest.mark.parametrize("least", [0.3, 0.8, 1.0])
def test_similar_pairs_are_all_found(spark, least):
    draw = random.Random(2)
    streets = ["BROADWAY", "BROADWAY AVE", "WEST BROADWAY", "BROAD WAY", "MAIN STREET", "MAIN ST", "12 MAIN ST", "13 MAIN ST", "", "..."]
    rows = [(k, draw.choice("XY"), draw.choice(streets) + draw.choice(["", " 1", " 2"])) for k in range(120)]
    frame = spark.createDataFrame(rows, "id long, block string, street string").withColumn("grams", trigrams(F.col("street")))
    want = {}
    for (a, x, s), (b, y, t) in itertools.combinations(rows, 2):
        p, q = grams(s), grams(t)
        if x == y and p and q and len(p & q) / len(p | q) >= least:
            want[a, b] = len(p & q) / len(p | q)
    got = {(r.a, r.b): r.similarity for r in linkage.similar(frame, ["block"], least).collect()}
    assert got == pytest.approx(want) and want
    listed = [(r.a, r.b) for r in linkage.gram_candidates(frame, ["block"], least).collect()]
    assert len(listed) == len(set(listed)) and set(want) <= set(listed)


def test_candidates_do_not_follow_the_block(spark):
    """Streets of one zip that have few grams in common hardly meet, however many there are."""
    draw = random.Random(3)
    word = lambda: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    for n in (200, 800):
        rows = [(k, "zip", f"{draw.randrange(1, 999)} {word()} {word()}") for k in range(n)]
        frame = spark.createDataFrame(rows, "id long, block string, street string").withColumn("grams", trigrams(F.col("street")))
        assert linkage.gram_candidates(frame, ["block"], 0.8).count() < n


@pytest.mark.parametrize("common", [2, 5, 1000])
def test_linked_pairs(spark, common):
    draw = random.Random(4)
    rows = [(g, i, f"k{draw.randrange(12)}") for g in (1, 2) for i in range(60) for _ in range(draw.randrange(4))] + [(1, i, "hub") for i in range(50)] + [(3, 1, "alone"), (3, 2, "other")]
    want, shared = {}, {}
    for g in (1, 2):
        keys = {}
        for h, i, k in rows:
            if h == g:
                keys.setdefault(i, set()).add(k)
        both = [len(keys[a] & keys[b]) for a, b in itertools.combinations(sorted(keys), 2)]
        want[g], shared[g] = sum(n > 0 for n in both), sum(both)
    frame = spark.createDataFrame(rows + rows[:20], "grp int, item int, key string")
    assert {r.grp: r.pairs for r in pair_counts.linked_pairs(frame, common).collect()} == want
    assert {r.grp: r.shared for r in pair_counts.key_pairs(frame).collect() if r.shared} == shared


def test_a_hub_makes_no_pairs(spark):
    n = 20_000
    frame = spark.range(n).select(F.lit(1).alias("grp"), F.col("id").alias("item"), F.lit("hub").alias("key"))
    frame = frame.unionByName(frame.where("item < 10").withColumn("key", F.lit("few")))
    assert pair_counts.linked_pairs(frame).collect()[0].pairs == math.comb(n, 2)


def test_recluster_of_all_actors_counts_like_pairs(spark):
    draw = random.Random(6)
    roles = ["HeadOfficer", "Agent", "Cleaner"]
    rows = [(draw.choice("AB"), f"b{draw.randrange(30):02d}", draw.choice(roles), draw.choice([" ann", "Ann", "bo", "cy", " "]), draw.choice(["hub 1", "1 st", "2 st", "3 st", ""]), "z") for _ in range(90)]
    contacts = spark.createDataFrame(rows, "actor string, bbl string, role string, name string, address string, zip string")
    out = portfolio.recluster_all(contacts, F.contains("address", F.lit("hub")), common=3).collect()
    for actor in "AB":
        names, places = {}, {}
        for a, b, role, name, address, zip_ in rows:
            if a == actor and role == "HeadOfficer" and name.strip():
                names.setdefault(b, set()).add(name.strip().upper())
            if a == actor and role != "Cleaner" and address.strip() and "hub" not in address:
                places.setdefault(b, set()).add((address.upper(), zip_))
        nodes, edges = sorted(set(names) | set(places)), {}
        for x, y in itertools.combinations(nodes, 2):
            k = len(names.get(x, set()) & names.get(y, set()))
            if k or places.get(x, set()) & places.get(y, set()):
                edges[x, y] = 1 + 0.5 * k if k else 2.0
        root = {n: n for n in nodes}
        for _ in nodes:
            for x, y in edges:
                root[x] = root[y] = min(root[x], root[y])
        want = {}
        for (x, y), w in edges.items():
            want.setdefault(root[x], []).append((w, bool(names.get(x, set()) & names.get(y, set()))))
        got = {r.component: r for r in out if r.actor == actor}
        assert set(got) == set(want)
        for c, ws in want.items():
            r = got[c]
            assert (r.buildings, r.name_edges, r.address_edges) == (sum(root[n] == c for n in nodes), sum(k for _, k in ws), sum(not k for _, k in ws))
            assert r.weight == pytest.approx(sum(w for w, _ in ws) / len(ws)) and r.bridge == (len(ws) / r.buildings < 1.5)


def test_ranks(spark):
    draw = random.Random(8)
    rows = [(k, draw.choice([None, 1, 2, 3, 5]), "x") for k in range(97)]
    frame = spark.createDataFrame(rows, "id long, v int, rank string").repartition(5)
    found, total = ranks.numbered(frame.drop("rank"), [F.desc_nulls_last("v"), F.asc("id")], ranges=7)
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert total == 97 and {r.id: r["rank"] for r in found.collect()} == {r[0]: k for k, r in enumerate(want, 1)}
    for tiles in (1, 4, 10, 97, 200):
        got = {r.id: r.tile for r in ranks.ntile(frame, [F.desc_nulls_last("v"), F.asc("id")], tiles).collect()}
        sizes = [97 // tiles + (k < 97 % tiles) for k in range(tiles)]
        assert [got[r[0]] for r in want] == [k + 1 for k, n in enumerate(sizes) for _ in range(n)]
    assert "SinglePartition" not in found._jdf.queryExecution().toString()
    assert ranks.numbered(frame.where("false"), [F.asc("id")])[0].count() == 0
