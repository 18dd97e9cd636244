"""Landlords' identities, their links, and what a community of them holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelgraph.operators.components import connected_components
from parcelgraph.operators.pair_counts import key_pairs, linked_pairs

# The contact roles that stand for ownership, and those whose addresses link.
OWNERSHIP_ROLES = ("HeadOfficer", "IndividualOwner", "CorporateOwner", "JointOwner", "Officer")
ADDRESS_ROLES = (*OWNERSHIP_ROLES, "Agent", "SiteManager", "Shareholder", "Lessee")


def identities(landlords: DataFrame) -> DataFrame:
    """(node_id, name, bizaddr, bizhousestreet, bizapt, bizzip, registrationid, bbls): one row for
    each distinct identity; bbls keep repeats. The id is a digest of the identity, so it does not
    depend on an order of rows."""
    by = ["name", "bizaddr", "bizhousestreet", "bizapt", "bizzip", "registrationid"]
    key = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by)).cast("binary"))
    return landlords.groupBy(*by).agg(F.sort_array(F.collect_list("bbl")).alias("bbls")).select(key.alias("node_id"), *by, "bbls")


def aggregators(landlords: DataFrame, most: int = 50) -> DataFrame:
    """(bizaddr, n) of the addresses of more than ``most`` rows; missing addresses are none."""
    return landlords.where("bizaddr is not null").groupBy("bizaddr").agg(F.count("*").alias("n")).where(F.col("n") > most)


def with_connections(nodes: DataFrame, name_edges: DataFrame, address_edges: DataFrame) -> DataFrame:
    """Every node with its links by name and by address as arrays of (nodeid, weight), empty without
    any. Edges: src, dst, weight, each in both directions here."""

    def listed(edges: DataFrame, name: str) -> DataFrame:
        both = edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight"))
        return both.groupBy(F.col("src").alias("nodeid")).agg(F.sort_array(F.collect_list(F.struct(F.col("dst").alias("nodeid"), "weight"))).alias(name))

    rows = nodes.join(listed(name_edges, "name_match_info"), "nodeid", "left").join(listed(address_edges, "bizaddr_match_info"), "nodeid", "left")
    kind = "array<struct<nodeid:bigint,weight:double>>"
    return rows.withColumns({c: F.coalesce(F.col(c).cast(kind), F.array().cast(kind)) for c in ("name_match_info", "bizaddr_match_info")})


def node_averages(name_edges: DataFrame, address_edges: DataFrame) -> DataFrame:
    """(nodeid, n_name, n_address, mean): distinct links of each node, and their mean weight: of the
    name links, or of the address links where a node has no other."""

    def counted(edges: DataFrame, n: str, mean: str) -> DataFrame:
        both = edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight"))
        return both.groupBy(F.col("src").alias("nodeid")).agg(F.count_distinct("dst").alias(n), F.avg("weight").alias(mean))

    rows = counted(name_edges, "n_name", "a").join(counted(address_edges, "n_address", "b"), "nodeid", "full_outer")
    return rows.select("nodeid", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_name", "n_address")), F.coalesce("a", "b").alias("mean"))


def roll_up(members: DataFrame, held: DataFrame, averages: DataFrame) -> DataFrame:
    """One row a community: its nodes, buildings, links, mean weight, shown name and anchor.

    members: nodeid, community, name; held: nodeid, bbl. Links are the sums over its nodes, halved.
    The shown name is the most frequent one, then the first by alphabet; the anchor the node that
    holds most buildings, then the smallest. A community whose links are fewer than 1.5 a node has a
    bridge. Communities without buildings, and single nodes without links, are left out.
    """
    own = held.distinct().groupBy("nodeid").agg(F.count("*").alias("size"))
    rows = members.join(averages, "nodeid", "left").join(own, "nodeid", "left").fillna(0, ["n_name", "n_address", "size"])
    sums = rows.groupBy("community").agg(F.count("*").alias("nodes"), (F.sum("n_name") / 2).cast("long").alias("name_edges"), (F.sum("n_address") / 2).cast("long").alias("address_edges"), F.avg("mean").alias("weight"), F.min_by("nodeid", F.struct(-F.col("size"), "nodeid")).alias("anchor"))
    named = members.groupBy("community", "name").agg(F.count("*").alias("n")).groupBy("community").agg(F.min_by("name", F.struct(-F.col("n"), "name")).alias("name"))
    buildings = members.select("nodeid", "community").join(held, "nodeid").select("community", "bbl").distinct().groupBy("community").agg(F.count("*").alias("n_bbls"))
    out = sums.join(named, "community").join(buildings, "community").withColumn("edges", F.col("name_edges") + F.col("address_edges"))
    return out.where("nodes > 1 or edges > 0").withColumn("bridge", F.col("edges") / F.col("nodes") < 1.5)


def apparent_control(members: DataFrame, held: DataFrame, buildings: DataFrame) -> DataFrame:
    """(community, bbl) of the known buildings that a community's members hold, each once."""
    rows = members.select("nodeid", "community").join(held, "nodeid").select("community", "bbl").distinct()
    return rows.join(buildings.select("bbl"), "bbl", "left_semi")


def recluster(contacts: DataFrame, excluded: Column) -> tuple[DataFrame, DataFrame]:
    """(links, components) of one actor's buildings without its hub.

    contacts: bbl, role, name, address, zip. Buildings link by a name in an ownership role (weight 1
    and a half for each name that both have) or else by an address (weight 2) that ``excluded`` isn't
    true of. Each building links to the first one of a name or address, which spans the same
    components as all pairs; single buildings are left out.
    """
    role = F.col("role")
    by_name = contacts.where(role.isin(*OWNERSHIP_ROLES) & (F.trim("name") != "")).select("bbl", F.upper(F.trim("name")).alias("at")).distinct()
    by_address = contacts.where(role.isin(*ADDRESS_ROLES) & (F.trim("address") != "") & ~F.coalesce(excluded, F.lit(False))).select("bbl", F.concat_ws("|", F.upper(F.trim("address")), "zip").alias("at")).distinct()

    def star(rows: DataFrame) -> DataFrame:
        first = rows.groupBy("at").agg(F.min("bbl").alias("src"))
        return rows.join(first, "at").where("bbl != src").select("src", F.col("bbl").alias("dst"), "at")

    names = star(by_name).groupBy("src", "dst").agg((1 + 0.5 * F.count_distinct("at")).alias("weight"), F.lit("name").alias("kind"))
    addresses = star(by_address).select("src", "dst", F.lit(2.0).alias("weight"), F.lit("address").alias("kind")).distinct()
    links = names.unionByName(addresses.join(names, ["src", "dst"], "left_anti"))
    return links, connected_components(links).withColumnRenamed("node", "bbl")


def recluster_all(contacts: DataFrame, excluded: Column, common: int = 64) -> DataFrame:
    """Every actor's buildings clustered again without its hub, one row a component: actor, component
    (its smallest bbl), buildings, name_edges, address_edges, weight (mean), bridge and name.

    contacts: actor, bbl, role, name, address, zip. Buildings of one actor are linked as
    :func:`recluster` says: a pair that shares names weighs 1 and a half for each, another that shares
    an address 2. Edges and weights are those of all pairs, but no pair is made of names or addresses
    that more than ``common`` buildings share. Single buildings are left out; the name is the most
    frequent one of an owner, then the first by alphabet.
    """
    role = F.col("role")
    owners = contacts.where(role.isin(*OWNERSHIP_ROLES) & (F.trim("name") != "")).select("actor", "bbl", F.upper(F.trim("name")).alias("name"))
    names = owners.select("actor", "bbl", F.concat(F.lit("n"), "name").alias("key")).distinct()
    places = contacts.where(role.isin(*ADDRESS_ROLES) & (F.trim("address") != "") & ~F.coalesce(excluded, F.lit(False))).select("actor", "bbl", F.concat(F.lit("a"), F.concat_ws("|", F.upper(F.trim("address")), "zip")).alias("key")).distinct()
    both = names.unionByName(places)
    node = F.struct("actor", "bbl")
    first = both.groupBy("actor", "key").agg(F.min("bbl").alias("low"))
    star = both.join(first, ["actor", "key"]).where("bbl != low").select(F.struct("actor", F.col("low").alias("bbl")).alias("src"), node.alias("dst"))
    component = connected_components(star).select(F.col("node.actor").alias("actor"), F.col("node.bbl").alias("bbl"), F.col("component.bbl").alias("component"))
    grp = F.struct("actor", "component").alias("grp")
    member = lambda rows: rows.join(component, ["actor", "bbl"]).select(grp, F.col("bbl").alias("item"), "key")
    by_name, by_any = linked_pairs(member(names), common), linked_pairs(member(both), common).withColumnRenamed("pairs", "edges")
    sums = by_any.join(by_name.withColumnRenamed("pairs", "name_edges"), "grp", "left").join(key_pairs(member(names)), "grp", "left").fillna(0, ["name_edges", "shared"])
    sums = sums.withColumn("address_edges", F.col("edges") - F.col("name_edges"))
    weight = (F.col("name_edges") + 0.5 * F.col("shared") + 2 * F.col("address_edges")) / F.col("edges")
    size = component.groupBy(grp).agg(F.count("*").alias("buildings"))
    named = owners.join(component, ["actor", "bbl"]).groupBy(grp, "name").agg(F.count("*").alias("n")).groupBy("grp").agg(F.min_by("name", F.struct(-F.col("n"), "name")).alias("name"))
    out = sums.join(size, "grp").join(named, "grp", "left")
    return out.select("grp.actor", "grp.component", "buildings", "name_edges", "address_edges", weight.alias("weight"), (F.col("edges") / F.col("buildings") < 1.5).alias("bridge"), F.coalesce("name", F.lit("Unknown")).alias("name"))
