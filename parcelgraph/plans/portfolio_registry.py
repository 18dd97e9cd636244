"""Queries of linkage, portfolios, stored versions and checks over them, with DuckDB SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from parcelgraph.functions import text
from parcelgraph.operators import communities, deltas, linkage, pair_counts, portfolio, relational
from parcelgraph.operators.components import connected_components
from parcelgraph.operators.store import Store
from parcelgraph.plans import rules
from parcelgraph.plans.registry import _SIMILARITY, _nodes, query
from parcelgraph.sources import adapters as src
from parcelgraph.sources.shared import delete, shared_dir, write


#: Events of a bucket of stored claims.
BUCKET_ROWS = 250_000


def _folder(s, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def _mille(c) -> F.Column:
    return F.floor(c * 1000 + 0.0001)


# --- linkage ---

_BUSY = "SELECT street, zip FROM landlord GROUP BY ALL HAVING count(*) >= 9"


def _busy(nodes: DataFrame) -> DataFrame:
    contacts = nodes.select("house", F.col("street_name").alias("street"), "zip", F.lit(1).cast("long").alias("contacts"))
    return relational.busy_addresses(contacts, 9)


@query("landlord_linkage", f""", busy AS ({_BUSY}), n AS (SELECT nodeid, upper(trim(name)) AS nm, street, apt, zip FROM landlord WHERE NOT EXISTS (FROM busy WHERE busy.street = landlord.street AND busy.zip = landlord.zip)),
e AS (SELECT a.nodeid AS a, b.nodeid AS b, {_SIMILARITY.replace('{0}', 'street')} AS sim, a.apt = b.apt AS same FROM n a JOIN n b ON a.nm = b.nm AND a.zip = b.zip AND a.nodeid <> b.nodeid),
l AS (SELECT a, count(*) AS n_links, avg(1 + sim + CASE WHEN same THEN 0.5 ELSE 0 END) AS mean FROM e WHERE sim > 0.2 OR (sim > 0.15 AND same) GROUP BY a)
SELECT nodeid, coalesce(n_links, 0) AS n_links, floor(mean * 1000 + 0.0001)::BIGINT AS mean_mille FROM landlord LEFT JOIN l ON a = nodeid""")
def landlord_linkage(s, d):
    """How many others each landlord is linked with by name, and the mean weight, without the pairs."""
    nodes = _nodes(s, d)
    busy = _busy(nodes)
    classes = write(linkage.name_classes(nodes, busy), _folder(s, "name-classes"))
    links = write(linkage.name_class_links(classes, high=0.2, with_apartment=0.15), _folder(s, "name-links"))
    found = linkage.members_of(nodes, busy).join(linkage.class_averages(classes, links), "id", "left")
    return nodes.select("nodeid").join(found, "nodeid", "left").select("nodeid", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), _mille(F.col("mean")).alias("mean_mille"))


@query("busy_excluded", f""", busy AS ({_BUSY}) SELECT nodeid, street, zip FROM landlord WHERE NOT EXISTS (FROM busy WHERE busy.street = landlord.street AND busy.zip = landlord.zip)""")
def busy_excluded(s, d):
    nodes = _nodes(s, d)
    return linkage.without_busy(nodes, _busy(nodes)).select("nodeid", "street", "zip")


@query("normalised_addresses", """SELECT p_partkey AS nodeid, upper(trim(regexp_replace(p_size || 'th ' || lower(p_type) || ' 2ND', '(\\d+)(st|nd|rd|th)\\b', '\\1', 'gi'))) AS address, regexp_replace(p_brand, '\\D', '', 'g') AS apartment FROM part""")
def normalised_addresses(s, d):
    written = F.concat(F.col("p_size").cast("string"), F.lit("th "), F.lower("p_type"), F.lit(" 2ND"))
    return src.table(s, d, "part").select(F.col("p_partkey").alias("nodeid"), text.lookup_address(written).alias("address"), text.digits(F.col("p_brand")).alias("apartment"))


@query("strongest_links", """WITH e AS (SELECT l_suppkey * 2 AS a, l_partkey * 2 + 1 AS b, l_quantity AS w FROM lineitem) SELECT least(a, b) AS src, greatest(a, b) AS dst, max(w) AS weight FROM e GROUP BY ALL""")
def strongest_links(s, d):
    """One undirected link of an owner and a building, of those in either direction the strongest."""
    lines = src.table(s, d, "lineitem").select((F.col("l_suppkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b"), F.col("l_quantity").alias("weight"), "l_returnflag")
    there, back = lines.where("l_returnflag = 'R'"), lines.where("l_returnflag != 'R'")
    edges = there.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(back.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))
    return relational.strongest_edges(edges)


# --- portfolios ---

#: Contacts of buildings as the star schema has them: who stands on an order's lines, and in which role.
_CONTACTS = """SELECT c_nationkey AS actor, o_custkey AS bbl, CASE WHEN l_quantity = 50 THEN 'HeadOfficer' WHEN l_quantity = 49 THEN 'Agent' WHEN l_quantity = 48 THEN 'JointOwner' ELSE 'Cleaner' END AS role,
 CASE WHEN s_nationkey = 7 THEN ' ' ELSE concat('Name ', CAST(s_nationkey AS VARCHAR(9))) END AS name, p_brand AS address, l_returnflag AS zip
 FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey"""
_CONTACT_TABLES = ("lineitem", "orders", "customer", "supplier", "part")


def _contacts(s, d) -> DataFrame:
    return s.sql(_CONTACTS, **{t: src.table(s, d, t) for t in _CONTACT_TABLES})


_CONTACTS_SQL = _CONTACTS.format(**{t: t for t in _CONTACT_TABLES})


@query("recluster_portfolios", f"""WITH RECURSIVE c AS MATERIALIZED ({_CONTACTS_SQL}),
k AS MATERIALIZED (SELECT DISTINCT actor, bbl, 'n' || upper(trim(name)) AS key FROM c WHERE role IN ('HeadOfficer', 'JointOwner') AND trim(name) <> ''
  UNION SELECT DISTINCT actor, bbl, 'a' || upper(trim(address)) || '|' || zip FROM c WHERE role IN ('HeadOfficer', 'JointOwner', 'Agent') AND NOT contains(address, '#1')),
p AS MATERIALIZED (SELECT a.actor, a.bbl AS a, b.bbl AS b, count(*) FILTER (starts_with(a.key, 'n')) AS names FROM k a JOIN k b ON a.actor = b.actor AND a.key = b.key AND a.bbl < b.bbl GROUP BY ALL),
e AS (SELECT a AS s, b AS t FROM p UNION SELECT b, a FROM p), reach(s, t) AS (SELECT s, s FROM e UNION SELECT r.s, e.t FROM reach r JOIN e ON r.t = e.s),
m AS (SELECT s AS bbl, min(t) AS component FROM reach GROUP BY s),
g AS (SELECT actor, component, count(*) FILTER (names > 0) AS name_edges, count(*) FILTER (names = 0) AS address_edges, avg(CASE WHEN names > 0 THEN 1 + 0.5 * names ELSE 2 END) AS mean FROM p JOIN m ON m.bbl = p.a GROUP BY ALL),
n AS (SELECT component, count(*) AS buildings FROM m GROUP BY component),
w AS (SELECT component, upper(trim(name)) AS name, count(*) AS k FROM c JOIN m USING (bbl) WHERE role IN ('HeadOfficer', 'JointOwner') AND trim(name) <> '' GROUP BY component, upper(trim(name)) QUALIFY row_number() OVER (PARTITION BY component ORDER BY count(*) DESC, upper(trim(name))) = 1)
SELECT actor, component, buildings, name_edges, address_edges, floor(mean * 1000 + 0.0001)::BIGINT AS weight_mille, (name_edges + address_edges) / buildings < 1.5 AS bridge,
 CASE WHEN name_edges + address_edges > 10 AND mean > 2.5 AND NOT (name_edges + address_edges) / buildings < 1.5 THEN 'High' WHEN name_edges + address_edges < 3 OR mean < 1.5 THEN 'Low' ELSE 'Medium' END AS confidence, coalesce(w.name, 'Unknown') AS name
FROM g JOIN n USING (component) LEFT JOIN w USING (component)""")
def recluster_portfolios(s, d):
    """Every actor's buildings clustered again without its hub, with edges and weights from classes."""
    contacts = write(_contacts(s, d).where("role != 'Cleaner'"), _folder(s, "contacts"))
    out = portfolio.recluster_all(contacts, F.contains("address", F.lit("#1")), common=16)
    edges = F.col("name_edges") + F.col("address_edges")
    sure = rules.confidence(edges, F.col("weight"), F.col("bridge"), F.lit("recluster_hub_removed"))
    return out.withColumns({"confidence": sure, "weight_mille": _mille(F.col("weight"))}).drop("weight")


@query("louvain_split")
def louvain_split(s, d):
    """Owners and buildings linked by ownership contacts; components of many lines are split."""
    return _split(s, d)[0]


def _split(s, d) -> tuple[DataFrame, DataFrame]:
    """(split components, edges) of suppliers (even numbers) and parts (odd) on lines of whole lots."""
    lines = src.table(s, d, "lineitem")
    ends = lines.where("l_quantity = 50").select((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"))
    edges = write(ends.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")), _folder(s, "ownership"))
    sizes = lines.groupBy((F.col("l_partkey") * 2 + 1).alias("nodeid")).agg(F.count("*").alias("size"))
    nodes = sizes.unionByName(src.table(s, d, "supplier").select((F.col("s_suppkey") * 2).alias("nodeid"), F.lit(0).cast("long").alias("size")))
    return communities.split_components(nodes, edges, most=3000), edges


@query("portfolio_claims")
def portfolio_claims(s, d):
    """From links through components and Louvain to claims of control: one row a community."""
    split, edges = _split(s, d)
    split = write(split, _folder(s, "communities"))
    of = split.select("nodeid", "community")
    inner = edges.join(of.withColumnsRenamed({"nodeid": "src", "community": "a"}), "src").join(of.withColumnsRenamed({"nodeid": "dst", "community": "b"}), "dst").where("a = b")
    sums = inner.groupBy(F.col("a").alias("community")).agg(F.count("*").alias("edges"), F.avg("weight").alias("weight"))
    held = split.where("nodeid % 2 = 1").groupBy("community").agg(F.count("*").alias("n_bbls"))
    facts = split.groupBy("community").agg(F.first("component").alias("component"), F.count("*").alias("nodes"), F.first("reason").alias("reason"), F.first("depth").alias("depth"), F.first("original_size").alias("original_size"))
    out = facts.join(sums, "community").join(held, "community")
    bridge = F.col("edges") / F.col("nodes") < 1.5
    out = out.withColumns({"bridge": bridge, "confidence": rules.confidence(F.col("edges"), F.col("weight"), bridge, F.col("reason"))})
    out = out.withColumn("claimed", rules.meets_claim_threshold(F.col("n_bbls"), F.lit(0), F.col("edges"), F.col("confidence")))
    claim = F.when(F.col("claimed"), F.concat(F.lit("CLM-"), F.sha1(F.concat_ws("|", F.lit("RUL-00002"), F.col("community").cast("string")).cast("binary"))))
    return out.withColumn("claim_id", claim)


# --- stored versions ---


@query("incremental_claims", "SELECT bbl AS subject_id, open_c, oldest::VARCHAR AS oldest, open_c AS n_evidence FROM phc")
def incremental_claims(s, d):
    """Claims of persistent hazard kept by three batches: every violation as first reported, then what
    became of those opened until 1999, then of the others. Equal to an evaluation of the last state."""
    now = src.violations(s, d).select("event_id", "bbl", "violation_class", "status", "open_date")
    now = write(now, _folder(s, "violations"))
    # a task sorts a bucket or a few
    buckets = max(8, -(-now.count() // BUCKET_ROWS))
    store = Store(s, _folder(s, "claims"))
    first = now.withColumns({"status": F.lit("Open"), "violation_class": F.lit("C"), "version": F.lit(1).cast("long")})
    later = now.withColumn("version", F.lit(2).cast("long"))
    early = F.coalesce(F.col("open_date") < F.lit("2000-01-01").cast("date"), F.lit(False))
    # what is newer comes first for a part of the events: the older report is late then
    for run, batch in (("b1", later.where(early)), ("b2", first), ("b3", later.where(~early))):
        deltas.apply_batch(store, batch, run, src.AS_OF, buckets=buckets)
    proof = store.read("evidence").groupBy("claim_id").agg(F.count("*").alias("n_evidence"))
    return store.read("claims").where("closed is null").join(proof, "claim_id").select("subject_id", "open_c", "oldest", "n_evidence")


@query("merged_orders", """, o AS (SELECT o_custkey AS k, min(o_orderpriority) AS first_seen, max(o_orderdate)::DATE AS last FROM orders GROUP BY 1),
a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT k, coalesce(a.n, 0) + coalesce(b.n, 0) AS n, coalesce(CASE WHEN a.n IS NOT NULL THEN 'F' END, 'other') AS source, CASE WHEN a.n IS NOT NULL THEN '2001-01-01' ELSE '2001-02-01' END AS created_at, CASE WHEN b.n IS NOT NULL THEN '2001-02-01' ELSE '2001-01-01' END AS updated_at FROM a FULL JOIN b USING (k)""")
def merged_orders(s, d):
    """Two batches merged by key: counts add up, the first source and the time of making stay."""
    orders, store = src.table(s, d, "orders"), Store(s, _folder(s, "merged"))
    for day, source, rows in (("2001-01-01", "F", orders.where("o_orderstatus = 'F'")), ("2001-02-01", "other", orders.where("o_orderstatus != 'F'"))):
        batch = rows.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n")).withColumn("source", F.lit(source))
        tx = store.begin()
        tx.merge("customers", batch, ["k"], once=["source"], add=["n"], at=F.lit(day).cast("date"), buckets=8)
        tx.commit()
    return store.read("customers")


@query("withdrawn_actor", """SELECT actor_id, lpad(bbl, 10, '0') AS bbl, effective_to FROM (
 SELECT '7' AS actor_id, bbl, '2001-12-31' AS effective_to FROM control WHERE actor_id = 7 UNION ALL
 SELECT CASE WHEN actor_id = 7 THEN '7-' || borough ELSE actor_id::VARCHAR END, bbl, NULL FROM control JOIN building USING (bbl))""")
def withdrawn_actor(s, d):
    """One actor split by borough in one version: its relationships close, new ones open."""
    held = src.control(s, d).select(F.col("actor_id").cast("string").alias("actor_id"), "bbl")
    held = write(held.join(src.buildings(s, d).select("bbl", "borough"), "bbl"), _folder(s, "held"))
    store, day = Store(s, _folder(s, "actors")), F.lit("1999-01-01").cast("date")
    tx = store.begin()
    tx.merge("relationships", held.select("actor_id", "bbl", day.alias("effective_from"), F.lit(None).cast("date").alias("effective_to")), ["actor_id", "bbl"], once=["effective_from"], always=["effective_to"], by=["actor_id"], buckets=8)
    tx.merge("actors", held.select("actor_id", F.col("actor_id").alias("name"), F.lit("High").alias("confidence"), F.lit(None).cast("date").alias("withdrawn"), F.lit("r0").alias("run")).distinct(), ["actor_id"], always=["name", "confidence", "withdrawn", "run"], buckets=8)
    tx.commit()
    children = held.where("actor_id = '7'").select(F.concat_ws("-", "actor_id", "borough").alias("actor_id"), "bbl", F.col("borough").alias("name"))
    deltas.withdraw(store, "7", children, "r1", src.AS_OF)
    return store.read("relationships").select("actor_id", "bbl", "effective_to")


@query("ingest_counters", """, v AS (SELECT bbl IN (SELECT bbl FROM building WHERE borough <> 'ASIA') AS known, open_date IS NULL AS undated FROM violation)
SELECT count(*) AS processed, count(*) FILTER (NOT known) AS missing, count(*) FILTER (known AND undated) AS skipped, count(*) FILTER (known AND NOT undated) AS written FROM v""")
def ingest_counters(s, d):
    """Counters of a write, observed in the pass that writes: no second scan."""
    counts, known = Observation(), src.buildings(s, d).where("borough != 'ASIA'").select("bbl")
    rows = relational.counted_known(src.violations(s, d), known, counts, skip=F.col("open_date").isNull())
    to = _folder(s, "ingested")
    rows.write.parquet(to)
    got = counts.get
    delete(s, to)
    return s.createDataFrame([tuple(got[c] for c in ("processed", "missing", "skipped", "written"))], "processed long, missing long, skipped long, written long")
