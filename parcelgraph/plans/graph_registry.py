"""Queries of provenance, portfolios, look-ups and checks, with DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parcelgraph.functions import text
from parcelgraph.operators import ontology, portfolio, provenance
from parcelgraph.operators.components import connected_components
from parcelgraph.plans import registry, rules
from parcelgraph.plans.registry import _hazards, query
from parcelgraph.sources import adapters as src
from parcelgraph.sources import ingest
from parcelgraph.sources.shaped import shaped, sql
from parcelgraph.sources.shared import shared_dir, write

_RULE = "RUL-PHC-001"
_EVENT = "regexp_replace({0}, '^EVT-HPD-', '')"


def _claimed(s, d, events=None):
    hazards = _hazards(s, d) if events is None else rules.persistent_hazard(events, src.AS_OF)
    return ontology.claims(hazards, _RULE, "bbl", "run", F.format_string("%d open", "open_c"))


@query("claim_lineage", f""", e AS (SELECT v.* FROM violation v JOIN phc USING (bbl) WHERE violation_class = 'C' AND status = 'Open' QUALIFY row_number() OVER (PARTITION BY bbl ORDER BY open_date, event_id) <= 50)
SELECT bbl AS subject_id, '{_RULE}' AS rule_id, event_id, 'OBS-SRC-HPD-' || {_EVENT.format("event_id")} AS observation_id, 'HPD' AS source_name, '2001-12-31' AS retrieval_date FROM e""")
def claim_lineage(s, d):
    found = src.violations(s, d, src.written_lines(s, d))
    events = rules.open_class_c(found).withColumns({"source_record_id": F.regexp_replace("event_id", "^EVT-HPD-", ""), "source_id": F.lit("SRC-HPD")})
    claimed = _claimed(s, d, found)
    found = provenance.claim_lineage(claimed, ontology.evidence(claimed, events), events, provenance.observations(events, "SRC-HPD"), provenance.sources(s, ["HPD", "DOB"], src.AS_OF))
    return found


@query("observations", f"SELECT 'OBS-SRC-HPD-' || {_EVENT.format('event_id')} AS observation_id, event_id, {_EVENT.format('event_id')} AS source_record_id, 'SRC-HPD' AS source_id FROM violation")
def observations(s, d):
    return provenance.observations(src.violations(s, d).withColumn("source_record_id", F.regexp_replace("event_id", "^EVT-HPD-", "")), "SRC-HPD")


@query("evidence_events", """, e AS (SELECT *, row_number() OVER (PARTITION BY bbl ORDER BY open_date, event_id) AS k FROM violation JOIN phc USING (bbl) WHERE violation_class = 'C' AND status = 'Open')
SELECT bbl AS subject_id, open_c || ' open' AS claim_text, string_agg(event_id, ',' ORDER BY open_date, event_id) FILTER (k <= 50) AS event_ids, count(*) AS n_events FROM e GROUP BY bbl, open_c""")
def evidence_events(s, d):
    found = src.violations(s, d, src.written_lines(s, d))
    claimed = _claimed(s, d, found)
    return ontology.evidence(claimed, rules.open_class_c(found)).join(claimed, "claim_id").select("subject_id", "claim_text", F.array_join("event_ids", ",").alias("event_ids"), "n_events")


@query("involved_buildings", """SELECT actor_id AS subject_id, bbl FROM control WHERE bbl IN (SELECT bbl FROM building)""")
def involved_buildings(s, d):
    held = ontology.control_relationships(src.control(s, d), "run")
    claimed = ontology.claims(src.control(s, d).select("actor_id").distinct(), "RUL-PBC-001", "actor_id", "run", F.lit("holds"))
    return provenance.involved_buildings(claimed, held, src.buildings(s, d)).join(claimed, "claim_id").select("subject_id", "bbl")


@query("superseded_control", """, b AS (SELECT bbl FROM building WHERE units > 25) SELECT actor_id, bbl, '2001-12-31' AS effective_to FROM control WHERE bbl NOT IN (SELECT bbl FROM b)""")
def superseded_control(s, d):
    old = ontology.control_relationships(src.control(s, d), "run")
    new = old.join(src.buildings(s, d).where("units > 25").select("bbl"), "bbl", "left_semi")
    return ontology.close_missing(old, new, "relationship_id", "effective_to", src.AS_OF).select("actor_id", "bbl", "effective_to")


def _leader(cut: str) -> str:
    return f"(SELECT l_suppkey AS id, o_custkey AS bbl FROM (SELECT o_custkey, l_suppkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate {cut} TIMESTAMP '1998-01-01' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, l_suppkey) = 1)"


@query("actor_lineage", f"""WITH a AS {_leader('<')}, b AS {_leader('>=')}, m AS (SELECT DISTINCT a.id AS from_id, b.id AS to_id FROM a JOIN b USING (bbl)), n AS (SELECT *, count(*) OVER (PARTITION BY from_id) AS targets, count(*) OVER (PARTITION BY to_id) AS sources FROM m)
SELECT from_id, to_id, CASE WHEN targets > 1 THEN 'SPLIT_INTO' ELSE 'MERGED_INTO' END AS kind, '1998-01-01' AS at FROM n WHERE (targets > 1 OR sources > 1) AND from_id <> to_id""")
def actor_lineage(s, d):
    """Where the buildings of the actors before 1998 went: who held most of each then and later."""
    lines = src.table(s, d, "lineitem").join(src.table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("bbl")), "l_orderkey")
    early = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    counted = lines.groupBy("bbl", F.col("l_suppkey").alias("id")).agg(F.count_if(early).alias("before"), F.count_if(~early).alias("after"))

    def leader(n: str):
        return counted.where(F.col(n) > 0).groupBy("bbl").agg(F.max_by("id", F.struct(n, -F.col("id"))).alias("id"))

    return ontology.lineage(leader("before"), leader("after")).withColumn("at", F.lit("1998-01-01"))


@query("identity_assertions", """, o AS (SELECT o_custkey AS actor_id, max(o_orderpriority) AS was FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1), n AS (SELECT o_custkey AS actor_id, max(o_orderpriority) AS now FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1), j AS (SELECT * FROM o FULL JOIN n USING (actor_id))
SELECT actor_id, now AS name, 'create' AS action FROM j WHERE now IS NOT NULL AND (was IS NULL OR was <> now) UNION ALL SELECT actor_id, was, 'supersede' FROM j WHERE was <> now UNION ALL SELECT actor_id, was, 'withdraw' FROM j WHERE now IS NULL UNION ALL SELECT actor_id, now, 'keep' FROM j WHERE was = now""")
def identity_assertions(s, d):
    rows, day = src.table(s, d, "orders").select(F.col("o_custkey").alias("actor_id"), F.col("o_orderpriority").alias("name"), "o_orderdate"), lambda x: F.lit(x).cast("timestamp_ntz")
    named = lambda df: df.groupBy("actor_id").agg(F.max("name").alias("name"))
    return provenance.assertions(named(rows.where(F.col("o_orderdate") < day("1999-01-01"))), named(rows.where(F.col("o_orderdate") >= day("1998-01-01"))))


@query("identity_observations", f"""{sql("wow_landlords")}, g AS (SELECT DISTINCT name AS raw_name, 'SRC-WOW' AS source_id, left(bizaddr, 300) AS context, bbl FROM wow_landlords), k AS (SELECT *, row_number() OVER (PARTITION BY raw_name, source_id, context ORDER BY bbl) AS k FROM g)
SELECT raw_name, source_id, context, count(*) AS n_bbls, string_agg(bbl, ', ' ORDER BY bbl) FILTER (k <= 5) AS seen_at FROM k GROUP BY ALL""")
def identity_observations(s, d):
    rows = shaped(s, d, "wow_landlords").select(F.col("name").alias("raw_name"), F.lit("SRC-WOW").alias("source_id"), F.left("bizaddr", F.lit(300)).alias("context"), "bbl")
    return provenance.identity_observations(rows)


@query("landlord_identities", f"""{sql("wow_landlords")} SELECT md5(concat_ws('|', name, bizaddr, bizhousestreet, bizapt, bizzip, registrationid::VARCHAR)) AS node_id, name, string_agg(bbl, ',' ORDER BY bbl) AS bbls FROM (SELECT *, 0 AS registrationid FROM (SELECT * EXCLUDE registrationid FROM wow_landlords)) GROUP BY name, bizaddr, bizhousestreet, bizapt, bizzip, registrationid""")
def landlord_identities(s, d):
    return portfolio.identities(shaped(s, d, "wow_landlords").withColumn("registrationid", F.lit(0))).select("node_id", "name", F.array_join("bbls", ",").alias("bbls"))


@query("busy_business_addresses", f"{sql('wow_landlords')} SELECT bizaddr, count(*) AS n FROM wow_landlords WHERE bizaddr IS NOT NULL GROUP BY bizaddr HAVING count(*) > 12")
def busy_business_addresses(s, d):
    return portfolio.aggregators(shaped(s, d, "wow_landlords"), most=12)


#: Links between parts of one size: by name (the same words) and by address (the same type and brand).
_LINKS = """, ne AS (SELECT a.p_partkey AS src, b.p_partkey AS dst, 1.5 AS weight FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey),
ae AS (SELECT a.p_partkey AS src, b.p_partkey AS dst, 2.25 AS weight FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey)"""
_BOTH = "SELECT src, dst, weight FROM {0} UNION ALL SELECT dst, src, weight FROM {0}"


def _classes(s, d, members: bool = False):
    """Nodes with the class (smallest member) and size of those they are linked with by name and by
    address: a class stands for all its pairs. ``members`` adds the sorted list of each class."""
    nodes = src.table(s, d, "part").select(F.col("p_partkey").alias("nodeid"), "p_name", "p_type", "p_brand", "p_size")
    for kind, columns in (("name", ["p_name", "p_size"]), ("address", ["p_type", "p_brand", "p_size"])):
        listed = [F.sort_array(F.collect_list("nodeid")).alias(f"{kind}_members")] if members else []
        sizes = nodes.groupBy(*columns).agg(F.min("nodeid").alias(f"{kind}_class"), F.count("*").alias(f"{kind}_n"), *listed)
        nodes = nodes.join(sizes, columns)
    return nodes


@query("landlords_with_connections", _LINKS + f""", n AS (SELECT src AS nodeid, min(dst) AS low, count(*) AS k, string_agg(dst, ',' ORDER BY dst) AS names FROM ({_BOTH.format("ne")}) GROUP BY src), a AS (SELECT src AS nodeid, min(dst) AS low, count(*) AS k, string_agg(dst, ',' ORDER BY dst) AS addresses FROM ({_BOTH.format("ae")}) GROUP BY src)
SELECT p_partkey AS nodeid, least(p_partkey, coalesce(n.low, p_partkey)) AS name_class, coalesce(n.k, 0) AS n_names, coalesce(names, '') AS names, least(p_partkey, coalesce(a.low, p_partkey)) AS address_class, coalesce(a.k, 0) AS n_addresses, coalesce(addresses, '') AS addresses FROM part LEFT JOIN n ON n.nodeid = p_partkey LEFT JOIN a ON a.nodeid = p_partkey""")
def landlords_with_connections(s, d):
    """Each node with the classes it is linked in, how many others they have, and all of these: a
    class is listed once, and its members take the list without themselves."""
    others = lambda kind: F.array_join(F.array_remove(f"{kind}_members", F.col("nodeid")).cast("array<string>"), ",")
    return _classes(s, d, members=True).select(
        "nodeid", "name_class", (F.col("name_n") - 1).alias("n_names"), others("name").alias("names"), "address_class", (F.col("address_n") - 1).alias("n_addresses"), others("address").alias("addresses")
    )


@query("portfolio_roll_up", f"""WITH RECURSIVE {src.SQL}{_LINKS}, e AS (SELECT src, dst FROM ({_BOTH.format("ne")}) UNION SELECT src, dst FROM ({_BOTH.format("ae")})),
reach(s, t) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT r.s, e.dst FROM reach r JOIN e ON r.t = e.src), m AS (SELECT s AS nodeid, min(t) AS community FROM reach GROUP BY s),
held AS (SELECT DISTINCT l_partkey AS nodeid, l_suppkey AS bbl FROM lineitem), n1 AS (SELECT src AS nodeid, count(*) AS k, avg(weight) AS w FROM ({_BOTH.format("ne")}) GROUP BY src), n2 AS (SELECT src AS nodeid, count(*) AS k, avg(weight) AS w FROM ({_BOTH.format("ae")}) GROUP BY src),
z AS (SELECT nodeid, count(*) AS size FROM held GROUP BY nodeid), r AS (SELECT community, count(*) AS nodes, sum(coalesce(n1.k, 0))::BIGINT // 2 AS name_edges, sum(coalesce(n2.k, 0))::BIGINT // 2 AS address_edges, avg(coalesce(n1.w, n2.w)) AS weight, arg_min(m.nodeid, (-coalesce(size, 0), m.nodeid)) AS anchor FROM m LEFT JOIN n1 USING (nodeid) LEFT JOIN n2 USING (nodeid) LEFT JOIN z USING (nodeid) GROUP BY community),
nm AS (SELECT community, p_name AS name FROM m JOIN part ON p_partkey = nodeid GROUP BY community, p_name QUALIFY row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, p_name) = 1), b AS (SELECT community, count(DISTINCT bbl) AS n_bbls FROM m JOIN held USING (nodeid) GROUP BY community)
SELECT community, nodes, name_edges, address_edges, floor(weight * 1000)::BIGINT AS weight_mille, anchor, name, n_bbls, name_edges + address_edges AS edges, (name_edges + address_edges) / nodes < 1.5 AS bridge,
 CASE WHEN name_edges + address_edges > 10 AND weight > 2.5 AND (name_edges + address_edges) / nodes >= 1.5 THEN 'High' WHEN name_edges + address_edges < 3 OR weight < 1.5 THEN 'Low' ELSE 'Medium' END AS confidence FROM r JOIN nm USING (community) JOIN b USING (community) WHERE nodes > 1 OR name_edges + address_edges > 0""")
def portfolio_roll_up(s, d):
    nodes = write(_classes(s, d), f"{shared_dir(s)}/classes-{uuid.uuid4().hex}")
    star = nodes.select(F.col("name_class").alias("src"), F.col("nodeid").alias("dst")).unionByName(nodes.select(F.col("address_class").alias("src"), F.col("nodeid").alias("dst")))
    found = connected_components(star).withColumnRenamed("node", "nodeid")
    members = nodes.join(found, "nodeid").select("nodeid", F.col("component").alias("community"), F.col("p_name").alias("name"))
    held = src.table(s, d, "lineitem").select(F.col("l_partkey").alias("nodeid"), F.col("l_suppkey").alias("bbl")).distinct()
    mean = F.when(F.col("name_n") > 1, F.lit(1.5)).when(F.col("address_n") > 1, F.lit(2.25))
    averages = nodes.select("nodeid", (F.col("name_n") - 1).alias("n_name"), (F.col("address_n") - 1).alias("n_address"), mean.alias("mean"))
    out = portfolio.roll_up(members, held, averages)
    sure = rules.confidence(F.col("edges"), F.col("weight"), F.col("bridge"), F.lit(None).cast("string"))
    return out.withColumn("confidence", sure).withColumn("weight_mille", F.floor(F.col("weight") * 1000)).drop("weight")


_ROLLED = registry.ORACLES["portfolio_roll_up"]


@query("network_confidence", f"""WITH RECURSIVE rolled AS ({_ROLLED}) SELECT community, n_bbls, name_edges, address_edges, confidence, confidence <> 'Low' AND n_bbls >= 2 AND (address_edges >= 1 OR name_edges >= 2) AS claimed FROM rolled""")
def network_confidence(s, d):
    """How sure each network is, and whether it is claimed to control its buildings."""
    rows = portfolio_roll_up(s, d)
    claimed = rules.meets_claim_threshold(F.col("n_bbls"), F.col("address_edges"), F.col("name_edges"), F.col("confidence"))
    return rows.select("community", "n_bbls", "name_edges", "address_edges", "confidence", claimed.alias("claimed"))


@query("concealment", f"""WITH RECURSIVE rolled AS ({_ROLLED}) SELECT community, 'linked by ' || address_edges || ' address-based and ' || name_edges || ' name-based connections' AS summary, CASE WHEN name_edges = 0 THEN address_edges >= 2 ELSE address_edges > 10 * name_edges END AS flagged FROM rolled""")
def concealment(s, d):
    """Networks that addresses tie far more than names, read back from the text of their evidence."""
    rows = portfolio_roll_up(s, d)
    summary = F.format_string("linked by %d address-based and %d name-based connections", "address_edges", "name_edges")
    rows = rows.select("community", summary.alias("summary"))
    addresses, names = text.edge_counts(F.col("summary"))
    return rows.withColumn("flagged", rules.concealment_flag(addresses, names))


@query("apparent_control", """SELECT DISTINCT s_nationkey AS community, lpad(o_custkey::VARCHAR, 10, '0') AS bbl FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE lpad(o_custkey::VARCHAR, 10, '0') IN (SELECT bbl FROM building WHERE borough <> 'ASIA')""")
def apparent_control(s, d):
    members = src.table(s, d, "supplier").select(F.col("s_suppkey").alias("nodeid"), F.col("s_nationkey").alias("community"))
    lines = src.table(s, d, "lineitem").join(src.table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    held = lines.select(F.col("l_suppkey").alias("nodeid"), F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("bbl"))
    return portfolio.apparent_control(members, held, src.buildings(s, d).where("borough != 'ASIA'"))


_ROLE = "CASE WHEN o_orderkey % 3 = 0 THEN 'HeadOfficer' WHEN o_orderkey % 3 = 1 THEN 'Agent' ELSE 'Cleaner' END"
_CONTACT = f"SELECT o_custkey AS bbl, {_ROLE} AS role, CASE WHEN o_orderkey % 4 > 0 THEN concat('Name ', CAST(o_orderkey AS VARCHAR(20))) ELSE ' ' END AS name, CAST(floor(o_totalprice / 10) AS VARCHAR(20)) AS address, o_orderpriority AS zip FROM "


@query("recluster_without_hub", f"""WITH RECURSIVE c AS ({_CONTACT} orders), k AS (SELECT DISTINCT bbl, 'n' || upper(trim(name)) AS key FROM c WHERE role = 'HeadOfficer' AND trim(name) <> '' UNION SELECT DISTINCT bbl, 'a' || upper(trim(address)) || '|' || zip FROM c WHERE role <> 'Cleaner' AND NOT contains(address, '77')),
e AS (SELECT DISTINCT a.bbl AS s, b.bbl AS t FROM k a JOIN k b USING (key) WHERE a.bbl <> b.bbl), reach(s, t) AS (SELECT s, s FROM e UNION SELECT r.s, e.t FROM reach r JOIN e ON r.t = e.s)
SELECT s AS bbl, min(t) AS component FROM reach GROUP BY s""")
def recluster_without_hub(s, d):
    contacts = s.sql(_CONTACT + "{orders}", orders=src.table(s, d, "orders"))
    return portfolio.recluster(contacts, F.contains("address", F.lit("77")))[1]


@query("within_two_hops", """, e AS (SELECT v.bbl, event_id FROM violation v JOIN phc USING (bbl) WHERE violation_class = 'C' AND status = 'Open' QUALIFY row_number() OVER (PARTITION BY bbl ORDER BY open_date, event_id) <= 50)
SELECT 'CLAIM-' || bbl AS start, 'CLAIM-' || bbl AS node, 0 AS hops FROM phc UNION ALL SELECT 'CLAIM-' || bbl, 'EVIDENCE-' || bbl, 1 FROM phc UNION ALL SELECT 'CLAIM-' || bbl, event_id, 2 FROM e""")
def within_two_hops(s, d):
    """What a claim reaches: the evidence that supports it and the events that this aggregates."""
    found = src.violations(s, d, src.written_lines(s, d))
    claimed = _claimed(s, d, found)
    cited = ontology.evidence(claimed, rules.open_class_c(found)).join(claimed.select("claim_id", "subject_id"), "claim_id")
    claim, proof = F.concat(F.lit("CLAIM-"), "subject_id"), F.concat(F.lit("EVIDENCE-"), "subject_id")
    edges = cited.select(claim.alias("src"), proof.alias("dst")).unionByName(cited.select(proof.alias("src"), F.explode("event_ids").alias("dst")))
    return provenance.within_two_hops(edges, claimed.select(claim.alias("node")))


@query("stub_upsert", f"""{sql("pluto", "hpd_complaints")}, k AS (SELECT trim(bbl) AS bbl, address, NULL::VARCHAR AS borough FROM pluto WHERE trim(bbl) <> ''), s AS (SELECT bbl, 'seen' AS address, min(borough) AS borough FROM hpd_complaints WHERE bbl <> '' GROUP BY bbl)
SELECT bbl, coalesce(nullif(trim(k.address), ''), s.address) AS address, s.borough AS borough FROM k FULL JOIN s USING (bbl)""")
def stub_upsert(s, d):
    known = shaped(s, d, "pluto").where(F.trim("bbl") != "").select(F.trim("bbl").alias("bbl"), "address", F.lit(None).cast("string").alias("borough"))
    return provenance.stub_upsert(known, shaped(s, d, "hpd_complaints").where("bbl != ''").select("bbl", F.lit("seen").alias("address"), "borough"))


@query("enriched_buildings", f"""{sql("pluto", "hpd_registrations")}, k AS (SELECT DISTINCT trim(bbl) AS bbl FROM hpd_registrations WHERE trim(bbl) <> ''), p AS (SELECT trim(bbl) AS bbl, nullif(trim(ownername), '') AS ownername, assesstot FROM pluto WHERE trim(bbl) <> '')
SELECT bbl, ownername, assesstot FROM k FULL JOIN p USING (bbl)""")
def enriched_buildings(s, d):
    known = shaped(s, d, "hpd_registrations").where(F.trim("bbl") != "").select(F.trim("bbl").alias("bbl")).distinct()
    return provenance.enriched(known, ingest.dof_ownership(shaped(s, d, "pluto")).select("bbl", "ownername", "assesstot"))


@query("all_events", f"""{sql("hpd_vacateorders", "marshal_evictions")} SELECT 'EVT-HPD-VACATE-' || vacateordernumber AS event_id, 'VacateOrder' AS event_type, numberofvacatedunits AS units_vacated FROM hpd_vacateorders WHERE bbl <> '' UNION ALL SELECT 'EVT-MARSHAL-' || courtindexnumber || '-' || docketnumber, 'Eviction', NULL FROM marshal_evictions""")
def all_events(s, d):
    orders = ingest.vacate_orders(shaped(s, d, "hpd_vacateorders"), ingest.EVIDENTIARY)
    return orders.unionByName(ingest.evictions(shaped(s, d, "marshal_evictions"), ingest.EVIDENTIARY), allowMissingColumns=True).select("event_id", "event_type", "units_vacated")


@query("resolve_actor", "SELECT s_suppkey AS actor_id, s_name AS name FROM supplier WHERE contains(lower(s_name), '0001') ORDER BY length(s_name), s_name, s_suppkey LIMIT 5")
def resolve_actor(s, d):
    named = src.table(s, d, "supplier").select(F.col("s_suppkey").alias("actor_id"), F.col("s_name").alias("name"))
    return rules.resolve_actor(named, "0001")


@query("borough_alias", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'Bronx' WHEN o_orderkey % 4 = 1 THEN 'Staten Island' WHEN o_orderkey % 4 = 2 THEN 'Brooklyn' END AS borough FROM orders""")
def borough_alias(s, d):
    k = F.col("o_orderkey") % 4
    return src.table(s, d, "orders").select("o_orderkey", text.borough_alias(F.when(k == 0, " The BRONX").when(k == 1, "si").when(k == 2, "Bklyn ").otherwise("nowhere")).alias("borough"))


@query("index_probes", """SELECT 'open_class_c' AS probe, count(*) AS n FROM violation WHERE violation_class = 'C' AND status = 'Open' UNION ALL SELECT 'open_class_c_of_borough', count(*) FROM violation JOIN building USING (bbl) WHERE violation_class = 'C' AND status = 'Open' AND borough = 'ASIA' UNION ALL SELECT 'controlled_buildings', count(*) FROM control JOIN building USING (bbl) UNION ALL SELECT 'events_of_hpd', count(*) FROM violation WHERE starts_with(event_id, 'EVT-HPD-')""")
def index_probes(s, d):
    events, held, known = src.violations(s, d), src.control(s, d), src.buildings(s, d)
    opened = events.where("violation_class = 'C' and status = 'Open'")
    probes = {"open_class_c": opened, "open_class_c_of_borough": opened.join(known.where("borough = 'ASIA'"), "bbl", "left_semi"), "controlled_buildings": held.join(known, "bbl", "left_semi"), "events_of_hpd": events.where(F.startswith("event_id", F.lit("EVT-HPD-")))}
    out = None
    for name, rows in probes.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("probe"), "n")
        out = one if out is None else out.unionByName(one)
    return out
