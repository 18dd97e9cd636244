"""Queries of verdicts by rules as rows, of look-ups, agents and checks over the graphs' tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelgraph.operators import ontology, provenance
from parcelgraph.operators.store import Store
from parcelgraph.plans import checks, graph_registry, portfolio_registry, registry, rules, verdicts  # noqa: F401  (their queries are facts here)
from parcelgraph.plans.registry import _TOKENS, _hazards, query
from parcelgraph.plans.source_registry import _LATEST
from parcelgraph.sources import adapters as src
from parcelgraph.sources import ingest
from parcelgraph.sources.ingest import DISCOVERY, EVIDENTIARY
from parcelgraph.sources.shaped import shaped, sql
from parcelgraph.sources.shared import shared_dir, write


def _folder(s, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


# --- documents and their parties ---


@query("ingest_mortgage_parties", f"""{sql("master", "parties")}, m AS {_LATEST.format("doctype IN ('MTGE', 'ASST', 'SAT')")},
g AS (SELECT documentid, nullif(string_agg(name, ' | ' ORDER BY name) FILTER (partytype = 1), '') AS a, nullif(string_agg(name, ' | ' ORDER BY name) FILTER (partytype = 2), '') AS b FROM parties GROUP BY documentid)
SELECT 'EVT-ACRIS-' || documentid AS event_id, CASE WHEN doctype <> 'ASST' THEN a END AS mortgagor_names, CASE WHEN doctype <> 'ASST' THEN b END AS mortgagee_names, CASE WHEN doctype = 'ASST' THEN a END AS assignor_names, CASE WHEN doctype = 'ASST' THEN b END AS assignee_names FROM m LEFT JOIN g USING (documentid)""")
def ingest_mortgage_parties(s, d):
    found = ingest.mortgage_instruments(shaped(s, d, "master"), shaped(s, d, "legals"), EVIDENTIARY, shaped(s, d, "parties"))[0]
    return found.select("event_id", "mortgagor_names", "mortgagee_names", "assignor_names", "assignee_names")


_MBC = f"""{sql("master", "legals", "parties", "pluto")}, l AS (SELECT DISTINCT documentid, trim(bbl) AS bbl FROM legals),
g AS (SELECT documentid, nullif(string_agg(name, ' | ' ORDER BY name) FILTER (partytype = 1), '') AS a, string_agg(name, ' | ' ORDER BY name) FILTER (partytype = 2) AS b FROM parties GROUP BY documentid),
dd AS (SELECT bbl, docdate AS deed_date, 'DEED-' || documentid || '-' || bbl AS deed_id, b AS grantee_names FROM {_LATEST.format("doctype ILIKE '%deed%'")} m JOIN l USING (documentid) JOIN g USING (documentid) WHERE docdate IS NOT NULL AND b IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY bbl ORDER BY docdate DESC, deed_id DESC) = 1),
mm AS (SELECT bbl, coalesce(docdate, recordedfiled) AS signed, 'EVT-ACRIS-' || documentid AS mortgage_id, a AS mortgagor_names FROM {_LATEST.format("doctype IN ('MTGE', 'ASST', 'SAT')")} m JOIN l USING (documentid) JOIN g USING (documentid) WHERE doctype = 'MTGE' AND a IS NOT NULL AND coalesce(docdate, recordedfiled) IS NOT NULL),
near AS (SELECT bbl, mortgage_id, signed - deed_date AS gap_days, mortgagor_names FROM dd JOIN mm USING (bbl) WHERE signed - deed_date BETWEEN -14 AND 60 QUALIFY row_number() OVER (PARTITION BY bbl ORDER BY abs(signed - deed_date), mortgage_id) = 1),
f AS (SELECT s.bbl, deed_id, grantee_names, mortgage_id, gap_days, mortgagor_names, {_TOKENS.format("grantee_names")} AS x, {_TOKENS.format("mortgagor_names")} AS y, k.bbl IS NOT NULL AS known
  FROM (SELECT DISTINCT bbl FROM l) s LEFT JOIN (SELECT DISTINCT trim(bbl) AS bbl FROM pluto WHERE trim(bbl) <> '') k USING (bbl) LEFT JOIN dd USING (bbl) LEFT JOIN near USING (bbl)),
r AS (SELECT *, CASE WHEN NOT known THEN 'building_not_resolved' WHEN coalesce(grantee_names, '') = '' THEN 'no_deed_transfer' WHEN coalesce(mortgagor_names, '') = '' THEN 'no_contemporaneous_mortgage' WHEN len(x) = 0 OR len(y) = 0 THEN 'unparseable_names' END AS reason FROM f),
o AS (SELECT *, CASE WHEN reason IS NULL THEN len(list_intersect(x, y)) > 0 END AS token_overlap FROM r)
SELECT bbl, deed_id, grantee_names, mortgage_id, gap_days::INT AS gap_days, mortgagor_names, token_overlap, NOT token_overlap AS flagged, reason IS NOT NULL AS insufficient, reason FROM o"""


@query("mortgage_verdict", _MBC)
def mortgage_verdict(s, d):
    """Every building with documents: does a mortgage near the last deed name someone else?"""
    master, legals, parties = (shaped(s, d, t) for t in ("master", "legals", "parties"))
    deeds = ingest.deeds(master, legals, parties, EVIDENTIARY)[0].select("bbl", "event_id", "event_date", "grantee_names")
    events, lots = ingest.mortgage_instruments(master, legals, EVIDENTIARY, parties)
    mortgages = events.where("event_type = 'Mortgage'").drop("bbl").join(lots, "event_id").select("bbl", "event_id", "event_date", "mortgagor_names")
    known = shaped(s, d, "pluto").where(F.trim("bbl") != "").select(F.trim("bbl").alias("bbl"))
    found = rules.mortgage_concealment(legals.select(F.trim("bbl").alias("bbl")), known, deeds, mortgages)
    return found.drop("deed_date")


# --- rules as rows ---


def _facts(s, d, name: str) -> DataFrame:
    if name == "open_hazards":
        by = rules.open_class_c(src.violations(s, d)).groupBy("bbl").agg(F.count("*").alias("open_c"), F.min("open_date").alias("oldest"))
        return by.withColumn("oldest_days", F.datediff(F.lit(src.AS_OF).cast("date"), "oldest"))
    if name == "component_sizes":
        held = src.table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("nodeid")).agg(F.count_distinct("l_suppkey").alias("bbls"))
        rows = registry.QUERIES["wcc_components"](s, d).join(held, "nodeid", "left")
        return rows.groupBy("component").agg(F.count("*").alias("members"), F.coalesce(F.sum("bbls"), F.lit(0)).alias("bbls"))
    return registry.QUERIES[name](s, d)


def _judged(rule_id: str, subject: str, met: str, said: str, facts: str, reason: str = "NULL") -> str:
    """The verdicts of one rule as SQL."""
    return f"""SELECT '{rule_id}' AS rule_id, {subject}::VARCHAR AS subject, CASE WHEN ({reason}) IS NULL THEN coalesce({met}, false) END AS verdict, ({reason})::VARCHAR AS reason, CASE WHEN ({reason}) IS NULL AND {met} THEN {said} END AS text FROM ({facts})"""


_HAZARD_FACTS = f"WITH {src.SQL} SELECT bbl, count(*) AS open_c, DATE '{src.AS_OF}' - min(open_date) AS oldest_days FROM violation WHERE violation_class = 'C' AND status = 'Open' AND open_date IS NOT NULL GROUP BY bbl"
_OF = registry.ORACLES
_BUILDING_SQL = [
    _judged("RUL-00001", "bbl", "open_c >= 3 AND oldest_days > 180", "open_c || ' open class C violations, the oldest for ' || oldest_days || ' days'", _HAZARD_FACTS),
    _judged("RUL-00007", "bbl", "deteriorating", "issued || ' class C violations in ' || n_years || ' years'", _OF["deterioration"], "CASE WHEN n_years < 3 THEN 'fewer_than_3_years' END"),
    _judged("RUL-00010", "bbl", "change < 0 AND deregulating", "units_lost || ' units lost'", _OF["rent_stabilization"], "CASE WHEN change IS NULL THEN 'a_count_is_missing' END"),
    _judged("RUL-00011", "bbl", "owed > 1000000", "n_owed || ' of ' || n || ' judgments unpaid, ' || owed || ' owed of ' || penalty", _OF["fine_evasion"]),
    _judged("RUL-00012", "bbl", "stale >= 3 AND filings = 0", "stale || ' stale violations, ' || filings || ' filings'", _OF["enforcement_gap"]),
    _judged("RUL-00014", "bbl", "signal", "\"before\" || ' before and ' || \"after\" || ' after deed ' || deed_id", _OF["ownership_change"], "CASE WHEN insufficient THEN 'too_short_a_time' END"),
    _judged("RUL-00015", "bbl", "n >= 1", "n || ' orders, ' || n_active || ' active'", _OF["vacate_history"]),
    _judged("RUL-00016", "id", "overlap = 0", "overlap || ' words in common'", _OF["name_discrepancy"], "insufficient"),
    _judged("RUL-00017", "bbl", "NOT token_overlap", "'deed ' || deed_id || ' and mortgage ' || mortgage_id || ', ' || gap_days || ' days apart'", _MBC, "reason"),
]
_NETWORK_SQL = [
    _judged("RUL-00002", "community", "confidence <> 'Low' AND n_bbls >= 2 AND (address_edges >= 1 OR name_edges >= 2)", "n_bbls || ' buildings of ' || name || ' by ' || address_edges || ' address and ' || name_edges || ' name links'", _OF["portfolio_roll_up"]),
    _judged("RUL-00003", "nodeid", "n_links >= 1", "'linked by name with ' || n_links || ' others'", _OF["landlord_linkage"]),
    _judged("RUL-00004", "nodeid", "n_addresses >= 1", "'linked by address with ' || n_addresses || ' others'", _OF["landlords_with_connections"]),
    _judged("RUL-00008", "root", "hazards > 0", "hazards || ' of ' || size || ' buildings of ' || members || ' actors'", _OF["network_exposure"], "CASE WHEN members < 2 THEN 'no_affiliates' END"),
    _judged("RUL-00009", "actor_id", "quartile = 4", "open_c || ' open class C violations over ' || units || ' units'", _OF["management_quartiles"]),
    _judged("RUL-00013", "actor_id", "boroughs > 1 OR old_buildings > 0", "'hazards in ' || boroughs || ' boroughs, ' || old_buildings || ' old cases'", _OF["recidivism"]),
]
_SIZES = f"SELECT component, count(*) AS members, coalesce(sum(bbls), 0)::BIGINT AS bbls FROM ({_OF['wcc_components']}) LEFT JOIN (SELECT l_partkey AS nodeid, count(DISTINCT l_suppkey) AS bbls FROM lineitem GROUP BY 1) USING (nodeid) GROUP BY component"
_NETWORK_SQL += [
    _judged("RUL-00005", "component", "members >= 2", "'a component of ' || members || ' landlords'", _SIZES),
    _judged("RUL-00006", "component", "bbls > 300", "'a component of ' || bbls || ' buildings'", _SIZES),
]


def _verdicts(s, d, buildings: bool) -> DataFrame:
    table = verdicts.rule_table(s)
    of_building = table["subject"].isin("bbl", "id")
    chosen = verdicts.from_table(table.where(of_building if buildings else ~of_building))
    with src.written_once(s, d):
        return verdicts.evaluate(chosen, lambda name: _facts(s, d, name)).select("rule_id", "subject", "verdict", "reason", "text")


@query("building_verdicts", " UNION ALL ".join(f"({q})" for q in _BUILDING_SQL), views=False)
def building_verdicts(s, d):
    """Every rule about buildings, as its row in the table of rules says, for all of them."""
    return _verdicts(s, d, True)


@query("network_verdicts", " UNION ALL ".join(f"({q})" for q in _NETWORK_SQL), views=False)
def network_verdicts(s, d):
    return _verdicts(s, d, False)


# --- look-ups ---


@query("violation_lookup", "SELECT event_id, violation_class, status, open_date::VARCHAR AS open_date FROM violation WHERE bbl = '0000000007'")
def violation_lookup(s, d):
    """One building's violations by its key: the condition stands on the files' own columns."""
    return src.violations_of(s, d, "0000000007").select("event_id", "violation_class", "status", "open_date")


@query("stored_lookup", "SELECT event_id, violation_class, status FROM violation WHERE bbl = '0000000011'")
def stored_lookup(s, d):
    """The same over a stored table in buckets by the computed key: one bucket is opened."""
    store = Store(s, _folder(s, "clustered"))
    tx = store.begin()
    rows = src.violations(s, d)
    tx.merge("violations", rows, ["bbl", "event_id"], whole=["violation_class", "status", "open_date"], by=["bbl"], buckets=16)
    tx.commit()
    return store.lookup("violations", bbl="0000000011").select("event_id", "violation_class", "status")


@query("supersede_disqualified", """, was AS (SELECT bbl, count(*) AS n FROM violation WHERE violation_class = 'C' AND status = 'Open' AND open_date IS NOT NULL GROUP BY bbl)
SELECT bbl AS subject_id, '2001-12-31' AS closed FROM was WHERE bbl NOT IN (SELECT bbl FROM phc)""")
def supersede_disqualified(s, d):
    """Claims of a laxer rule (one open violation) that the stricter one no longer upholds, closed."""
    lax = rules.persistent_hazard(src.violations(s, d), src.AS_OF, least=1, days=-1_000_000)
    subjects = lambda rows: rows.select(F.col("bbl").alias("subject_id"), F.lit(None).cast("date").alias("closed"))
    return ontology.close_missing(subjects(lax), subjects(_hazards(s, d)), "subject_id", "closed", src.AS_OF).select("subject_id", "closed")


# --- contacts as JSON ---

_CONTACT = """unnest(from_json(allcontacts, '[{"title": "VARCHAR", "value": "VARCHAR", "address": {"housenumber": "VARCHAR", "streetname": "VARCHAR"}}]')) AS c"""


@query("json_explode", f"""{sql("wow_bldgs")}, c AS (SELECT bbl, {_CONTACT} FROM wow_bldgs) SELECT c.title AS title, c.value AS value, count(*) AS n, count(c.address.streetname) AS with_street FROM c GROUP BY ALL""")
def json_explode(s, d):
    kind = "array<struct<title:string,value:string,address:struct<housenumber:string,streetname:string>>>"
    rows = shaped(s, d, "wow_bldgs").select("bbl", F.explode(F.from_json("allcontacts", kind)).alias("c"))
    return rows.groupBy(F.col("c.title").alias("title"), F.col("c.value").alias("value")).agg(F.count("*").alias("n"), F.count("c.address.streetname").alias("with_street"))


_AGENTS = f"""{sql("wow_bldgs")}, c AS (SELECT bbl, {_CONTACT} FROM wow_bldgs), a AS (SELECT bbl, trim(c.value) AS shown, upper(trim(c.value)) AS name, upper(c.address.housenumber || ' ' || c.address.streetname) AS address FROM c WHERE c.title = 'Agent'),
n AS (SELECT name, address, shown, count(*) AS n FROM a GROUP BY ALL), s AS (SELECT name, address, shown FROM n QUALIFY row_number() OVER (PARTITION BY name, address ORDER BY n DESC, length(shown) DESC, shown DESC) = 1)"""


@query("managing_agents", f"""{_AGENTS} SELECT s.shown AS name, address, string_agg(DISTINCT bbl, ',' ORDER BY bbl) AS bbls FROM a JOIN s USING (name, address) GROUP BY name, address, s.shown""")
def managing_agents(s, d):
    return ingest.agents(shaped(s, d, "wow_bldgs")).select("name", "address", F.array_join("bbls", ",").alias("bbls"))


@query("managed_by", f"""{_AGENTS}, k AS (SELECT DISTINCT trim(bbl) AS bbl FROM ({sql("legals")} SELECT bbl FROM legals)) SELECT s.shown AS name, address, bbl, 'ManagedBy' AS type, 'Observed' AS status, '{src.AS_OF}' AS effective_from FROM (SELECT DISTINCT name, address, bbl FROM a) a JOIN s USING (name, address) JOIN k USING (bbl)""")
def managed_by(s, d):
    """Relationships of managing agents with the buildings that are known."""
    found = ingest.agents(shaped(s, d, "wow_bldgs"))
    known = shaped(s, d, "legals").select(F.trim("bbl").alias("bbl"))
    relationships, _ = ingest.managed_by(found, known, "SRC-WOW", src.AS_OF)
    return relationships.join(found.select("agent_id", "name", "address"), "agent_id").select("name", "address", "bbl", "type", "status", "effective_from")


# --- second profiles ---


@query("ingest_ecb_violations_raw", f"""{sql("ecb_violations")} SELECT 'EVT-ECB-' || ecbviolationnumber AS event_id, ecbviolationnumber AS source_record_id, 'ECB' AS source_name FROM ecb_violations""")
def ingest_ecb_violations_raw(s, d):
    return ingest.ecb_violations(shaped(s, d, "ecb_violations"), DISCOVERY).select("event_id", "source_record_id", "source_name")


@query("ingest_records", f"""{sql("hpd_litigations")} SELECT 'EVT-HPD-LIT-' || litigationid AS event_id, litigationid AS litigation, casestatus, openjudgement FROM hpd_litigations""")
def ingest_records(s, d):
    """What the record's JSON text holds, read back."""
    events = ingest.litigations(shaped(s, d, "hpd_litigations"), DISCOVERY)
    parsed = F.from_json("raw_record", "litigationid long, casestatus string, openjudgement string")
    return events.select("event_id", parsed.alias("r")).select("event_id", F.col("r.litigationid").alias("litigation"), "r.casestatus", "r.openjudgement")


# --- checks ---


def _graph(s, d) -> dict[str, DataFrame]:
    """The tables of the graph of evidence: what the rules claim, by what evidence, from which records."""
    events = src.violations(s, d).withColumn("source_record_id", F.regexp_replace("event_id", "^EVT-HPD-", ""))
    hazards = ontology.claims(_hazards(s, d), "RUL-00001", "bbl", "run", F.lit("hazard"))
    control = src.control(s, d)
    holders = ontology.claims(control.select(F.col("actor_id").cast("string").alias("actor_id")).distinct(), "RUL-00002", "actor_id", "run", F.lit("control"))
    managed = registry.QUERIES["management_quartiles"](s, d).where("quartile = 4").select(F.col("actor_id").cast("string").alias("actor_id"))
    managers = ontology.claims(managed, "RUL-00009", "actor_id", "run", F.lit("management"))
    proof = ontology.evidence_links(hazards, events.where("violation_class = 'C' and status = 'Open'"))
    # records are observed while the violation is new
    seen = events.where(F.datediff("status_date", "open_date") <= 60).withColumn("source_id", F.when(F.col("violation_class") == "B", "SRC-DOB").otherwise("SRC-HPD"))
    observed = seen.select(F.concat_ws("-", F.lit("OBS"), "source_id", "source_record_id").alias("observation_id"), "event_id", "source_id")
    nations = src.table(s, d, "supplier").select(F.col("s_nationkey").alias("assertion_id"), F.col("s_suppkey").alias("partner"))
    held = ontology.control_relationships(control, "run").withColumn("status", F.lit("Inferred")).withColumn("rule_id", F.lit("RUL-00002"))
    # all pairs of a nation's suppliers, one row a nation with their number: they differ in their ends alone
    tied = ontology.affiliation_counts(nations.select(F.col("partner").alias("actor_id"), F.col("assertion_id").alias("component")))
    tied = tied.select(F.lit("ProbableAffiliation").alias("type"), F.lit("Inferred").alias("status"), F.lit(None).cast("string").alias("rule_id"), "pairs")
    return {
        "claims": hazards.unionByName(holders).unionByName(managers).withColumn("status", F.lit("Inferred")),
        "evidence": proof,
        "observations": observed,
        "sources": provenance.sources(s, ["HPD"], src.AS_OF),
        "rules": verdicts.rule_table(s).select("rule_id", (F.col("rule_id") == "RUL-00009").alias("deprecated")),
        "assertions": nations,
        "networks": control.groupBy("actor_id").agg(F.count("*").alias("size")).select("actor_id", F.when(F.col("size") >= 10, "run").alias("run_id")),
        "relationships": held.select("type", "status", "rule_id", F.lit(1).cast("long").alias("pairs")).unionByName(tied),
    }


_GRAPH_SQL = f"""WITH {src.SQL}, o AS (SELECT bbl, count(*) AS open_c FROM violation WHERE violation_class = 'C' AND status = 'Open' GROUP BY bbl),
q AS (SELECT actor_id, ntile(4) OVER (ORDER BY open_c / units, actor_id) AS quartile FROM (SELECT actor_id, sum(units)::BIGINT AS units, coalesce(sum(open_c), 0)::BIGINT AS open_c FROM control JOIN building USING (bbl) LEFT JOIN o USING (bbl) GROUP BY actor_id HAVING count(*) >= 10)),
e AS (SELECT v.* FROM violation v JOIN phc USING (bbl) WHERE violation_class = 'C' AND status = 'Open'),
observed AS (SELECT event_id, CASE WHEN violation_class = 'B' THEN 'SRC-DOB' ELSE 'SRC-HPD' END AS source_id FROM violation WHERE status_date - open_date <= 60)
SELECT 'C01 claims without evidence' AS name, (SELECT count(DISTINCT actor_id) FROM control) + (SELECT count(*) FROM q WHERE quartile = 4) AS n UNION ALL
SELECT 'C02 interpreted without rule', 0 UNION ALL
SELECT 'C03 evidence without observation', count(*) FROM e WHERE event_id NOT IN (SELECT event_id FROM observed) UNION ALL
SELECT 'C04 observations without source', count(*) FROM observed WHERE source_id <> 'SRC-HPD' UNION ALL
SELECT 'C05 assertions of few observations', count(*) FROM (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey) < 4) UNION ALL
SELECT 'C07 active claims of deprecated rules', count(*) FROM q WHERE quartile = 4 UNION ALL
SELECT 'C08 inferred relationships without rule', count(*) FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey UNION ALL
SELECT 'C09 networks without run', count(*) FROM (SELECT actor_id FROM control GROUP BY 1 HAVING count(*) < 10) UNION ALL
SELECT 'C11 repeated claim ids', 0 UNION ALL
SELECT 'C12 unknown rules', 0"""


@query("graph_checks", _GRAPH_SQL)
def graph_checks(s, d):
    """How many rows of the graph's tables break each invariant."""
    with src.written_once(s, d):
        g = _graph(s, d)
    claims = write(g["claims"], _folder(s, "checked-claims"))
    found = {
        "C01 claims without evidence": checks.without_partner(claims, g["evidence"], "claim_id", "claim_id"),
        "C02 interpreted without rule": checks.missing_rule(claims),
        "C03 evidence without observation": checks.without_partner(g["evidence"], g["observations"], "event_id", "event_id"),
        "C04 observations without source": checks.without_partner(g["observations"], g["sources"], "source_id", "source_id"),
        "C05 assertions of few observations": checks.too_few(g["assertions"], g["assertions"], "assertion_id", 4),
        "C07 active claims of deprecated rules": checks.of_deprecated_rules(claims, g["rules"]),
        "C08 inferred relationships without rule": checks.missing_rule(g["relationships"]),
        "C09 networks without run": checks.without_run(g["networks"]),
        "C11 repeated claim ids": checks.repeated_keys(claims, "claim_id"),
        "C12 unknown rules": checks.without_partner(claims, g["rules"], "rule_id", "rule_id"),
    }
    return _counts(found, {"C08 inferred relationships without rule": F.coalesce(F.sum("pairs"), F.lit(0))})


def _counts(found: dict[str, DataFrame], how: dict[str, Column] | None = None) -> DataFrame:
    """(name, n): how many rows each table has, or what ``how`` says of it."""
    of = lambda name: (how or {}).get(name, F.count("*")).alias("n")
    return reduce(DataFrame.unionByName, (rows.agg(of(name)).select(F.lit(name).alias("name"), "n") for name, rows in found.items()))


_BOTH_SQL = f"""{sql("pluto", "hpd_registrations", "hpd_litigations", "dob_violations")},
lots AS (SELECT DISTINCT trim(bbl) AS bbl FROM pluto WHERE trim(bbl) <> ''), registered AS (SELECT DISTINCT trim(bbl) AS bbl FROM hpd_registrations WHERE trim(bbl) <> '')
SELECT 'buildings of discovery' AS name, count(*) AS n FROM (SELECT * FROM lots UNION SELECT * FROM registered) UNION ALL
SELECT 'buildings of evidence', count(*) FROM registered UNION ALL
SELECT 'buildings of both', count(*) FROM registered UNION ALL
SELECT 'malformed keys', count(*) FROM (SELECT * FROM lots UNION SELECT * FROM registered) WHERE length(bbl) <> 10 UNION ALL
SELECT 'filings of the old source name', 0 UNION ALL
SELECT 'filings', count(*) FROM hpd_litigations UNION ALL
SELECT 'events with old ids', count(*) FROM dob_violations UNION ALL
SELECT 'repeated event ids', 0"""


@query("consistency_checks", _BOTH_SQL)
def consistency_checks(s, d):
    """The two graphs' tables against each other: counts, keys, names of sources, forms of ids."""
    discovery = write(ingest.substrate(shaped(s, d, "pluto"), shaped(s, d, "hpd_registrations")).select("bbl").distinct(), _folder(s, "discovery"))
    evidence = shaped(s, d, "hpd_registrations").where(F.trim("bbl") != "").select(F.trim("bbl").alias("bbl")).distinct()
    filings = ingest.litigations(shaped(s, d, "hpd_litigations"), DISCOVERY)
    old = ingest.dob_violations(shaped(s, d, "dob_violations"), DISCOVERY)
    found = {
        "buildings of discovery": discovery,
        "buildings of evidence": evidence,
        "buildings of both": evidence.join(discovery, "bbl", "left_semi"),
        "malformed keys": checks.malformed_keys(discovery),
        "filings of the old source name": filings.where("event_type = 'CourtFiling' and source_name = 'HPD'"),
        "filings": filings.where("event_type = 'CourtFiling' and source_name = 'HPD-Litigations'"),
        "events with old ids": checks.ids_like(old, "event_id", "^EVT-DOB-[0-9]+$"),
        "repeated event ids": checks.repeated_keys(filings, "event_id"),
    }
    return _counts(found)
