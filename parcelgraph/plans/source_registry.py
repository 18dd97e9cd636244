"""Queries of the ingestion of each source, over tables shaped like the sources, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelgraph.plans.registry import query
from parcelgraph.sources import ingest
from parcelgraph.sources.ingest import DISCOVERY, EVIDENTIARY
from parcelgraph.sources.shaped import shaped, sql


def _blank(x: str) -> str:
    return f"nullif(trim({x}), '')"


def _fill(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) >= {n} THEN {x} ELSE lpad({x}, {n}, '0') END"


def _parts(b: str, block: str, lot: str) -> str:
    b, block, lot = (_blank(f"CAST({x} AS VARCHAR)") for x in (b, block, lot))
    return f"({b} || {_fill(block, 5)} || {_fill(lot, 4)})"


def _key(b: str = "boro") -> str:
    return f"CASE WHEN length(trim(bbl)) = 10 THEN trim(bbl) ELSE {_parts(b, 'block', 'lot')} END"


def _valid(b: str = "boro") -> str:
    return f"CASE WHEN regexp_full_match(trim(bbl), '[1-5][0-9]{{9}}') THEN trim(bbl) ELSE {_parts(b, 'block', 'lot')} END"


_BOROUGH = "CASE left(bbl, 1) WHEN '1' THEN 'Manhattan' WHEN '2' THEN 'Bronx' WHEN '3' THEN 'Brooklyn' WHEN '4' THEN 'Queens' WHEN '5' THEN 'Staten Island' END"


@query("ingest_hpd_violations", f"""{sql("hpd_violations")}
SELECT 'EVT-HPD-' || violationid AS event_id, {_key("boroid")} AS bbl, CASE violationstatus WHEN 'Open' THEN 'Open' WHEN 'Close' THEN 'Closed' ELSE 'Unknown' END AS status, CASE WHEN trim(class) IN ('A', 'B', 'C', 'I') THEN trim(class) END AS violation_class,
  coalesce(novissueddate, inspectiondate)::VARCHAR AS event_date, novissueddate::VARCHAR AS open_date FROM hpd_violations WHERE bbl IS NOT NULL""")
def ingest_hpd_violations(s, d):
    return ingest.hpd_violations(shaped(s, d, "hpd_violations"), EVIDENTIARY).select("event_id", "bbl", "status", "violation_class", "event_date", "open_date")


@query("ingest_hpd_violations_raw", f"""{sql("hpd_violations")}
SELECT 'EVT-HPD-' || violationid AS event_id, coalesce({_blank("bbl")}, {_parts("boroid", "block", "lot")}) AS bbl, violationstatus AS status, trim(class) AS violation_class, inspectiondate::VARCHAR AS event_date, violationid::VARCHAR AS source_record_id FROM hpd_violations""")
def ingest_hpd_violations_raw(s, d):
    return ingest.hpd_violations(shaped(s, d, "hpd_violations"), DISCOVERY).select("event_id", "bbl", "status", "violation_class", "event_date", "source_record_id")


@query("ingest_dob_violations", f"""{sql("dob_violations")}
SELECT 'EVT-DOB-' || isndobbisviol AS event_id, {_key()} AS bbl, coalesce(issuedate, dispositiondate)::VARCHAR AS event_date, CASE WHEN contains(upper(violationcategory), 'DISMISSED') THEN 'Dismissed' WHEN contains(upper(violationcategory), 'RESOLVED') THEN 'Closed' WHEN contains(upper(violationcategory), 'ACTIVE') THEN 'Active' ELSE 'Unknown' END AS status,
  trim(split_part(violationtype, '-', 1)) AS violation_type_code, trim(substr(violationtype, instr(violationtype, '-') + 1)) AS violation_type, contains(violationcategory, 'HAZARDOUS') AS is_hazardous, contains(violationcategory, 'WORK W') AS is_work_without_permit
FROM dob_violations WHERE NOT (block = '99999' AND lot = '99999') AND coalesce(issuedate, dispositiondate) IS NOT NULL""")
def ingest_dob_violations(s, d):
    return ingest.dob_violations(shaped(s, d, "dob_violations"), EVIDENTIARY).select("event_id", "bbl", "event_date", "status", "violation_type_code", "violation_type", "is_hazardous", "is_work_without_permit")


@query("ingest_dob_violations_raw", f"""{sql("dob_violations")}
SELECT 'EVT-DOB-' || isndobbisviol AS event_id, trim(bbl) AS bbl, issuedate::VARCHAR AS event_date, CASE WHEN contains(upper(violationcategory), 'DISMISSED') THEN 'Dismissed' WHEN contains(upper(violationcategory), 'RESOLVED') THEN 'Resolved' WHEN contains(upper(violationcategory), 'ACTIVE') THEN 'Active' END AS status, violationtypecode AS violation_class FROM dob_violations""")
def ingest_dob_violations_raw(s, d):
    return ingest.dob_violations(shaped(s, d, "dob_violations"), DISCOVERY).select("event_id", "bbl", "event_date", "status", "violation_class")


@query("ingest_ecb_violations", f"""{sql("ecb_violations")}
SELECT 'EVT-ECB-' || ecbviolationnumber AS event_id, {_key()} AS bbl, coalesce(issuedate, serveddate, hearingdate)::VARCHAR AS event_date, CASE ecbviolationstatus WHEN 'ACTIVE' THEN 'Active' WHEN 'RESOLVE' THEN 'Closed' ELSE 'Unknown' END AS status,
  balancedue AS balance_due, CASE hearingstatus WHEN 'DEFAULT' THEN 'Stipulated' WHEN 'DISMISSED' THEN 'Observed' ELSE 'Inferred' END AS interpretive_status, nullif(concat_ws(' | ', infractioncode1 || ' first law', infractioncode2 || ' ' || sectionlawdescription2), '') AS infraction_codes
FROM ecb_violations WHERE coalesce(issuedate, serveddate, hearingdate) IS NOT NULL""")
def ingest_ecb_violations(s, d):
    return ingest.ecb_violations(shaped(s, d, "ecb_violations"), EVIDENTIARY).select("event_id", "bbl", "event_date", "status", "balance_due", "interpretive_status", "infraction_codes")


@query("ingest_litigations", f"""{sql("hpd_litigations")}
SELECT 'EVT-HPD-LIT-' || litigationid AS event_id, trim(bbl) AS bbl, coalesce(caseopendate, findingdate)::VARCHAR AS event_date, CASE casestatus WHEN 'PENDING' THEN 'Pending' WHEN 'CLOSED' THEN 'Closed' ELSE 'Unknown' END AS status, casetype AS case_type, coalesce(openjudgement = 'YES', false) AS open_judgement FROM hpd_litigations WHERE length(trim(bbl)) = 10""")
def ingest_litigations(s, d):
    return ingest.litigations(shaped(s, d, "hpd_litigations"), EVIDENTIARY).select("event_id", "bbl", "event_date", "status", "case_type", "open_judgement")


@query("ingest_litigations_raw", f"""{sql("hpd_litigations")}
SELECT 'EVT-HPD-LIT-' || litigationid AS event_id, {_valid()} AS bbl, caseopendate::VARCHAR AS event_date, casestatus AS status, casetype AS violation_class FROM hpd_litigations""")
def ingest_litigations_raw(s, d):
    return ingest.litigations(shaped(s, d, "hpd_litigations"), DISCOVERY).select("event_id", "bbl", "event_date", "status", "violation_class")


@query("ingest_complaints", f"""{sql("hpd_complaints")}
SELECT 'EVT-HPD-COMPLAINT-' || problemid AS event_id, {_valid("CASE upper(borough) WHEN 'BROOKLYN' THEN '3' WHEN 'STATEN ISLAND' THEN '5' END")} AS bbl, receiveddate::VARCHAR AS event_date, problemstatus AS status, type AS violation_class, complaintid::VARCHAR AS complaint_id, complaintanonymousflag AS anonymous_flag FROM hpd_complaints""")
def ingest_complaints(s, d):
    return ingest.complaints(shaped(s, d, "hpd_complaints"), EVIDENTIARY).select("event_id", "bbl", "event_date", "status", "violation_class", "complaint_id", "anonymous_flag")


@query("ingest_vacate_orders", f"""{sql("hpd_vacateorders")}
SELECT 'EVT-HPD-VACATE-' || vacateordernumber AS event_id, bbl, vacateeffectivedate::VARCHAR AS event_date, CASE WHEN rescinddate IS NULL THEN 'Active' ELSE 'Rescinded' END AS status, primaryvacatereason AS violation_class, rescinddate::VARCHAR AS rescind_date, numberofvacatedunits AS units_vacated FROM hpd_vacateorders WHERE regexp_full_match(bbl, '[1-5][0-9]{{9}}')""")
def ingest_vacate_orders(s, d):
    return ingest.vacate_orders(shaped(s, d, "hpd_vacateorders"), EVIDENTIARY).select("event_id", "bbl", "event_date", "status", "violation_class", "rescind_date", "units_vacated")


@query("ingest_evictions", f"""{sql("marshal_evictions")}
SELECT 'EVT-MARSHAL-' || courtindexnumber || '-' || docketnumber AS event_id, trim(bbl) AS bbl, executeddate::VARCHAR AS event_date, evictionlegalpossession AS status, CASE upper(trim(residentialcommercialind)) WHEN 'R' THEN 'RESIDENTIAL' WHEN 'C' THEN 'COMMERCIAL' ELSE trim(residentialcommercialind) END AS violation_class FROM marshal_evictions""")
def ingest_evictions(s, d):
    return ingest.evictions(shaped(s, d, "marshal_evictions"), DISCOVERY).select("event_id", "bbl", "event_date", "status", "violation_class")


@query("ingest_buildings", f"""{sql("pluto", "hpd_registrations")},
lots AS (SELECT trim(bbl) AS bbl, coalesce({_blank("address")}, 'Unknown') AS address, nullif(yearbuilt, 0) AS year_built, unitsres AS units, latitude::DOUBLE AS latitude FROM pluto WHERE trim(bbl) <> ''),
more AS (SELECT DISTINCT trim(bbl) AS bbl FROM hpd_registrations WHERE trim(bbl) <> '' AND trim(bbl) NOT IN (SELECT bbl FROM lots))
SELECT *, {_BOROUGH} AS borough FROM (SELECT * FROM lots UNION ALL SELECT bbl, NULL, NULL, NULL, NULL FROM more)""")
def ingest_buildings(s, d):
    return ingest.substrate(shaped(s, d, "pluto"), shaped(s, d, "hpd_registrations")).select("bbl", "address", "year_built", "units", F.col("latitude").cast("double").alias("latitude"), "borough")


@query("ingest_rent_stabilised", f"""{sql("pluto", "rentstab")}
SELECT trim(ucbbl) AS bbl, coalesce(address, '') AS address, nullif(latitude, 0)::DOUBLE AS latitude, uc2018 AS rs_units_2018, uc2023 AS rs_units_2023, uc2023 - uc2018 AS rs_change, coalesce(uc2023 < uc2018, false) AS rs_deregulating FROM rentstab LEFT JOIN (SELECT trim(bbl) AS bbl, address, latitude FROM pluto) p ON p.bbl = trim(ucbbl) WHERE length(trim(ucbbl)) = 10""")
def ingest_rent_stabilised(s, d):
    lots = shaped(s, d, "pluto").withColumn("bbl", F.trim("bbl")).withColumn("latitude", F.col("latitude").cast("double")).withColumn("longitude", F.col("longitude").cast("double"))
    return ingest.rent_stabilised(shaped(s, d, "rentstab"), lots).select("bbl", "address", "latitude", "rs_units_2018", "rs_units_2023", "rs_change", "rs_deregulating")


@query("ingest_dof_ownership", f"""{sql("pluto")}
SELECT trim(bbl) AS bbl, {_blank("ownername")} AS ownername, {_blank("ownertype")} AS ownertype, {_blank("zonedist1")} AS zonedist1, {_blank("landmark")} AS landmark, {_blank("histdist")} AS histdist, assessland, assesstot, exempttot FROM pluto WHERE trim(bbl) <> ''""")
def ingest_dof_ownership(s, d):
    return ingest.dof_ownership(shaped(s, d, "pluto"))


_LATEST = "(SELECT * FROM master WHERE {0} QUALIFY row_number() OVER (PARTITION BY documentid ORDER BY modifieddate DESC NULLS FIRST, crfn DESC) = 1)"


@query("ingest_deeds", f"""{sql("master", "legals", "parties")}, m AS {_LATEST.format("doctype ILIKE '%deed%'")}, l AS (SELECT DISTINCT documentid, trim(bbl) AS bbl FROM legals),
g AS (SELECT documentid, string_agg(name, ' | ' ORDER BY name) FILTER (partytype = 1) AS grantor_names, string_agg(name, ' | ' ORDER BY name) FILTER (partytype = 2) AS grantee_names FROM parties GROUP BY documentid)
SELECT 'DEED-' || m.documentid || '-' || bbl AS event_id, bbl, docdate::VARCHAR AS event_date, docamount AS doc_amount, grantor_names, grantee_names FROM m JOIN l USING (documentid) LEFT JOIN g USING (documentid)""")
def ingest_deeds(s, d):
    return ingest.deeds(*(shaped(s, d, t) for t in ("master", "legals", "parties")), EVIDENTIARY)[0].select("event_id", "bbl", "event_date", "doc_amount", "grantor_names", "grantee_names")


@query("ingest_mortgages", f"""{sql("master")}, m AS {_LATEST.format("doctype IN ('MTGE', 'ASST', 'SAT')")}
SELECT 'EVT-ACRIS-' || documentid AS event_id, CASE doctype WHEN 'MTGE' THEN 'Mortgage' WHEN 'ASST' THEN 'MortgageAssignment' ELSE 'MortgageSatisfaction' END AS event_type, coalesce(docdate, recordedfiled)::VARCHAR AS event_date, 'Recorded' AS status, crfn, nullif(reelyear, 0) AS reel_year FROM m""")
def ingest_mortgages(s, d):
    return ingest.mortgage_instruments(shaped(s, d, "master"), shaped(s, d, "legals"), EVIDENTIARY)[0].select("event_id", "event_type", "event_date", "status", "crfn", "reel_year")


@query("ingest_instrument_lots", f"""{sql("master", "legals")}
SELECT DISTINCT trim(bbl) AS bbl, 'EVT-ACRIS-' || documentid AS event_id FROM legals WHERE documentid IN (SELECT documentid FROM master WHERE doctype IN ('MTGE', 'ASST', 'SAT'))""")
def ingest_instrument_lots(s, d):
    return ingest.mortgage_instruments(shaped(s, d, "master"), shaped(s, d, "legals"), DISCOVERY)[1]


@query("ingest_parties", f"""{sql("master", "parties")}, m AS {_LATEST.format("true")},
p AS (SELECT trim(name) AS name, nullif(concat_ws(', ', {_blank("address1")}, {_blank("address2")}, {_blank("city")}, {_blank("state")}, {_blank("zip")}), '') AS address, 'EVT-ACRIS-' || documentid AS event_id, partytype,
  coalesce(CASE doctype || partytype WHEN 'MTGE1' THEN 'Mortgagor' WHEN 'MTGE2' THEN 'Mortgagee' WHEN 'ASST1' THEN 'Assignor' WHEN 'ASST2' THEN 'Assignee' WHEN 'SAT1' THEN 'Mortgagor' WHEN 'SAT2' THEN 'Mortgagee' END,
  CASE WHEN doctype ILIKE '%deed%' THEN CASE partytype WHEN 1 THEN 'Grantor' WHEN 2 THEN 'Grantee' END END, 'Other') AS role FROM parties JOIN m USING (documentid) WHERE trim(name) <> '')
SELECT name, address, event_id, role FROM p QUALIFY row_number() OVER (PARTITION BY name, address, event_id ORDER BY partytype DESC) = 1""")
def ingest_parties(s, d):
    return ingest.parties_of(shaped(s, d, "parties"), ingest.latest_master(shaped(s, d, "master"))).select("name", "address", "event_id", "role")


@query("registered_for", f"""{sql("wow_landlords", "hpd_registrations")}, n AS (SELECT min(registrationid) AS nodeid, name, bizaddr FROM wow_landlords GROUP BY name, bizaddr)
SELECT nodeid, l.bbl, l.registrationid, registrationenddate::VARCHAR AS end_date FROM wow_landlords l JOIN n USING (name, bizaddr) LEFT JOIN hpd_registrations r ON r.registrationid = l.registrationid
QUALIFY row_number() OVER (PARTITION BY nodeid, l.bbl ORDER BY registrationenddate DESC NULLS LAST, l.registrationid DESC) = 1""")
def registered_for(s, d):
    landlords = shaped(s, d, "wow_landlords")
    nodes = landlords.groupBy("name", "bizaddr").agg(F.min("registrationid").alias("nodeid"))
    return ingest.registered_for(landlords, nodes, shaped(s, d, "hpd_registrations"))
