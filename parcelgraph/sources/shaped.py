"""The domain's source tables, shaped from the star schema that exists here.

Each entry is one SQL text that Spark and DuckDB both read; ``{orders}`` and the like stand for the
star schema's tables. Whole tables are read; values hold what the sources are known for: blank and
malformed keys, padded codes, missing dates, repeated documents.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_DAY = "CAST(o_orderdate AS DATE)"
_TEN = "CAST(1000000000 + o_custkey AS VARCHAR(20))"
_PARTS = "CAST(1 + o_orderkey % 5 AS VARCHAR(5)) AS boro, CAST(o_custkey AS VARCHAR(20)) AS block, CAST(o_orderkey % 100 AS VARCHAR(20)) AS lot"

SOURCES = {
    "hpd_violations": """SELECT l_orderkey * 10 + l_linenumber AS violationid, CASE WHEN l_linenumber = 1 THEN '' WHEN l_linenumber = 2 THEN NULL WHEN l_linenumber = 3 THEN '0' ELSE concat(' ', CAST(3000000000 + l_partkey AS VARCHAR(20)), ' ') END AS bbl,
 CAST(1 + l_suppkey % 5 AS VARCHAR(5)) AS boroid, CAST(l_partkey AS VARCHAR(20)) AS block, CASE WHEN l_partkey % 9 > 0 THEN CAST(l_linenumber AS VARCHAR(20)) END AS lot, CASE l_returnflag WHEN 'A' THEN 'A ' WHEN 'N' THEN 'C' ELSE 'Z' END AS class,
 CASE WHEN l_linestatus = 'F' THEN 'Close' WHEN l_linenumber = 4 THEN 'odd' ELSE 'Open' END AS violationstatus, CAST(l_shipdate AS DATE) AS inspectiondate, CASE WHEN l_linenumber > 3 THEN CAST(l_shipdate AS DATE) END AS novissueddate FROM {lineitem}""",
    "dob_violations": f"""SELECT o_orderkey AS isndobbisviol, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE {_TEN} END AS bbl, CAST(1 + o_orderkey % 5 AS VARCHAR(5)) AS boro,
 CASE WHEN o_orderkey % 7 = 0 THEN '99999' WHEN o_orderkey % 7 > 1 THEN CAST(o_custkey AS VARCHAR(20)) END AS block, CASE WHEN o_orderkey % 7 = 0 THEN '99999' ELSE CAST(o_orderkey % 100 AS VARCHAR(20)) END AS lot,
 CASE WHEN o_orderstatus = 'F' THEN 'VH*-VIOLATION HAZARDOUS DISMISSED' WHEN o_orderstatus = 'O' THEN 'V-DOB violation - Resolved' WHEN o_orderkey % 2 = 0 THEN 'VW-VIOLATION WORK W/O PERMIT ACTIVE' ELSE 'V%-DOB VIOLATION' END AS violationcategory,
 concat('LL - local-law ', o_orderpriority) AS violationtype, 'LL' AS violationtypecode, CASE WHEN o_orderkey % 3 > 0 THEN {_DAY} END AS issuedate, CASE WHEN o_orderkey % 4 > 0 THEN {_DAY} END AS dispositiondate FROM {{orders}}""",
    "ecb_violations": f"""SELECT CAST(o_orderkey AS VARCHAR(20)) AS ecbviolationnumber, {_TEN} AS bbl, {_PARTS}, CASE o_orderstatus WHEN 'F' THEN 'ACTIVE' WHEN 'O' THEN 'RESOLVE' ELSE 'odd' END AS ecbviolationstatus, 'CLASS - 1' AS severity,
 CASE WHEN o_orderkey % 3 > 0 THEN {_DAY} END AS issuedate, CASE WHEN o_orderkey % 4 > 0 THEN {_DAY} END AS serveddate, CASE WHEN o_orderkey % 5 > 0 THEN {_DAY} END AS hearingdate, CASE WHEN o_orderkey % 3 = 0 THEN 'DEFAULT' WHEN o_orderkey % 3 = 1 THEN 'DISMISSED' ELSE 'PENDING' END AS hearingstatus,
 o_totalprice AS penalityimposed, 0.0 AS amountpaid, o_totalprice AS balancedue, CASE WHEN o_orderkey % 2 = 0 THEN 'A1' END AS infractioncode1, 'first  law' AS sectionlawdescription1, CASE WHEN o_orderkey % 3 = 0 THEN 'B2' END AS infractioncode2, concat('law of ', o_orderpriority) AS sectionlawdescription2 FROM {{orders}}""",
    "hpd_litigations": f"""SELECT o_orderkey AS litigationid, CASE WHEN o_orderkey % 4 = 0 THEN '0' ELSE {_TEN} END AS bbl, {_PARTS}, CASE o_orderstatus WHEN 'F' THEN 'CLOSED' WHEN 'O' THEN 'PENDING' ELSE 'odd' END AS casestatus, o_orderpriority AS casetype,
 CASE WHEN o_orderkey % 3 > 0 THEN {_DAY} END AS caseopendate, {_DAY} AS findingdate, CASE WHEN o_orderkey % 2 = 0 THEN 'YES' END AS openjudgement, CASE WHEN o_orderkey % 3 = 0 THEN 'After Trial' END AS findingofharassment FROM {{orders}}""",
    "hpd_complaints": f"""SELECT o_orderkey AS problemid, o_custkey AS complaintid, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE {_TEN} END AS bbl, CASE WHEN o_orderkey % 5 = 0 THEN 'BROOKLYN' WHEN o_orderkey % 5 = 1 THEN 'Staten Island' ELSE 'odd' END AS borough,
 CAST(o_custkey AS INT) AS block, CAST(o_orderkey % 100 AS INT) AS lot, o_orderpriority AS type, {_DAY} AS receiveddate, o_orderstatus AS problemstatus, o_orderstatus AS complaintstatus, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 = 1 END AS complaintanonymousflag FROM {{orders}}""",
    "hpd_vacateorders": f"""SELECT o_orderkey AS vacateordernumber, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE {_TEN} END AS bbl, o_orderpriority AS primaryvacatereason, {_DAY} AS vacateeffectivedate, CASE WHEN o_orderstatus = 'F' THEN {_DAY} END AS rescinddate, 'Full' AS vacatetype, CAST(o_orderkey % 9 AS INT) AS numberofvacatedunits, o_custkey AS registrationid FROM {{orders}}""",
    "marshal_evictions": f"""SELECT CAST(o_custkey AS VARCHAR(20)) AS courtindexnumber, CAST(o_orderkey AS VARCHAR(20)) AS docketnumber, {_TEN} AS bbl, CASE WHEN o_orderkey % 3 = 0 THEN 'r ' WHEN o_orderkey % 3 = 1 THEN 'C' ELSE 'odd' END AS residentialcommercialind, o_orderpriority AS evictionlegalpossession, {_DAY} AS executeddate FROM {{orders}}""",
    "pluto": """SELECT CASE WHEN c_custkey % 50 = 0 THEN ' ' ELSE concat(CAST(1000000000 * (1 + c_custkey % 6) + c_custkey AS VARCHAR(20)), ' ') END AS bbl, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name END AS address, CAST(CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 1900 + c_custkey % 100 END AS INT) AS yearbuilt, CAST(c_custkey % 40 AS INT) AS unitsres,
 CASE WHEN c_custkey % 5 = 0 THEN 0.0 ELSE 40.0 + c_custkey % 7 END AS latitude, 0.0 AS longitude, c_name AS ownername, CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE 'P' END AS ownertype, c_mktsegment AS zonedist1, CAST(NULL AS VARCHAR(9)) AS landmark, '' AS histdist, c_custkey AS assessland, c_custkey * 2 AS assesstot, c_custkey * 3 AS exempttot FROM {customer}""",
    "hpd_registrations": f"""SELECT o_orderkey AS registrationid, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE concat(CAST(1000000000 * (1 + o_custkey % 6) + o_custkey + o_orderkey % 2 * 500000 AS VARCHAR(20)), ' ') END AS bbl, {_DAY} AS registrationenddate FROM {{orders}}""",
    "rentstab": """SELECT CASE WHEN c_custkey % 11 = 0 THEN '12' ELSE CAST(1000000000 * (1 + c_custkey % 6) + c_custkey AS VARCHAR(20)) END AS ucbbl, CAST(CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 20 END AS INT) AS uc2018, 1 AS uc2019, 2 AS uc2020, 3 AS uc2021, 4 AS uc2022, CAST(c_custkey % 13 AS INT) AS uc2023 FROM {customer}""",
    "master": f"""SELECT CAST(o_custkey AS VARCHAR(20)) AS documentid, CAST(o_orderkey AS VARCHAR(20)) AS crfn, CASE WHEN o_orderstatus = 'F' THEN 'Mdeed' WHEN o_orderstatus = 'O' THEN 'MTGE' WHEN o_orderkey % 2 = 0 THEN 'ASST' ELSE 'SAT' END AS doctype, CASE WHEN o_orderkey % 3 > 0 THEN {_DAY} END AS docdate, {_DAY} AS recordedfiled,
 o_orderkey * 100 AS docamount, 100.0 AS pcttransferred, CAST(o_orderkey % 3 AS INT) AS reelyear, CASE WHEN o_orderkey % 50 > 0 THEN {_DAY} END AS modifieddate FROM {{orders}}""",
    "legals": """SELECT CAST(c_custkey AS VARCHAR(20)) AS documentid, CAST(1000000000 + c_custkey AS VARCHAR(20)) AS bbl FROM {customer} UNION ALL SELECT CAST(c_custkey AS VARCHAR(20)), concat(CAST(1000000001 + c_custkey AS VARCHAR(20)), ' ') FROM {customer}""",
    "parties": """SELECT CAST(o_custkey AS VARCHAR(20)) AS documentid, CAST(1 + o_orderkey % 3 AS INT) AS partytype, CASE WHEN o_orderkey % 10 = 0 THEN ' ' ELSE concat(CASE WHEN o_orderkey % 7 < 3 THEN 'Party ' ELSE 'Owner ' END, CAST(o_orderkey % 7 AS VARCHAR(9))) END AS name, CASE WHEN o_custkey % 2 = 0 THEN '1 A St' END AS address1, '' AS address2, 'NY' AS city, 'NY' AS state, o_orderstatus AS zip FROM {orders}""",
    # chr(123) and chr(125) are braces
    "wow_bldgs": """SELECT CAST(1000000000 + p_partkey AS VARCHAR(20)) AS bbl, concat('[', chr(123), '"title": "Agent", "value": "', CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE concat(' ', p_name) END, '", "address": ', chr(123), '"housenumber": "', CAST(p_size % 9 AS VARCHAR(9)), '", "streetname": "', p_type, ' st"', chr(125), chr(125), ', ', chr(123), '"title": "HeadOfficer", "value": "', p_brand, '", "address": null', chr(125), ']') AS allcontacts FROM {part}""",
    "wow_landlords": """SELECT CAST(1000000000 + p_partkey AS VARCHAR(20)) AS bbl, p_partkey AS registrationid, p_brand AS name, p_type AS bizaddr, concat(CAST(p_size AS VARCHAR(9)), ' ', p_type) AS bizhousestreet, '' AS bizapt, CAST(p_size % 7 AS VARCHAR(9)) AS bizzip FROM {part}""",
}


def shaped(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of :data:`SOURCES` over the star schema's files in ``sf_dir``."""
    text = SOURCES[name]
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", text))})


def sql(*names: str) -> str:
    """The same tables as the beginning of a DuckDB query."""
    return "WITH " + ",\n".join(f"{n} AS ({re.sub(r'[{}]', '', SOURCES[n])})" for n in names)
