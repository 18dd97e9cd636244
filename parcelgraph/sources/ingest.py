"""Source records to buildings and events, in two profiles.

``discovery`` keeps the sources' own words; ``evidentiary`` maps them to the vocabularies, promotes
extra columns, and drops records without a usable date where the source demands it. Each function
takes the source's DataFrame and returns a projection; what can be filtered at the scan is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelgraph.functions import keys, text

DISCOVERY, EVIDENTIARY = "discovery", "evidentiary"
_C = F.col


def _blob(df: DataFrame, *columns: str) -> Column:
    """The record's columns as a JSON text, nulls included."""
    return F.to_json(F.struct(*[c for c in columns if c in df.columns]), {"ignoreNullFields": "false"})


def _event(df: DataFrame, kind: str, source: str, event_id: Column, bbl: Column, date: Column, status: Column, violation_class: Column, record_id: Column, **extras: Column) -> DataFrame:
    out = {
        "event_id": event_id,
        "event_type": F.lit(kind),
        "source_name": F.lit(source),
        "bbl": bbl,
        "event_date": date.cast("date"),
        "status": status,
        "violation_class": violation_class,
        "source_record_id": record_id.cast("string"),
        "raw_record": _blob(df, *df.columns),
        **extras,
    }
    return df.select(*(c.alias(name) for name, c in out.items()))


def substrate(pluto: DataFrame, registrations: DataFrame) -> DataFrame:
    """Buildings: the tax lots, then registered keys that no lot has."""
    lots = pluto.where(F.trim("bbl") != "").select(
        F.trim("bbl").alias("bbl"),
        F.coalesce(keys.blank_to_null(_C("address")), F.lit("Unknown")).alias("address"),
        F.nullif(_C("yearbuilt"), F.lit(0)).alias("year_built"),
        _C("unitsres").alias("units"),
        "latitude",
        "longitude",
    )
    more = registrations.select(F.trim("bbl").alias("bbl")).where("bbl != ''").distinct().join(lots.select("bbl"), "bbl", "left_anti")
    every = lots.unionByName(more, allowMissingColumns=True)
    return every.withColumn("borough", keys.borough_of(_C("bbl")))


def rent_stabilised(rentstab: DataFrame, pluto: DataFrame) -> DataFrame:
    """Yearly counts with their change; a coordinate of 0 is none here."""
    lots = pluto.select("bbl", "address", "latitude", "longitude")
    out = rentstab.withColumn("bbl", F.trim("ucbbl")).where("length(bbl) = 10").join(lots, "bbl", "left")
    change = _C("uc2023") - _C("uc2018")
    return out.select("bbl", F.coalesce("address", F.lit("")).alias("address"), F.nullif(_C("latitude"), F.lit(0.0)).alias("latitude"), F.nullif(_C("longitude"), F.lit(0.0)).alias("longitude"), *(_C(f"uc{y}").alias(f"rs_units_{y}") for y in range(2018, 2024)), change.alias("rs_change"), F.coalesce(change < 0, F.lit(False)).alias("rs_deregulating"))


def dof_ownership(pluto: DataFrame) -> DataFrame:
    named = ["ownername", "ownertype", "zonedist1", "landmark", "histdist"]
    return pluto.where(F.trim("bbl") != "").select(F.trim("bbl").alias("bbl"), *(keys.blank_to_null(_C(c)).alias(c) for c in named), "assessland", "assesstot", "exempttot")


def hpd_violations(df: DataFrame, profile: str) -> DataFrame:
    parts = [_C("boroid"), _C("block"), _C("lot")]
    event_id = keys.event_id("HPD", _C("violationid"))
    if profile == DISCOVERY:
        return _event(df, "Violation", "HPD", event_id, keys.normalize_key_blank_only(_C("bbl"), *parts), _C("inspectiondate"), _C("violationstatus"), F.trim("class"), _C("violationid"))
    kept = df.where("bbl is not null")
    grade = F.when(F.trim("class").isin("A", "B", "C", "I"), F.trim("class"))
    return _event(kept, "Violation", "HPD", event_id, keys.normalize_key(_C("bbl"), *parts), F.coalesce("novissueddate", "inspectiondate"), text.mapped(_C("violationstatus"), text.HPD_STATUS, "Unknown"), grade, _C("violationid"), open_date=_C("novissueddate").cast("date"), inspection_date=_C("inspectiondate").cast("date"))


def dob_violations(df: DataFrame, profile: str) -> DataFrame:
    event_id, record = keys.event_id("DOB", _C("isndobbisviol")), _C("isndobbisviol")
    if profile == DISCOVERY:
        return _event(df, "Violation", "DOB", event_id, F.trim("bbl"), _C("issuedate"), text.status_by_keyword(_C("violationcategory"), text.DOB_KEYWORDS), _C("violationtypecode"), record)
    # three-valued: a record without block or lot is dropped with the dummies
    kept = df.where("not (block = '99999' and lot = '99999')").where(F.coalesce("issuedate", "dispositiondate").isNotNull())
    dated = F.coalesce("issuedate", "dispositiondate")
    category = F.upper("violationcategory")
    status = F.coalesce(F.when(category.contains("DISMISSED"), "Dismissed").when(category.contains("RESOLVED"), "Closed").when(category.contains("ACTIVE"), "Active"), F.lit("Unknown"))
    code = F.split("violationtype", "-", 2)
    return _event(kept, "Violation", "DOB", event_id, keys.normalize_key(_C("bbl"), _C("boro"), _C("block"), _C("lot")), dated, status, F.lit(None).cast("string"), record, violation_type_code=F.trim(F.get(code, F.lit(0))), violation_type=F.substring(F.trim(F.get(code, F.lit(1))), 1, 200), is_hazardous=F.coalesce(category.contains("HAZARDOUS"), F.lit(False)), is_work_without_permit=F.coalesce(category.rlike("WORK W"), F.lit(False)))


def ecb_violations(df: DataFrame, profile: str) -> DataFrame:
    event_id, record = keys.event_id("ECB", _C("ecbviolationnumber")), _C("ecbviolationnumber")
    pairs = [(_C(f"infractioncode{k}"), _C(f"sectionlawdescription{k}")) for k in range(1, 11) if f"infractioncode{k}" in df.columns]
    if profile == DISCOVERY:
        return _event(df, "Judgment", "ECB", event_id, F.trim("bbl"), _C("issuedate"), _C("ecbviolationstatus"), _C("severity"), record, infractions=text.code_pairs(pairs))
    dated = F.coalesce("issuedate", "serveddate", "hearingdate")
    return _event(df.where(dated.isNotNull()), "Judgment", "ECB", event_id, keys.normalize_key(_C("bbl"), _C("boro"), _C("block"), _C("lot")), dated, text.mapped(_C("ecbviolationstatus"), text.ECB_STATUS, "Unknown"), _C("severity"), record, penalty_imposed=_C("penalityimposed"), amount_paid=_C("amountpaid"), balance_due=_C("balancedue"), infraction_codes=text.code_text(pairs[:5]), interpretive_status=text.mapped(_C("hearingstatus"), text.HEARING_READING, "Observed"))


def litigations(df: DataFrame, profile: str) -> DataFrame:
    event_id, record = keys.event_id("HPD-LIT", _C("litigationid")), _C("litigationid")
    if profile == DISCOVERY:
        return _event(df, "CourtFiling", "HPD-Litigations", event_id, keys.normalize_key_valid(_C("bbl"), _C("boro"), _C("block"), _C("lot")), _C("caseopendate"), _C("casestatus"), _C("casetype"), record)
    kept = df.where("length(trim(bbl)) = 10")
    return _event(kept, "CourtFiling", "HPD-Litigations", event_id, F.trim("bbl"), F.coalesce("caseopendate", "findingdate"), text.mapped(_C("casestatus"), text.LITIGATION_STATUS, "Unknown"), F.lit(None).cast("string"), record, case_type=_C("casetype"), open_judgement=F.coalesce(_C("openjudgement") == "YES", F.lit(False)), is_harassment_finding=F.coalesce(_C("findingofharassment").isin("After Inquest", "After Trial"), F.lit(False)), interpretive_status=text.mapped(_C("findingofharassment"), text.FINDING_READING, "Inferred"))


def complaints(df: DataFrame, profile: str) -> DataFrame:
    digit = text.mapped(F.upper("borough"), {v.upper(): k for k, v in keys.BOROUGHS.items()})
    bbl = keys.normalize_key_valid(_C("bbl"), digit, _C("block"), _C("lot"))
    extras = {} if profile == DISCOVERY else {"complaint_id": _C("complaintid").cast("string"), "complaint_status": _C("complaintstatus"), "anonymous_flag": _C("complaintanonymousflag")}
    return _event(df, "Complaint", "HPD", keys.event_id("HPD-COMPLAINT", _C("problemid")), bbl, _C("receiveddate"), _C("problemstatus"), _C("type"), _C("problemid"), **extras)


def vacate_orders(df: DataFrame, profile: str) -> DataFrame:
    kept = df.where(_C("bbl").rlike(keys.VALID_KEY))
    status = F.when(_C("rescinddate").isNull(), "Active").otherwise("Rescinded")
    extras = {} if profile == DISCOVERY else {"rescind_date": _C("rescinddate").cast("date"), "vacate_type": _C("vacatetype"), "units_vacated": _C("numberofvacatedunits"), "registration_id": _C("registrationid")}
    return _event(kept, "VacateOrder", "HPD", keys.event_id("HPD-VACATE", _C("vacateordernumber")), _C("bbl"), _C("vacateeffectivedate"), status, _C("primaryvacatereason"), _C("vacateordernumber"), **extras)


def evictions(df: DataFrame, profile: str) -> DataFrame:
    given = F.trim("residentialcommercialind")
    kind = F.coalesce(text.mapped(F.upper(given), {"R": "RESIDENTIAL", "C": "COMMERCIAL"}), given)
    return _event(df, "Eviction", "Marshal", keys.event_id("MARSHAL", _C("courtindexnumber"), _C("docketnumber")), F.trim("bbl"), _C("executeddate"), _C("evictionlegalpossession"), kind, _C("docketnumber"))


def latest_master(master: DataFrame) -> DataFrame:
    """The last modified row of each document; an unknown modification date counts as the last."""
    from parcelgraph.operators.relational import latest

    return latest(master, ["documentid"], [F.desc_nulls_first("modifieddate"), F.desc("crfn")])


def deeds(master: DataFrame, legals: DataFrame, parties: DataFrame, profile: str) -> tuple[DataFrame, DataFrame]:
    """(events, has_event): per document in discovery, per document and lot otherwise."""
    found = latest_master(master.where(_C("doctype").ilike("%DEED%")))
    lots = legals.select("documentid", F.trim("bbl").alias("bbl")).distinct()
    if profile == DISCOVERY:
        events = _event(found, "DeedTransfer", "ACRIS", keys.event_id("ACRIS", _C("documentid")), F.lit(None).cast("string"), F.coalesce("docdate", "recordedfiled"), F.lit(None).cast("string"), _C("doctype"), _C("documentid"))
        return events, found.select("documentid").join(lots, "documentid").select("bbl", keys.event_id("ACRIS", _C("documentid")).alias("event_id"))
    side = lambda k, name: parties.where(_C("partytype") == k).groupBy("documentid").agg(F.array_join(F.array_sort(F.collect_list("name")), " | ").alias(name))
    full = found.join(lots, "documentid").join(side(1, "grantor_names"), "documentid", "left").join(side(2, "grantee_names"), "documentid", "left")
    events = _event(full, "DeedTransfer", "ACRIS", F.concat_ws("-", F.lit("DEED"), "documentid", "bbl"), _C("bbl"), _C("docdate"), F.lit("Recorded"), F.lit(None).cast("string"), _C("documentid"), doc_type=_C("doctype"), doc_amount=_C("docamount"), pct_transferred=_C("pcttransferred"), grantor_names=_C("grantor_names"), grantee_names=_C("grantee_names"))
    return events, events.select("bbl", "event_id")


def named_sides(parties: DataFrame) -> DataFrame:
    """(documentid, first_names, second_names): the names of a document's parties of type 1 and 2."""
    side = lambda k: F.nullif(F.array_join(F.array_sort(F.collect_list(F.when(_C("partytype") == k, _C("name")))), " | "), F.lit(""))
    return parties.groupBy("documentid").agg(side(1).alias("first_names"), side(2).alias("second_names"))


def mortgage_instruments(master: DataFrame, legals: DataFrame, profile: str, parties: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, has_event) of mortgages, assignments and satisfactions; with ``parties`` the names of
    mortgagors and mortgagees, or of assignors and assignees, too."""
    found = latest_master(master.where(_C("doctype").isin(*text.INSTRUMENT_EVENT)))
    event_id = keys.event_id("ACRIS", _C("documentid"))
    status = F.lit(None if profile == DISCOVERY else "Recorded").cast("string")
    events = _event(found, "Mortgage", "ACRIS", event_id, F.lit(None).cast("string"), F.coalesce("docdate", "recordedfiled"), status, _C("doctype"), _C("documentid"), crfn=_C("crfn"), reel_year=F.nullif(_C("reelyear"), F.lit(0)))
    events = events.withColumn("event_type", text.mapped(_C("violation_class"), text.INSTRUMENT_EVENT))
    if parties is not None:
        events = events.join(named_sides(parties).withColumnRenamed("documentid", "source_record_id"), "source_record_id", "left")
        assigned = _C("event_type") == "MortgageAssignment"
        names = {"mortgagor_names": (~assigned, "first_names"), "mortgagee_names": (~assigned, "second_names"), "assignor_names": (assigned, "first_names"), "assignee_names": (assigned, "second_names")}
        events = events.withColumns({k: F.when(when, _C(c)) for k, (when, c) in names.items()}).drop("first_names", "second_names")
    return events, found.select("documentid").join(legals.select("documentid", F.trim("bbl").alias("bbl")).distinct(), "documentid").select("bbl", event_id.alias("event_id"))


def parties_of(parties: DataFrame, documents: DataFrame) -> DataFrame:
    """(actor_id, name, address, event_id, role) of the documents' parties; one role each.

    documents: documentid, doctype. Of several roles in one document the last by party type stays.
    """
    fields = [_C(c) for c in ("name", "address1", "address2", "city", "state", "zip")]
    role = F.coalesce(text.mapped(F.concat("doctype", _C("partytype").cast("string")), text.INSTRUMENT_ROLE), F.when(_C("doctype").ilike("%DEED%"), text.mapped(_C("partytype").cast("string"), {"1": "Grantor", "2": "Grantee"})), F.lit("Other"))
    rows = parties.where(keys.blank_to_null(_C("name")).isNotNull()).join(documents.select("documentid", "doctype"), "documentid")
    rows = rows.select(text.party_id(*fields).alias("actor_id"), F.trim("name").alias("name"), text.joined_address(*fields[1:]).alias("address"), keys.event_id("ACRIS", _C("documentid")).alias("event_id"), "partytype", role.alias("role"))
    return rows.groupBy("actor_id", "event_id").agg(F.max_by("name", "partytype").alias("name"), F.max_by("address", "partytype").alias("address"), F.max_by("role", "partytype").alias("role"))


def registered_for(landlords: DataFrame, nodes: DataFrame, registrations: DataFrame) -> DataFrame:
    """(nodeid, bbl, registrationid, end_date): landlords by name and address, the latest end."""
    rows = landlords.select("name", "bizaddr", "bbl", "registrationid").join(nodes.select("nodeid", "name", "bizaddr"), ["name", "bizaddr"]).join(registrations.select("registrationid", F.col("registrationenddate").alias("end_date")), "registrationid", "left")
    return rows.groupBy("nodeid", "bbl").agg(F.max_by("registrationid", F.struct("end_date", "registrationid")).alias("registrationid"), F.max("end_date").alias("end_date"))


def managed_by(agents_found: DataFrame, buildings: DataFrame, source_id: str, at: str) -> tuple[DataFrame, DataFrame]:
    """(relationships, observations) of managing agents (:func:`agents`).

    relationships: one ManagedBy for each known building and agent, with the share of the agent's
    buildings that are known; observations: the agent's name as the source has it, with its address.
    """
    held = agents_found.select("agent_id", F.explode("bbls").alias("bbl")).join(buildings.select("bbl").distinct(), "bbl", "left_semi")
    key = F.concat(F.lit("REL-MB-"), F.sha1(F.concat_ws("|", "agent_id", "bbl").cast("binary")))
    relationships = held.select(key.alias("relationship_id"), F.lit("ManagedBy").alias("type"), "agent_id", "bbl", F.lit("Observed").alias("status"), F.lit(at).cast("date").alias("effective_from"))
    observed = agents_found.select(F.concat(F.lit("IOB-"), F.sha1(F.concat_ws("|", F.lit(source_id), "agent_id").cast("binary"))).alias("observation_id"), "agent_id", F.col("name").alias("raw_name"), F.left("address", F.lit(300)).alias("context"), F.lit(source_id).alias("source_id"), F.size("bbls").cast("long").alias("n_bbls"))
    return relationships, observed


def agents(buildings_json: DataFrame) -> DataFrame:
    """(agent_id, name, address, bbls) from ``allcontacts``: contacts with the title Agent.

    One agent is one normalised name at one normalised address; its shown name is the most frequent
    spelling, then the longest.
    """
    contact = "array<struct<title:string,value:string,address:struct<housenumber:string,streetname:string,apartment:string,city:string,state:string,zip:string>>>"
    rows = buildings_json.select("bbl", F.explode(F.from_json("allcontacts", contact)).alias("c")).where("c.title = 'Agent' and c.value is not null and c.address is not null")
    squeeze = lambda c: F.regexp_replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), r"\s+", " ")
    name = F.trim(squeeze(_C("c.value")), F.lit(","))
    address = F.trim(F.regexp_replace(F.concat_ws(" ", *(squeeze(_C(f"c.address.{p}")) for p in ("housenumber", "streetname", "apartment", "zip"))), r"\s+", " "))
    rows = rows.select("bbl", F.trim("c.value").alias("shown"), name.alias("name"), address.alias("address")).where("name != ''")
    counted = rows.groupBy("name", "address", "shown").agg(F.count("*").alias("n"))
    shown = counted.groupBy("name", "address").agg(F.max_by("shown", F.struct("n", F.length("shown"), "shown")).alias("shown"))
    held = rows.groupBy("name", "address").agg(F.sort_array(F.collect_set("bbl")).alias("bbls"))
    key = F.concat("name", F.lit("||"), "address")
    return held.join(shown, ["name", "address"]).select(F.concat(F.lit("MGT-"), text.uuid5(key)).alias("agent_id"), F.col("shown").alias("name"), "address", "bbls")
