"""Rule evaluations over the whole population: one row a subject, verdict columns beside the facts.

A single subject is a filter on the result; it reaches the scans where the tables hold the key itself.
Every branch is aggregated by its key before it is joined, so no join multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelgraph.functions.text import looks_corporate, name_tokens
from parcelgraph.operators import ranks


def _as_of(as_of: str) -> Column:
    return F.lit(as_of).cast("date")


def open_class_c(violations: DataFrame) -> DataFrame:
    return violations.where("violation_class = 'C' and status = 'Open' and open_date is not null")


def persistent_hazard(violations: DataFrame, as_of: str, least: int = 3, days: int = 180) -> DataFrame:
    """Buildings with at least ``least`` open class C violations, the oldest over ``days`` old."""
    by = open_class_c(violations).groupBy("bbl").agg(F.count("*").alias("open_c"), F.min("open_date").alias("oldest"))
    return by.where((F.col("open_c") >= least) & (F.datediff(_as_of(as_of), "oldest") > days))


def hazard_by_borough(hazards: DataFrame, buildings: DataFrame, top: int = 15) -> DataFrame:
    """Per borough: buildings, units and the ids of the ``top`` largest by units."""
    rows = hazards.select("bbl").join(buildings, "bbl")
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("units")).alias("u"), "bbl"))), 1, top)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("borough").orderBy(F.desc("units"), "bbl")))
    largest = ranked.where(F.col("rank") <= top).groupBy("borough").agg(F.array_join(F.transform(best, lambda s: s["bbl"]), ",").alias("largest"))
    return rows.groupBy("borough").agg(F.count("*").alias("n_buildings"), F.sum("units").alias("n_units")).join(largest, "borough")


def deterioration(violations: DataFrame, as_of: str, years: int = 5, settled_days: int = 180) -> DataFrame:
    """Whether more is issued and less is resolved: the last two available years against the first
    two of the ``years`` before the current one."""
    year, now = F.year("open_date"), int(as_of[:4])
    rows = violations.where("violation_class = 'C' and open_date is not null").withColumn("year", year).where(F.col("year").between(now - years + 1, now))
    settled = F.datediff(_as_of(as_of), "open_date") > settled_days
    yearly = rows.groupBy("bbl", "year").agg(F.count("*").alias("issued"), F.count_if(settled).alias("eligible"), F.count_if(settled & (F.col("status") == "Closed")).alias("resolved"))
    yearly = yearly.withColumn("rate", F.when(F.col("eligible") > 0, F.col("resolved") / F.col("eligible")))
    up, down = Window.partitionBy("bbl").orderBy("year"), Window.partitionBy("bbl").orderBy(F.desc("year"))
    ranked = yearly.withColumn("first", F.row_number().over(up) <= 2).withColumn("last", F.row_number().over(down) <= 2)
    out = ranked.groupBy("bbl").agg(
        F.count("*").alias("n_years"),
        F.sum("issued").alias("issued"),
        F.avg(F.when(F.col("last"), F.col("issued"))).alias("late"),
        F.avg(F.when(F.col("first"), F.col("issued"))).alias("early"),
        F.avg(F.when(F.col("last"), F.col("rate"))).alias("late_rate"),
        F.avg(F.when(F.col("first"), F.col("rate"))).alias("early_rate"),
    )
    rising, falling = F.col("late") > F.col("early"), F.col("late_rate") < F.col("early_rate") - 1e-12
    return out.select("bbl", "n_years", "issued", (F.col("n_years") < 3).alias("insufficient"), F.when(F.col("n_years") >= 3, rising & F.coalesce(falling, F.lit(False))).alias("deteriorating"))


def fine_evasion(judgments: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """Unpaid balances above ``limit`` (cents); buildings whose balances are all unknown have no row."""
    known = judgments.where("balance is not null")
    owed = F.sum(F.when(F.col("balance") > 0, F.col("balance")))
    return known.groupBy("bbl").agg(F.count("*").alias("n"), F.count_if(F.col("balance") > 0).alias("n_owed"), F.coalesce(owed, F.lit(0)).alias("owed"), F.sum("penalty").alias("penalty"), F.sum("paid").alias("paid")).withColumn("flagged", F.col("owed") > limit)


def enforcement_gap(violations: DataFrame, filings: DataFrame, as_of: str, least: int = 3, days: int = 365) -> DataFrame:
    """Stale open class C violations and the court filings since the earliest of them."""
    stale = open_class_c(violations).where(F.datediff(_as_of(as_of), "open_date") > days).groupBy("bbl").agg(F.count("*").alias("stale"), F.min("open_date").alias("earliest"))
    since = stale.join(filings.where("event_date is not null").select("bbl", "event_date"), "bbl").where("event_date >= earliest").groupBy("bbl").agg(F.count("*").alias("filings"))
    return stale.join(since, "bbl", "left").select("bbl", "stale", "earliest", F.coalesce("filings", F.lit(0)).alias("filings")).withColumn("gap", (F.col("stale") >= least) & (F.col("filings") == 0))


def due_diligence(buildings: DataFrame, violations: DataFrame, filings: DataFrame, judgments: DataFrame, hazards: DataFrame, control: DataFrame) -> DataFrame:
    """One row a building: counts of every branch, each aggregated before it is joined."""
    is_open = F.col("status") == "Open"
    v = violations.groupBy("bbl").agg(*(F.count_if(is_open & (F.col("violation_class") == c)).alias(f"open_{c.lower()}") for c in "ABC"), F.count("*").alias("n_violations"))
    f = filings.groupBy("bbl").agg(F.count("*").alias("n_filings"))
    j = judgments.where("balance > 0").groupBy("bbl").agg(F.sum("balance").alias("owed"))
    h = hazards.select("bbl", F.lit(True).alias("has_hazard"))
    c = control.groupBy("bbl").agg(F.array_join(F.sort_array(F.collect_set("actor_id")), ",").alias("controllers"))
    out = buildings.select("bbl", "borough")
    for branch in (v, f, j, h, c):
        out = out.join(branch, "bbl", "left")
    zero = ["open_a", "open_b", "open_c", "n_violations", "n_filings", "owed"]
    return out.fillna(0, zero).fillna(False, ["has_hazard"]).fillna("", ["controllers"])


def latest_per_key(rows: DataFrame, key: str, *by: str) -> DataFrame:
    """The row of each key that is greatest by the columns ``by`` (nulls least)."""
    rest = [c for c in rows.columns if c != key and c not in by]
    return rows.groupBy(key).agg(F.max(F.struct(*by, *rest)).alias("last")).select(key, "last.*")


def ownership_change(violations: DataFrame, deeds: DataFrame, as_of: str) -> DataFrame:
    """Rates of class C violations before and after the latest deed with an amount."""
    deed = latest_per_key(deeds.where("amount > 0 and event_date is not null").select("bbl", "event_date", "event_id"), "bbl", "event_date", "event_id").withColumnRenamed("event_date", "deed_date").withColumnRenamed("event_id", "deed_id")
    c = violations.where("violation_class = 'C' and open_date is not null").select("bbl", "open_date", "status")
    facts = deed.join(c, "bbl", "left").groupBy("bbl", "deed_date", "deed_id").agg(F.count_if(F.col("open_date") < F.col("deed_date")).alias("before"), F.count_if(F.col("open_date") >= F.col("deed_date")).alias("after"), F.count_if((F.col("open_date") >= F.col("deed_date")) & (F.col("status") == "Open")).alias("open_after"), F.min("open_date").alias("earliest"))
    days_before = F.greatest(F.datediff("deed_date", F.coalesce("earliest", "deed_date")), F.lit(0))
    facts = facts.withColumn("days_before", days_before).withColumn("days_after", F.datediff(_as_of(as_of), "deed_date"))
    # rates a year, kept as exact integer comparisons: after / days_after >= 1.5 * before / days_before
    more = F.col("after") * F.col("days_before") * 2 >= F.col("before") * F.col("days_after") * 3
    signal = F.when(F.col("before") == 0, F.col("after") > 0).otherwise((F.col("days_before") > 0) & (F.col("days_after") > 0) & (F.col("after") > 0) & more)
    short = ((F.col("days_before") < 365) & (F.col("before") == 0)) | (F.col("days_after") < 180)
    return facts.select("bbl", "deed_id", "deed_date", "before", "after", "open_after", "days_before", "days_after", signal.alias("signal"), short.alias("insufficient"))


def nearest_mortgage(deeds: DataFrame, mortgages: DataFrame, before: int = 14, after: int = 60) -> DataFrame:
    """The mortgage nearest in time to the latest deed of a building, within a window of days.

    An equi-join on the building with the window as residual condition; ties go to the smaller id.
    """
    deed = latest_per_key(deeds.where("event_date is not null").select("bbl", "event_date", "event_id"), "bbl", "event_date", "event_id").select("bbl", F.col("event_date").alias("deed_date"), F.col("event_id").alias("deed_id"))
    gap = F.datediff("event_date", "deed_date")
    near = deed.join(mortgages.select("bbl", "event_date", "event_id"), "bbl").where(gap.between(-before, after))
    return near.groupBy("bbl", "deed_id").agg(F.min_by(F.struct("event_id", gap.alias("gap")), F.struct(F.abs(gap), "event_id")).alias("m")).select("bbl", "deed_id", F.col("m.event_id").alias("mortgage_id"), F.col("m.gap").alias("gap_days"))


def mortgage_concealment(subjects: DataFrame, buildings: DataFrame, deeds: DataFrame, mortgages: DataFrame, before: int = 14, after: int = 60) -> DataFrame:
    """One row a subject (bbl): the latest deed with a grantee (deeds: grantee_names), the mortgage
    nearest to it (mortgages: mortgagor_names), whether their parties share a name token, the verdict,
    and the first reason why there is none."""
    parties = deeds.where("event_date is not null and grantee_names is not null")
    deed = latest_per_key(parties.select("bbl", "event_date", "event_id", "grantee_names"), "bbl", "event_date", "event_id").select("bbl", F.col("event_date").alias("deed_date"), F.col("event_id").alias("deed_id"), "grantee_names")
    named = mortgages.where("event_date is not null and mortgagor_names is not null").select("bbl", "event_date", "event_id", "mortgagor_names")
    near = nearest_mortgage(parties, named, before, after).select("bbl", "mortgage_id", "gap_days")
    loans = named.groupBy("bbl", F.col("event_id").alias("mortgage_id")).agg(F.min(F.struct("event_date", "mortgagor_names")).alias("m")).select("bbl", "mortgage_id", "m.mortgagor_names")
    known = buildings.select("bbl", F.lit(True).alias("known")).distinct()
    facts = subjects.select("bbl").distinct().join(known, "bbl", "left").join(deed, "bbl", "left").join(near.join(loans, ["bbl", "mortgage_id"]), "bbl", "left")
    a, b = name_tokens(F.col("grantee_names")), name_tokens(F.col("mortgagor_names"))
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = F.when(F.col("known").isNull(), "building_not_resolved").when(none("grantee_names"), "no_deed_transfer").when(none("mortgagor_names"), "no_contemporaneous_mortgage").when((F.size(a) == 0) | (F.size(b) == 0), "unparseable_names")
    out = facts.withColumn("reason", reason).withColumn("token_overlap", F.when(reason.isNull(), F.arrays_overlap(a, b)))
    return out.select("bbl", "deed_id", "deed_date", "grantee_names", "mortgage_id", "gap_days", "mortgagor_names", "token_overlap", (~F.col("token_overlap")).alias("flagged"), F.col("reason").isNotNull().alias("insufficient"), "reason")


def name_discrepancy(pairs: DataFrame) -> DataFrame:
    """id, corporate, overlap, discrepancy of rows (id, dof_name, controller)."""
    a, b = name_tokens(F.col("dof_name")), name_tokens(F.col("controller"))
    reason = F.when(F.coalesce(F.trim("dof_name"), F.lit("")) == "", "no owner name").when(F.coalesce(F.trim("controller"), F.lit("")) == "", "no controller").when(looks_corporate(F.col("dof_name")), "corporate")
    return pairs.select("id", F.size(F.array_intersect(a, b)).alias("overlap"), reason.alias("insufficient")).withColumn("discrepancy", F.when(F.col("insufficient").isNull(), F.col("overlap") == 0))


def rent_stabilization(units: DataFrame) -> DataFrame:
    """units: bbl, first, last. Deregulating is false, not null, where a count is missing."""
    change = F.col("last") - F.col("first")
    lost = F.when(change < 0, -change)
    return units.select("bbl", change.alias("change"), F.coalesce(change < 0, F.lit(False)).alias("deregulating"), lost.alias("units_lost"), F.when(F.col("first") > 0, F.floor(lost * 1000 / F.col("first"))).alias("lost_per_mille"))


def vacate_history(orders: DataFrame) -> DataFrame:
    """orders: bbl, order_id, effective, rescinded. Ordered list, counts and flags."""
    active = F.col("rescinded").isNull()
    listed = F.transform(F.sort_array(F.collect_list(F.struct("effective", "order_id")), asc=False), lambda s: s["order_id"])
    out = orders.groupBy("bbl").agg(F.count("*").alias("n"), F.count_if(active).alias("n_active"), F.array_join(listed, ",").alias("orders"))
    return out.withColumn("vacated", F.col("n") >= 1).withColumn("active", F.col("n_active") >= 1).withColumn("recurring", F.col("n") >= 2)


def portfolio_condition(control: DataFrame, hazards: DataFrame) -> DataFrame:
    """Per actor: portfolio size, hazardous buildings, whether at least half are."""
    held = control.distinct().join(hazards.select("bbl", F.lit(1).alias("h")), "bbl", "left")
    out = held.groupBy("actor_id").agg(F.count("*").alias("size"), F.count("h").alias("hazards"))
    return out.withColumn("high", F.col("hazards") * 2 >= F.col("size"))


def worst_first(control: DataFrame, hazards: DataFrame, buildings: DataFrame, least: int = 5, top: int = 20) -> DataFrame:
    """The ``top`` actors by hazardous buildings, then by their share."""
    held = control.distinct().join(buildings.select("bbl", "units"), "bbl").join(hazards.select("bbl", F.lit(1).alias("h")), "bbl", "left")
    out = held.groupBy("actor_id").agg(F.count("*").alias("size"), F.count("h").alias("hazards"), F.sum("units").alias("units")).where((F.col("size") >= least) & (F.col("hazards") > 0))
    return out.orderBy(F.desc("hazards"), F.desc(F.col("hazards") / F.col("size")), "actor_id").limit(top)


def recidivism(control: DataFrame, hazards: DataFrame, violations: DataFrame, buildings: DataFrame, as_of: str, years: int = 3) -> DataFrame:
    """Hazards in several boroughs, or buildings with class C violations open for years."""
    opened = open_class_c(violations).groupBy("bbl").agg(F.count("*").alias("open_c"), F.min(F.year("open_date")).alias("since"))
    held = control.distinct().join(buildings.select("bbl", "borough"), "bbl").join(hazards.select("bbl", F.lit(1).alias("h")), "bbl", "left").join(opened, "bbl", "left")
    out = held.groupBy("actor_id").agg(F.count_distinct(F.when(F.col("h") == 1, F.col("borough"))).alias("boroughs"), F.count_if(F.lit(int(as_of[:4])) - F.col("since") >= years).alias("old_buildings"))
    return out.withColumn("recidivist", (F.col("boroughs") > 1) | (F.col("old_buildings") > 0))


def group_exposure(control: DataFrame, hazards: DataFrame, buildings: DataFrame, groups: DataFrame) -> DataFrame:
    """Per actor the condition of its network: itself and its affiliates, all actors of the network.

    groups: actor_id, network. A network is summed up once, instead of once for each of its actors.
    """
    own = control.distinct().join(buildings.select("bbl", "units"), "bbl").join(hazards.select("bbl", F.lit(1).alias("h")), "bbl", "left").groupBy("actor_id").agg(F.count("*").alias("size"), F.count("h").alias("hazards"), F.sum("units").alias("units"))
    sums = own.join(groups, "actor_id").groupBy("network").agg(F.count("*").alias("members"), *(F.sum(c).alias(c) for c in ("size", "hazards", "units")))
    return groups.join(sums, "network").select(F.col("actor_id").alias("root"), "members", "size", "hazards", "units").withColumn("insufficient", F.col("members") < 2)


def confidence(edges: Column, weight: Column, bridge: Column, reason: Column) -> Column:
    """How sure a community is, from its edges, their mean weight and how it was split."""
    return (
        F.when(reason == "no_meaningful_split", "Low")
        .when((edges > 10) & (weight > 2.5) & ~bridge, "High")
        .when((edges < 3) | (weight < 1.5), "Low")
        .otherwise("Medium")
    )


def meets_claim_threshold(n_bbls: Column, address_edges: Column, name_edges: Column, sure: Column) -> Column:
    return (sure != "Low") & (n_bbls >= 2) & ((address_edges >= 1) | (name_edges >= 2))


def concealment_flag(address_edges: Column, name_edges: Column) -> Column:
    """Tied by addresses far more than by names."""
    return F.when(name_edges == 0, address_edges >= 2).otherwise(address_edges > 10 * name_edges)


def management_quartiles(control: DataFrame, violations: DataFrame, buildings: DataFrame, least: int = 10) -> DataFrame:
    """Quartile of each portfolio of ``least`` buildings or more by open class C per unit."""
    opened = open_class_c(violations).groupBy("bbl").agg(F.count("*").alias("open_c"))
    held = control.distinct().join(buildings.select("bbl", "units"), "bbl").join(opened, "bbl", "left")
    by = held.groupBy("actor_id").agg(F.count("*").alias("size"), F.sum("units").alias("units"), F.coalesce(F.sum("open_c"), F.lit(0)).alias("open_c")).where(F.col("size") >= least)
    return ranks.ntile(by, [F.col("open_c") / F.col("units"), F.col("actor_id")], 4, "quartile")


def resolve_actor(actors: DataFrame, part: str, most: int = 5) -> DataFrame:
    """The actors (actor_id, name) whose name holds ``part``, whatever its case: a list of ``most``
    for a user to choose from, the shortest names first."""
    found = actors.where(F.contains(F.lower("name"), F.lit(part.lower())))
    return found.orderBy(F.length("name"), "name", "actor_id").limit(most)
