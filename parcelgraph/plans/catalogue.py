"""Rules and intents as tables, and the way from an intent and a subject to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelgraph.plans import verdicts

#: Ids and names of the rules.
RULES = [(r.rule_id, r.name) for r in verdicts.RULES]

# Intent ids, names and applicable rules; then this engine's query and its subject.
INTENTS = [
    ("INT-00001", "DeteriorationTrajectory", "RUL-00007", "deterioration", "bbl"),
    ("INT-00002", "PortfolioIdentification", "RUL-00002", "portfolio_identification", "bbl"),
    ("INT-00003", "PortfolioCondition", "RUL-00001", "portfolio_condition", "actor_id"),
    ("INT-00004", "Recidivism", "RUL-00013", "recidivism", "actor_id"),
    ("INT-00005", "WorstFirst", "", "worst_first", None),
    ("INT-00006", "ConcealmentDetection", "RUL-00003|RUL-00004", "concealment", "community"),
    ("INT-00007", "GeographicConcentration", "", "phc_by_borough", "borough"),
    ("INT-00008", "OwnershipChange", "RUL-00014", "ownership_change", "bbl"),
    ("INT-00009", "BuildingDueDiligence", "", "due_diligence", "bbl"),
    ("INT-00010", "RentStabilization", "RUL-00010", "rent_stabilization", "bbl"),
    ("INT-00011", "FineEvasion", "RUL-00011", "fine_evasion", "bbl"),
    ("INT-00012", "EnforcementAccountability", "RUL-00012", "enforcement_gap", "bbl"),
    ("INT-00013", "NetworkExposure", "RUL-00008", "network_exposure", "root"),
    ("INT-00014", "VacateHistory", "RUL-00015", "vacate_history", "bbl"),
    ("INT-00015", "OwnershipNameDiscrepancy", "RUL-00016", "name_discrepancy", "id"),
    ("INT-00016", "MortgageBasedConcealment", "RUL-00017", "mortgage_verdict", "bbl"),
]


def rules(spark: SparkSession) -> DataFrame:
    """The rules with their thresholds, conditions and texts: see :mod:`verdicts`."""
    return verdicts.rule_table(spark)


def intents(spark: SparkSession) -> DataFrame:
    """intent_id, name, applicable_rules (joined by bars), rules (the same as a list)."""
    table = spark.createDataFrame([r[:3] for r in INTENTS], "intent_id string, name string, applicable_rules string")
    return table.withColumn("rules", F.filter(F.split("applicable_rules", r"\|"), lambda r: r != ""))


def investigate(spark: SparkSession, sf_dir: str, intent: str, subject=None) -> DataFrame:
    """The rows that answer an intent, for one subject or, without one, for all.

    The subject is a filter on the population's plan. ``General`` and unknown intents have no query.
    """
    from parcelgraph.plans import graph_registry, portfolio_registry, registry, source_registry, verdict_registry  # noqa: F401  (they register queries)

    found = next((i for i in INTENTS if i[1] == intent), None)
    if found is None:
        raise LookupError(f"no query answers {intent!r}")
    out = registry.QUERIES[found[3]](spark, sf_dir)
    return out if subject is None or found[4] is None else out.where(F.col(found[4]) == subject)
