"""Rules as rows: what is asked of the facts, with which thresholds, and what is said about it.

A rule is a row of data. Its condition, the reasons why it can't be judged (the first that holds
counts) and its texts are written over the columns of its facts, with ``:name`` for a threshold of
its own and, in texts, ``{column}`` for a fact. :func:`compile_rule` turns a row into columns, so a
changed threshold changes verdicts and no code. Facts are the plans of :mod:`rules` over the whole
population.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    subject: str
    facts: str
    condition: str
    statement: str
    text: str
    thresholds: dict[str, float] = field(default_factory=dict)
    reasons: tuple[tuple[str, str], ...] = ()
    version: str = "1.0"
    deprecated: bool = False

    def where(self, **thresholds: float) -> Rule:
        """The same rule with other thresholds."""
        return replace(self, thresholds={**self.thresholds, **thresholds})


#: The rules. Ids, names and thresholds are fixed values; money is in cents.
RULES = (
    Rule("RUL-00001", "PHC-001", "bbl", "open_hazards", "open_c >= :least and oldest_days > :days", "at least :least open class C violations, the oldest open for more than :days days", "{open_c} open class C violations, the oldest for {oldest_days} days", {"least": 3, "days": 180}),
    Rule("RUL-00002", "PBC-001", "community", "portfolio_roll_up", "confidence != 'Low' and n_bbls >= :bbls and (address_edges >= :addresses or name_edges >= :names)", "sure enough, at least :bbls buildings, and :addresses address or :names name links", "{n_bbls} buildings of {name} by {address_edges} address and {name_edges} name links", {"bbls": 2, "addresses": 1, "names": 2}),
    Rule("RUL-00003", "RMT-001", "nodeid", "landlord_linkage", "n_links >= :least", "linked by name with at least :least other", "linked by name with {n_links} others", {"least": 1}),
    Rule("RUL-00004", "RMT-002", "nodeid", "landlords_with_connections", "n_addresses >= :least", "linked by address with at least :least other", "linked by address with {n_addresses} others", {"least": 1}),
    Rule("RUL-00005", "RMT-003", "component", "component_sizes", "members >= :least", "a component of at least :least landlords", "a component of {members} landlords", {"least": 2}),
    Rule("RUL-00006", "RMT-004", "component", "component_sizes", "bbls > :most", "a component of more than :most buildings is split", "a component of {bbls} buildings", {"most": 300}),
    Rule("RUL-00007", "DT-001", "bbl", "deterioration", "deteriorating", "more issued and less resolved in the last two years than in the first two", "{issued} class C violations in {n_years} years", {"years": 3}, (("n_years < :years", "fewer_than_:years_years"),)),
    Rule("RUL-00008", "NE-001", "root", "network_exposure", "hazards > 0", "an actor with affiliates, :least in all, and hazards in their network", "{hazards} of {size} buildings of {members} actors", {"least": 2}, (("members < :least", "no_affiliates"),)),
    Rule("RUL-00009", "MA-001", "actor_id", "management_quartiles", "quartile = :quartile", "in quartile :quartile by open class C violations per unit", "{open_c} open class C violations over {units} units", {"quartile": 4}),
    Rule("RUL-00010", "RS-001", "bbl", "rent_stabilization", "change < 0 and deregulating", "fewer stabilised units than at first", "{units_lost} units lost", {}, (("change is null", "a_count_is_missing"),)),
    Rule("RUL-00011", "FE-001", "bbl", "fine_evasion", "owed > :limit", "unpaid balances above :limit", "{n_owed} of {n} judgments unpaid, {owed} owed of {penalty}", {"limit": 1_000_000}),
    Rule("RUL-00012", "EA-001", "bbl", "enforcement_gap", "stale >= :least and filings = 0", "at least :least class C violations open for over a year, and no court filing since", "{stale} stale violations, {filings} filings", {"least": 3}),
    Rule("RUL-00013", "RCV-001", "actor_id", "recidivism", "boroughs > :boroughs or old_buildings > 0", "hazards in more than :boroughs borough, or class C violations open for years", "hazards in {boroughs} boroughs, {old_buildings} old cases", {"boroughs": 1}),
    Rule("RUL-00014", "OC-001", "bbl", "ownership_change", "signal", "the rate of class C violations rose by half after the last deed", "{before} before and {after} after deed {deed_id}", {}, (("insufficient", "too_short_a_time"),)),
    Rule("RUL-00015", "VA-001", "bbl", "vacate_history", "n >= :least", "at least :least vacate order", "{n} orders, {n_active} active", {"least": 1}),
    Rule("RUL-00016", "OND-001", "id", "name_discrepancy", "overlap = 0", "the tax owner's name shares no word with the controller's", "{overlap} words in common", {}, (("insufficient is not null", "{insufficient}"),)),
    Rule("RUL-00017", "MBC-001", "bbl", "mortgage_verdict", "not token_overlap", "no word of the buyer's name is in the borrower's", "deed {deed_id} and mortgage {mortgage_id}, {gap_days} days apart", {}, (("insufficient", "{reason}"),)),
)

#: The questions that an engine of these rules answers: id, rule names, question.
QUESTIONS = (
    ("CQ-01", "DT-001", "Is the building getting worse?"),
    ("CQ-02", "PBC-001", "Who probably controls the building?"),
    ("CQ-03", "PBC-001", "Which buildings does an actor probably control?"),
    ("CQ-04", "PHC-001", "How many of an actor's buildings are hazardous?"),
    ("CQ-05", "RCV-001", "Does an actor leave hazards open again and again?"),
    ("CQ-06", "PHC-001", "Which actors are the worst by hazardous buildings?"),
    ("CQ-07", "RMT-001|RMT-002", "Is an actor's control concealed?"),
    ("CQ-08", "PHC-001", "Where do hazardous buildings concentrate?"),
    ("CQ-09", "OC-001", "Did conditions change with the owner?"),
    ("CQ-10", "", "What is known about the building?"),
    ("CQ-11", "RS-001", "Is the building losing stabilised units?"),
    ("CQ-12", "FE-001", "Are fines left unpaid?"),
    ("CQ-13", "EA-001", "Is enforcement missing?"),
    ("CQ-14", "NE-001", "What is an actor exposed to by its affiliates?"),
    ("CQ-15", "VA-001", "Was the building ever vacated?"),
    ("CQ-16", "OND-001", "Do the owner's and the controller's names differ?"),
    ("CQ-17", "MBC-001", "Does a mortgage name someone else than the buyer?"),
    ("CQ-18", "MA-001|RMT-003|RMT-004", "How is a portfolio managed and put together?"),
)

_SCHEMA = "rule_id string, name string, version string, subject string, facts string, condition string, statement string, text string, thresholds map<string,double>, reasons array<struct<condition:string,reason:string>>, deprecated boolean"


def rule_table(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rules as a table, as :func:`from_table` reads it."""
    rows = [(r.rule_id, r.name, r.version, r.subject, r.facts, r.condition, r.statement, r.text, {k: float(v) for k, v in r.thresholds.items()}, list(r.reasons), r.deprecated) for r in rules]
    return spark.createDataFrame(rows, _SCHEMA)


def from_table(table: DataFrame) -> tuple[Rule, ...]:
    """Rules from their table: a row a rule, so few."""
    out = []
    for r in table.orderBy("rule_id").collect():
        out.append(Rule(r.rule_id, r.name, r.subject, r.facts, r.condition, r.statement, r.text, dict(r.thresholds), tuple((x.condition, x.reason) for x in r.reasons), r.version, r.deprecated))
    return tuple(out)


def question_table(spark: SparkSession) -> DataFrame:
    table = spark.createDataFrame(list(QUESTIONS), "question_id string, rules string, question string")
    return table.withColumn("rules", F.filter(F.split("rules", r"\|"), lambda r: r != ""))


def _number(value: float) -> str:
    return str(int(value)) if value == int(value) else repr(float(value))


def _filled(rule: Rule, text: str) -> str:
    return re.sub(r":([a-z]+)", lambda m: _number(rule.thresholds[m[1]]) if m[1] in rule.thresholds else m[0], text)


def _said(rule: Rule, text: str) -> Column:
    """A text with its thresholds and facts in place; facts that are null are said as unknown."""
    parts = re.split(r"\{(\w+)\}", _filled(rule, text))
    return F.concat(*(F.lit(p) if k % 2 == 0 else F.coalesce(F.col(p).cast("string"), F.lit("unknown")) for k, p in enumerate(parts) if p or k % 2))


def compile_rule(rule: Rule, facts: DataFrame) -> DataFrame:
    """(rule_id, rule_version, subject, verdict, reason, statement, text), one row a row of facts.

    verdict is null, and reason there, where a reason holds; a condition that is null is not met. The
    text is there where the rule is met.
    """
    reason = F.lit(None).cast("string")
    for condition, name in reversed(rule.reasons):
        reason = F.when(F.expr(_filled(rule, condition)), _said(rule, name)).otherwise(reason)
    judged = facts.withColumns({"_reason": reason, "_met": F.coalesce(F.expr(_filled(rule, rule.condition)), F.lit(False))})
    verdict = F.when(F.col("_reason").isNull(), F.col("_met"))
    return judged.select(
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.version).alias("rule_version"),
        F.col(rule.subject).cast("string").alias("subject"),
        verdict.alias("verdict"),
        F.col("_reason").alias("reason"),
        F.lit(_filled(rule, rule.statement)).alias("statement"),
        F.when(verdict, _said(rule, rule.text)).alias("text"),
    )


def evaluate(rules: tuple[Rule, ...], facts: Callable[[str], DataFrame], subject: str | None = None) -> DataFrame:
    """The verdicts of all rules that are not deprecated, or of those about one kind of subject."""
    chosen = [r for r in rules if not r.deprecated and (subject is None or r.subject == subject)]
    return reduce(DataFrame.unionByName, (compile_rule(r, facts(r.facts)) for r in chosen))
