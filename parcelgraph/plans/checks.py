"""Invariants as DataFrames of the rows that break them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_partner(rows: DataFrame, partners: DataFrame, key: str, partner_key: str) -> DataFrame:
    """Rows whose key no partner has (claims without evidence, observations without source, ...)."""
    return rows.join(partners.select(F.col(partner_key).alias(key)), key, "left_anti")


def too_few(rows: DataFrame, partners: DataFrame, key: str, least: int) -> DataFrame:
    """(key, n) of rows with fewer than ``least`` distinct partners (key, partner)."""
    counted = partners.groupBy(key).agg(F.count_distinct("partner").alias("n"))
    return rows.select(key).distinct().join(counted, key, "left").fillna(0, ["n"]).where(F.col("n") < least)


def missing_rule(rows: DataFrame, statuses: Sequence[str] = ("Inferred", "Derived", "Estimated")) -> DataFrame:
    """Interpreted rows that name no rule."""
    return rows.where(F.col("status").isin(*statuses) & F.col("rule_id").isNull())


def of_deprecated_rules(claims: DataFrame, rules: DataFrame) -> DataFrame:
    """Active claims whose rule is deprecated."""
    old = rules.where("deprecated").select("rule_id")
    return claims.where("superseded_by is null").join(old, "rule_id", "left_semi")


def repeated_keys(rows: DataFrame, *key: str) -> DataFrame:
    """(key..., n) of keys that are null in a part or not unique."""
    null = F.lit(False)
    for c in key:
        null = null | F.col(c).isNull()
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | null)


def outside_vocabulary(rows: DataFrame, column: str, words: Sequence[str]) -> DataFrame:
    """(column, n) of values that a vocabulary doesn't have."""
    return rows.where(F.col(column).isNotNull() & ~F.col(column).isin(*words)).groupBy(column).agg(F.count("*").alias("n"))


def malformed_keys(rows: DataFrame, column: str = "bbl") -> DataFrame:
    return rows.where(F.length(column) != 10)


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys on each side and on both."""
    a, b = left.select(key).distinct().withColumn("a", F.lit(1)), right.select(key).distinct().withColumn("b", F.lit(1))
    return a.join(b, key, "full_outer").agg(F.count("a").alias("left"), F.count("b").alias("right"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))


def without_run(networks: DataFrame, column: str = "run_id") -> DataFrame:
    """Networks that don't say which run found them."""
    return networks.where(F.col(column).isNull())


def ids_like(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose id has a form that is no longer used."""
    return rows.where(F.col(column).rlike(pattern))
