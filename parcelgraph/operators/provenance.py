"""Observations, sources and identities: where what the graph says comes from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sources(spark: SparkSession, names: Sequence[str], retrieved: str) -> DataFrame:
    """(source_id, source_name, retrieval_date): one row a source, the same id each time."""
    rows = spark.createDataFrame([(f"SRC-{n.upper()}", n) for n in names], "source_id string, source_name string")
    return rows.withColumn("retrieval_date", F.lit(retrieved).cast("date"))


def observations(events: DataFrame, source_id: str) -> DataFrame:
    """(observation_id, event_id, source_record_id, source_id): one for each record of a source, in
    which its event originates. events: event_id, source_record_id."""
    made = events.select(F.concat_ws("-", F.lit("OBS"), F.lit(source_id), "source_record_id").alias("observation_id"), "event_id", "source_record_id", F.lit(source_id).alias("source_id"))
    return made.where("source_record_id is not null").dropDuplicates(["observation_id", "event_id"])


def claim_lineage(claims: DataFrame, evidence: DataFrame, events: DataFrame, observed: DataFrame, known: DataFrame) -> DataFrame:
    """(subject_id, rule_id, event_id, observation_id, source_name, retrieval_date): from a claim by
    its evidence and the evidence's events to observations and their sources.

    Events meet observations by record and source. Every step is an equi-join.
    """
    cited = evidence.select("claim_id", F.explode("event_ids").alias("event_id"))
    rows = claims.select("claim_id", "subject_id", "rule_id").join(cited, "claim_id")
    rows = rows.join(events.select("event_id", "source_record_id", "source_id").distinct(), "event_id")
    rows = rows.join(observed.select("observation_id", "source_record_id", "source_id"), ["source_record_id", "source_id"])
    return rows.join(known, "source_id").select("subject_id", "rule_id", "event_id", "observation_id", "source_name", "retrieval_date")


def within_two_hops(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, hops): what undirected edges (src, dst) reach in 0, 1 or 2 steps, the fewest."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).where("src != dst").distinct()
    none = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops"))
    one = none.join(both, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), F.lit(1).alias("hops"))
    two = one.join(both, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), F.lit(2).alias("hops"))
    return none.unionByName(one).unionByName(two).groupBy("start", "node").agg(F.min("hops").alias("hops"))


def identity_observations(rows: DataFrame) -> DataFrame:
    """One row for each (raw_name, source_id, context) with the bbls it was seen at, five of them in
    its text. rows: raw_name, source_id, context, bbl."""
    by = rows.groupBy("raw_name", "source_id", "context").agg(F.sort_array(F.collect_set("bbl")).alias("bbls"))
    return by.select("raw_name", "source_id", "context", F.size("bbls").cast("long").alias("n_bbls"), F.array_join(F.slice("bbls", 1, 5), ", ").alias("seen_at"))


def assertions(active: DataFrame, found: DataFrame) -> DataFrame:
    """(actor_id, name, action) of identity assertions: those that changed are superseded and made
    anew, unchanged ones kept, missing ones withdrawn. Both: actor_id, name."""
    old, new = active.select("actor_id", F.col("name").alias("was")), found.select("actor_id", F.col("name").alias("now"))
    both = old.join(new, "actor_id", "full_outer")
    changed = F.when(F.col("was").isNull(), F.array(F.lit("create"))).when(F.col("now").isNull(), F.array(F.lit("withdraw"))).when(F.col("was") == F.col("now"), F.array(F.lit("keep"))).otherwise(F.array(F.lit("supersede"), F.lit("create")))
    rows = both.withColumn("action", F.explode(changed))
    return rows.select("actor_id", F.when(F.col("action").isin("supersede", "withdraw"), F.col("was")).otherwise(F.col("now")).alias("name"), "action")


def involved_buildings(claims: DataFrame, relationships: DataFrame, buildings: DataFrame) -> DataFrame:
    """(claim_id, bbl): the known buildings that the actor of a claim of control holds.

    claims: claim_id, subject_id (an actor); relationships: actor_id, bbl, effective_to.
    """
    held = relationships.where("effective_to is null").select(F.col("actor_id").alias("subject_id"), "bbl").distinct()
    return claims.select("claim_id", "subject_id").join(held, "subject_id").join(buildings.select("bbl"), "bbl", "left_semi").select("claim_id", "bbl")


def stub_upsert(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Buildings: what is known keeps all it has, but for a missing address or borough, which a
    stub may give; keys never seen become stubs. Both have bbl, address and borough; known more."""
    stubs = seen.groupBy("bbl").agg(F.min("address").alias("_address"), F.min("borough").alias("_borough"))
    rows = known.join(stubs, "bbl", "full_outer")
    filled = {c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.col(f"_{c}")) for c in ("address", "borough")}
    return rows.withColumns(filled).drop("_address", "_borough")


def enriched(known: DataFrame, more: DataFrame) -> DataFrame:
    """Buildings with the columns of ``more`` added by bbl; keys of either side stay."""
    return known.join(more, "bbl", "full_outer")
