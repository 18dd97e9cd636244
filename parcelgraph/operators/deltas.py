"""Claims kept up to date from batches of events that come late, change, or are taken back.

Each batch becomes signed changes of what supports a claim: an event that no longer counts takes its
support away, one that now counts adds it. Counts add up and the oldest date is a minimum over what
is left, so only buildings that the batch touches are looked at again; their claims open, change or
close. Where a rule was last evaluated for another date, with other terms or before other batches, all
buildings are. Whatever the order in which batches come, the newest version of each event decides, and the
tables are those of an evaluation of all events at once. All tables of a batch become visible
together.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelgraph.operators.ontology import stable_id
from parcelgraph.operators.store import Commit, Store
from parcelgraph.sources.shared import write

EVENT = ("bbl", "violation_class", "status", "open_date")


def newest(events: DataFrame) -> DataFrame:
    """One row an event: the greatest version, of equal versions the greatest by its other columns."""
    last = F.max(F.struct("version", *EVENT)).alias("last")
    return events.where("event_id is not null").groupBy("event_id").agg(last).select("event_id", "last.*")


def supports(of: str = "") -> Column:
    """Whether an event supports a claim of persistent hazard."""
    c = lambda name: F.col(of + name)
    return F.coalesce((c("violation_class") == "C") & (c("status") == "Open") & c("open_date").isNotNull() & c("bbl").isNotNull(), F.lit(False))


def hazards(support: DataFrame, as_of: str, least: int, days: int) -> DataFrame:
    """(bbl, open_c, oldest, basis) of the buildings whose supporting events meet the rule; basis is a
    number that other events have otherwise."""
    by = support.groupBy("bbl").agg(F.count("*").alias("open_c"), F.min("open_date").alias("oldest"), F.bit_xor(F.xxhash64("event_id")).alias("basis"))
    return by.where((F.col("open_c") >= least) & (F.datediff(F.lit(as_of).cast("date"), "oldest") > days))


def apply_batch(store: Store, batch: DataFrame, run: str, as_of: str, rule_id: str = "RUL-00001", least: int = 3, days: int = 180, buckets: int = 16) -> int | None:
    """Take one batch of events in; the new version, None if this run is in the store already and has
    nothing that is new to it.

    batch: event_id, version, bbl, violation_class, status, open_date. Tables: *events* (the newest
    version of each), *support* (bbl, event_id, open_date, n: what counts now), *claims* (claim_id,
    rule_id, subject_id, open_c, oldest, basis, opened, closed, superseded_by) and *evidence* (claim_id,
    event_id, n: the events of an open claim). A claim whose facts change is superseded by a new one;
    one whose building no longer meets the rule is closed. Claims are those of all events that were
    taken in, as of ``as_of``, whichever rules earlier batches were applied with.
    """
    tx = store.begin()
    runs, batches, evaluated = (tx.state["notes"].get(n, none) for n, none in (("runs", []), ("batches", 0), ("evaluated", {})))
    again = run in runs
    current = evaluated.get(rule_id) == [str(as_of), least, days, batches]
    new = newest(batch)
    known = tx.read_near("events", new.select("event_id"))
    first = known is None
    if first:
        known = new.where("false").select("event_id", "version", *EVENT)
    was = known.select("event_id", F.lit(True).alias("was"), *(F.col(c).alias(f"was_{c}") for c in ("version", *EVENT)))
    both = new.join(was, "event_id", "left")
    # the greater of the two by version and then by the other columns, as within a batch
    later = F.col("was").isNull() | (F.struct("version", *EVENT) > F.struct(*(F.col(f"was_{c}").alias(c) for c in ("version", *EVENT))))
    changed = both.where(later)
    off = changed.where(supports("was_")).select(F.col("was_bbl").alias("bbl"), "event_id", F.col("was_open_date").alias("open_date"), F.lit(-1).alias("n"))
    on = changed.where(supports()).select("bbl", "event_id", "open_date", F.lit(1).alias("n"))
    signed = off.unionByName(on).groupBy("bbl", "event_id", "open_date").agg(F.sum("n").cast("long").alias("n")).where("n != 0")
    # both are read several times, and must be the same each time
    delta = _staged(store, signed, "signed")
    replaced = _staged(store, changed.select("event_id", "version", *EVENT), "new-events")
    if again and current and replaced.isEmpty():
        return None
    tx.merge("support", delta, ["bbl", "event_id", "open_date"], add=["n"], drop=F.col("n") == 0, by=["bbl"], buckets=buckets)
    tx.merge("events", replaced, ["event_id"], whole=["version", *EVENT], buckets=buckets)
    touched = delta.select("bbl").distinct()
    if not first and not current:
        held = tx.read("claims").where(F.col("closed").isNull() & (F.col("rule_id") == rule_id)).select(F.col("subject_id").alias("bbl"))
        touched = _staged(store, touched.unionByName(tx.read("support").select("bbl")).unionByName(held).distinct(), "touched")
    now = hazards(tx.read_near("support", touched).join(touched, "bbl", "left_semi"), as_of, least, days)
    # a claim's id has the run, which may have opened one about the same building before
    _reclaim(tx, now, touched, f"{run}-{tx.state['version'] + 1}" if again else run, rule_id, as_of, buckets)
    tx.note("runs", runs if again else [*runs, run])
    tx.note("batches", batches + 1)
    tx.note("evaluated", {**evaluated, rule_id: [str(as_of), least, days, batches + 1]})
    return tx.commit()


def _staged(store: Store, rows: DataFrame, what: str) -> DataFrame:
    return write(rows, f"{store.path}/data/{what}-{uuid.uuid4().hex}")


def _reclaim(tx: Commit, now: DataFrame, touched: DataFrame, run: str, rule_id: str, as_of: str, buckets: int) -> None:
    """Open, supersede and close the claims about ``touched`` buildings (bbl) so that they are ``now``."""
    subjects = touched.select(F.col("bbl").alias("subject_id"))
    held = tx.read_near("claims", subjects)
    schema = "subject_id string, claim_id string, rule_id string, open_c long, oldest date, basis long, opened string, closed date, superseded_by string"
    held = tx.spark.createDataFrame([], schema) if held is None else held
    active = held.where((F.col("rule_id") == rule_id) & F.col("closed").isNull()).join(subjects, "subject_id", "left_semi")
    found = now.select(F.col("bbl").alias("subject_id"), F.col("open_c").alias("new_c"), F.col("oldest").alias("new_oldest"), F.col("basis").alias("new_basis"))
    both = active.join(found, "subject_id", "full_outer")
    same = (F.col("open_c") == F.col("new_c")) & (F.col("oldest") == F.col("new_oldest")) & (F.col("basis") == F.col("new_basis"))
    fresh = stable_id("CLM-", F.lit(rule_id), F.col("subject_id"), F.lit(run))
    ends = F.col("claim_id").isNotNull() & ~F.coalesce(same, F.lit(False))
    starts = F.col("new_c").isNotNull() & ~F.coalesce(same, F.lit(False))
    closed = both.where(ends).select("subject_id", "claim_id", "rule_id", "open_c", "oldest", "basis", "opened", F.lit(as_of).cast("date").alias("closed"), F.when(F.col("new_c").isNotNull(), fresh).alias("superseded_by"))
    opened = both.where(starts).select("subject_id", fresh.alias("claim_id"), F.lit(rule_id).alias("rule_id"), F.col("new_c").alias("open_c"), F.col("new_oldest").alias("oldest"), F.col("new_basis").alias("basis"), F.lit(run).alias("opened"), F.lit(None).cast("date").alias("closed"), F.lit(None).cast("string").alias("superseded_by"))
    rows = _staged(tx.store, closed.unionByName(opened), "new-claims")
    columns = ["rule_id", "open_c", "oldest", "basis", "opened", "closed", "superseded_by"]
    tx.merge("claims", rows, ["subject_id", "claim_id"], whole=columns, by=["subject_id"], buckets=buckets)
    cited = rows.where("closed is null").select("claim_id", F.col("subject_id").alias("bbl"))
    support = tx.read_near("support", touched)
    proof = cited.join(support, "bbl").select(F.col("bbl").alias("subject_id"), "claim_id", "event_id", F.lit(1).cast("long").alias("n"))
    tx.merge("evidence", proof, ["subject_id", "claim_id", "event_id"], always=["n"], by=["subject_id"], buckets=buckets)


def withdraw(store: Store, actor: str, children: DataFrame, run: str, at: str, buckets: int = 16) -> int:
    """Split an actor: it is withdrawn, its claims and relationships close, and lineage leads to what
    takes its place, all in one version.

    children: actor_id, bbl, name. Tables: *actors* (actor_id, name, confidence, withdrawn, run),
    *relationships* (actor_id, bbl, effective_from, effective_to), *lineage* (from_id, to_id, kind,
    at) and *claims*.
    """
    tx, day = store.begin(), F.lit(at).cast("date")
    one = tx.spark.range(1).select(F.lit(actor).alias("actor_id"))
    gone = one.select("actor_id", F.lit(None).cast("string").alias("name"), F.lit("Withdrawn").alias("confidence"), day.alias("withdrawn"), F.lit(run).alias("run"))
    born = children.groupBy("actor_id").agg(F.min("name").alias("name")).select("actor_id", "name", F.lit("Medium").alias("confidence"), F.lit(None).cast("date").alias("withdrawn"), F.lit(run).alias("run"))
    tx.merge("actors", gone.unionByName(born), ["actor_id"], always=["name", "confidence", "withdrawn", "run"], buckets=buckets)
    held = tx.read_near("relationships", one)
    mine = held.where((F.col("actor_id") == actor) & F.col("effective_to").isNull()).select("actor_id", "bbl", "effective_from", day.alias("effective_to"))
    takes = children.select("actor_id", "bbl", day.alias("effective_from"), F.lit(None).cast("date").alias("effective_to")).distinct()
    tx.merge("relationships", mine.unionByName(takes), ["actor_id", "bbl"], once=["effective_from"], always=["effective_to"], by=["actor_id"], buckets=buckets)
    split = children.select(F.lit(actor).alias("from_id"), F.col("actor_id").alias("to_id"), F.lit("SPLIT_INTO").alias("kind"), day.alias("at")).distinct()
    tx.merge("lineage", split, ["from_id", "to_id"], once=["at"], always=["kind"], by=["from_id"], buckets=buckets)
    claims = tx.read_near("claims", one.select(F.col("actor_id").alias("subject_id")))
    if claims is not None:
        open_ones = claims.where((F.col("subject_id") == actor) & F.col("closed").isNull())
        closed = open_ones.select("subject_id", "claim_id", day.alias("closed"), F.lit(f"RECLUSTER-{run}").alias("superseded_by"))
        others = [c for c in claims.columns if c not in ("subject_id", "claim_id", "closed", "superseded_by")]
        kept = open_ones.select("subject_id", "claim_id", *others)
        tx.merge("claims", closed.join(kept, ["subject_id", "claim_id"]), ["subject_id", "claim_id"], always=["closed", "superseded_by", *others])
    return tx.commit()
