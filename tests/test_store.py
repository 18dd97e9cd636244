"""Versioned tables: merges, crashes, look-ups; claims under late and retracted events; withdrawal."""

import itertools
import os
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from parcelgraph.operators import deltas
from parcelgraph.operators.store import Conflict, Store


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_merge_keeps_and_sets(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.read("t") is None and store.versions() == []
    put = lambda rows, at: (tx := store.begin()).merge("t", spark.createDataFrame(rows, "k long, address string, score long, seen long"), ["k"], once=["address"], always=["score"], add=["seen"], at=F.lit(at).cast("date"), buckets=4) or tx.commit()
    assert put([(1, "A", 1, 1), (2, None, 2, 1)], "2020-01-01") == 1
    assert put([(2, "B", None, 2), (3, "C", 5, 1)], "2020-02-01") == 2
    assert put([(2, "never", 9, 1)], "2020-03-01") == 3
    d = lambda m: date(2020, m, 1)
    cols = ["k", "address", "score", "seen", "created_at", "updated_at"]
    assert table(store.read("t").select(*cols)) == [(1, "A", 1, 1, d(1), d(1)), (2, "B", 9, 4, d(1), d(3)), (3, "C", 5, 1, d(2), d(2))]
    assert table(store.read("t", 1).select("k", "address")) == [(1, "A"), (2, None)]
    assert table(store.lookup("t", k=2).select(*cols)) == [(2, "B", 9, 4, d(1), d(3))]
    assert store.lookup("t", k=77).collect() == []


def test_a_merge_writes_what_it_touches(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet"))
    tx = store.begin()
    tx.merge("t", spark.range(200_000).select("id", F.sha1(F.col("id").cast("string")).alias("v")), ["id"], always=["v"], buckets=64)
    tx.commit()
    whole = size()
    tx = store.begin()
    tx.merge("t", spark.createDataFrame([(7, "new")], "id long, v string"), ["id"], always=["v"])
    assert len(tx.rewritten["t"]) == 1
    tx.commit()
    assert size() - whole < whole / 20
    assert store.lookup("t", id=7).first().v == "new" and store.read("t").count() == 200_000
    plan = store.lookup("t", id=7)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,7)]" in plan and plan.count("_bucket=") <= 2
    store.vacuum(keep=1)
    assert size() < 1.1 * whole and store.read("t").count() == 200_000


def test_what_breaks_off_is_not_seen(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = lambda *x: spark.createDataFrame([(k, v) for k, v in x], "k long, v string")
    tx = store.begin()
    tx.merge("claims", rows((1, "a")), ["k"], always=["v"])
    tx.merge("evidence", rows((1, "e")), ["k"], always=["v"])
    tx.commit()
    broken = store.begin()
    broken.merge("claims", rows((1, "changed"), (2, "b")), ["k"], always=["v"])
    assert table(store.read("claims")) == [(1, "a")]  # written, not committed
    # a manifest that was not renamed is no version either
    (tmp_path / "s" / "versions" / "draft-x").write_text("{}")
    assert store.versions() == [1]
    other = store.begin()
    other.merge("claims", rows((3, "c")), ["k"], always=["v"])
    other.merge("evidence", rows((3, "e3")), ["k"], always=["v"])
    other.commit()
    with pytest.raises(Conflict):
        broken.commit()
    assert table(store.read("claims")) == [(1, "a"), (3, "c")] and table(store.read("evidence")) == [(1, "e"), (3, "e3")]
    # a reader of a version sees claims and evidence of one commit
    for v in store.versions():
        assert {r.k for r in store.read("claims", v).collect()} == {r.k for r in store.read("evidence", v).collect()}


EVENTS = "event_id string, version long, bbl string, violation_class string, status string, open_date date"


def _batches(seed):
    draw = random.Random(seed)
    rows = []
    for k in range(60):
        for version in range(draw.randrange(1, 4)):
            rows.append((f"e{k}", version, draw.choice(["b1", "b2", "b3", "b4", None]), draw.choice("CCCB"), draw.choice(["Open", "Open", "Closed"]), date(2000 + draw.randrange(2), 1 + draw.randrange(12), 3) if draw.random() < 0.95 else None))
    draw.shuffle(rows)
    return [rows[k::3] for k in range(3)]


def _active(store):
    return table(store.read("claims").where("closed is null").select("subject_id", "open_c", "oldest"))


def test_claims_are_those_of_a_rebuild_in_any_order(spark, tmp_path):
    batches = _batches(5)
    newest = {}
    for e in itertools.chain(*batches):
        if e[0] not in newest or (e[1], *map(str, e[2:])) > (newest[e[0]][1], *map(str, newest[e[0]][2:])):
            newest[e[0]] = e
    by = {}
    for _, _, bbl, kind, status, opened in newest.values():
        if bbl and kind == "C" and status == "Open" and opened:
            by.setdefault(bbl, []).append(opened)
    want = sorted((b, len(x), min(x)) for b, x in by.items() if len(x) >= 3 and (date(2001, 12, 31) - min(x)).days > 180)
    assert want
    for n, order in enumerate([(0, 1, 2), (2, 0, 1), (1, 2, 0)]):
        store = Store(spark, f"file://{tmp_path}/{n}")
        for k in order:
            deltas.apply_batch(store, spark.createDataFrame(batches[k], EVENTS), f"run{k}", "2001-12-31", buckets=3)
        assert _active(store) == want
        assert deltas.apply_batch(store, spark.createDataFrame(batches[0], EVENTS), "run0", "2001-12-31") is None
        claims, proof = store.read("claims"), store.read("evidence")
        assert claims.select("claim_id").distinct().count() == claims.count()
        # each open claim has the evidence that it counts, and what was superseded names what took its place
        counted = proof.groupBy("claim_id").agg(F.count("*").alias("k"))
        assert claims.where("closed is null").join(counted, "claim_id").where("k = open_c").count() == len(want)
        heirs = claims.where("superseded_by is not null").select(F.col("superseded_by").alias("claim_id"))
        assert heirs.join(claims, "claim_id", "left_anti").count() == 0
        for v in store.versions():
            old = store.read("claims", v).where("closed is null").select("claim_id")
            assert old.join(store.read("evidence", v), "claim_id", "left_anti").count() == 0


def test_a_retraction_closes_a_claim(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    day = date(2000, 1, 1)
    first = [(f"e{k}", 1, "b1", "C", "Open", day) for k in range(3)]
    deltas.apply_batch(store, spark.createDataFrame(first, EVENTS), "r1", "2001-12-31")
    assert _active(store) == [("b1", 3, day)]
    deltas.apply_batch(store, spark.createDataFrame([("e0", 2, "b1", "C", "Closed", day)], EVENTS), "r2", "2001-12-31")
    assert _active(store) == []
    assert [(r.closed, r.superseded_by) for r in store.read("claims").collect()] == [(date(2001, 12, 31), None)]
    # an older version of the event that comes late changes nothing
    deltas.apply_batch(store, spark.createDataFrame([("e0", 1, "b1", "C", "Open", day)], EVENTS), "r3", "2001-12-31")
    assert _active(store) == []


def _claimed(store, rule_id):
    return table(store.read("claims").where(F.col("closed").isNull() & (F.col("rule_id") == rule_id)).select("subject_id", "open_c", "oldest"))


def test_claims_of_buildings_that_no_batch_touches(spark, tmp_path):
    """buildings were looked at again only when an event of theirs changed, whatever the date and the rule."""
    store, day, late = Store(spark, f"file://{tmp_path}/s"), date(2000, 1, 1), date(2001, 12, 1)
    events = lambda bbl, n, at: spark.createDataFrame([(f"{bbl}-{k}", 1, bbl, "C", "Open", at) for k in range(n)], EVENTS)
    apply = lambda batch, run, as_of, **how: deltas.apply_batch(store, batch, run, as_of, buckets=3, **how)
    apply(events("b1", 3, day), "r1", "2000-03-01")
    assert _claimed(store, "RUL-00001") == []
    # its events are old enough now
    apply(events("b2", 1, late), "r2", "2001-12-31")
    assert _claimed(store, "RUL-00001") == [("b1", 3, day)]
    # another rule, over events that are there already
    assert apply(events("b2", 1, late), "r2", "2001-12-31", rule_id="LAX", least=1, days=1) == 3
    assert _claimed(store, "LAX") == [("b1", 3, day), ("b2", 1, late)] and _claimed(store, "RUL-00001") == [("b1", 3, day)]
    # events that came with one rule count for the other
    apply(events("b3", 3, day), "r3", "2001-12-31", rule_id="LAX", least=1, days=1)
    assert apply(events("b3", 3, day), "r3", "2001-12-31") == 5
    assert _claimed(store, "RUL-00001") == [("b1", 3, day), ("b3", 3, day)]
    # other terms close what they don't uphold
    apply(events("b1", 4, day), "r4", "2001-12-31", least=4)
    assert _claimed(store, "RUL-00001") == [("b1", 4, day)]
    assert apply(events("b1", 4, day), "r4", "2001-12-31", least=4) is None
    # the rest of a run that came in parts
    apply(events("b1", 5, day), "r4", "2001-12-31", least=4)
    assert _claimed(store, "RUL-00001") == [("b1", 5, day)]
    claims, proof = store.read("claims"), store.read("evidence").groupBy("claim_id").agg(F.count("*").alias("k"))
    assert claims.select("claim_id").distinct().count() == claims.count()
    assert claims.where("closed is null").join(proof, "claim_id").where("k = open_c").count() == claims.where("closed is null").count() == 4


def test_events_without_a_version_are_known_too(spark, tmp_path):
    """what the order of batches decides must not depend on the version's presence."""
    batches = [[("e0", None, "b1", "C", "Open", date(2000, 1, 1))], [("e0", None, "b0", "C", "Open", date(2000, 1, 1))]]
    for n, order in enumerate(((0, 1), (1, 0))):
        store = Store(spark, f"file://{tmp_path}/{n}")
        for k in order:
            deltas.apply_batch(store, spark.createDataFrame(batches[k], EVENTS), f"r{k}", "2001-12-31", least=1, buckets=2)
        assert _active(store) == [("b1", 1, date(2000, 1, 1))]


def test_withdrawal_is_one_commit(spark, tmp_path):
    store, day = Store(spark, f"file://{tmp_path}/s"), date(2020, 5, 1)
    tx = store.begin()
    tx.merge("actors", spark.createDataFrame([("A", "Hub", "High", None, "r0")], "actor_id string, name string, confidence string, withdrawn date, run string"), ["actor_id"], always=["name", "confidence", "withdrawn", "run"])
    held = [("A", b, date(2019, 1, 1), None) for b in ("b1", "b2", "b3")] + [("Z", "b9", date(2019, 1, 1), None)]
    tx.merge("relationships", spark.createDataFrame(held, "actor_id string, bbl string, effective_from date, effective_to date"), ["actor_id", "bbl"], once=["effective_from"], always=["effective_to"], by=["actor_id"])
    claims = [("A", "c1", "RUL-00002", None, None), ("A", "c0", "RUL-00002", date(2018, 1, 1), "c1"), ("Z", "c9", "RUL-00002", None, None)]
    tx.merge("claims", spark.createDataFrame(claims, "subject_id string, claim_id string, rule_id string, closed date, superseded_by string"), ["subject_id", "claim_id"], always=["rule_id", "closed", "superseded_by"], by=["subject_id"])
    tx.commit()
    children = spark.createDataFrame([("N1", "b1", "Ann"), ("N1", "b2", "Ann"), ("N2", "b3", "Bo")], "actor_id string, bbl string, name string")
    assert deltas.withdraw(store, "A", children, "r7", "2020-05-01") == 2
    assert table(store.read("actors").select("actor_id", "name", "confidence", "withdrawn")) == [("A", "Hub", "Withdrawn", day), ("N1", "Ann", "Medium", None), ("N2", "Bo", "Medium", None)]
    got = {(r.actor_id, r.bbl): (r.effective_from, r.effective_to) for r in store.read("relationships").collect()}
    assert got[("A", "b1")] == (date(2019, 1, 1), day) and got[("N1", "b2")] == (day, None) and got[("Z", "b9")] == (date(2019, 1, 1), None) and len(got) == 7
    assert table(store.read("lineage").select("from_id", "to_id", "kind", "at")) == [("A", "N1", "SPLIT_INTO", day), ("A", "N2", "SPLIT_INTO", day)]
    assert {r.claim_id: r.superseded_by for r in store.read("claims").collect()} == {"c1": "RECLUSTER-r7", "c0": "c1", "c9": None}
    assert store.read("lineage", 1) is None and store.read("actors", 1).count() == 1
