from datetime import date, timedelta

from pyspark.sql import functions as F

from parcelgraph.operators import relational
from parcelgraph.operators.components import connected_components
from parcelgraph.plans import rules

DAY = date(2026, 7, 1)


def violations(spark, rows):
    return spark.createDataFrame([(b, d, "C", s) for b, d, s in rows], "bbl string, open_date date, violation_class string, status string")


def test_persistent_hazard(spark):
    new = date(2026, 6, 1)
    rows = [("a", d, "Open") for d in (date(2026, 1, 2), new, new)] + [("b", d, "Open") for d in (date(2026, 1, 1), new, new)] + [("c", date(2010, 1, 1), "Open")] * 2
    assert [r.bbl for r in rules.persistent_hazard(violations(spark, rows), str(DAY)).collect()] == ["b"]


def test_deterioration(spark):
    rows = [("a", date(y, 1, 1 + k), "Closed" if k < done else "Open") for y, n, done in ((2021, 10, 9), (2022, 10, 8), (2023, 20, 10), (2024, 20, 6), (2025, 20, 4)) for k in range(n)]
    rows += [("b", date(2024, 1, 1), "Open"), ("b", date(2025, 1, 1), "Open")]
    out = {r.bbl: r for r in rules.deterioration(violations(spark, rows), "2025-12-31").collect()}
    assert out["a"].deteriorating and not out["a"].insufficient
    assert out["b"].insufficient and out["b"].deteriorating is None


def test_fine_evasion(spark):
    rows = spark.createDataFrame([("a", 1, 0, 1_000_000), ("b", 1, 0, 1_000_001), ("c", 1, 0, None)], "bbl string, penalty long, paid long, balance long")
    assert {r.bbl: r.flagged for r in rules.fine_evasion(rows).collect()} == {"a": False, "b": True}


def test_enforcement_gap(spark):
    old, edge = DAY - timedelta(366), DAY - timedelta(365)
    rows = [("a", old, "Open")] * 3 + [("b", edge, "Open")] * 3 + [("c", old, "Open")] * 3
    filings = spark.createDataFrame([("c", old)], "bbl string, event_date date")
    out = {r.bbl: r.gap for r in rules.enforcement_gap(violations(spark, rows), filings, str(DAY)).collect()}
    assert out == {"a": True, "c": False}


def test_nearest_mortgage(spark):
    deed = spark.createDataFrame([("x", "d", DAY)], "bbl string, event_id string, event_date date")
    days = {"m-15": -15, "m-14": -14, "m60": 60, "m61": 61, "m3": 3}
    loans = spark.createDataFrame([("x", k, DAY + timedelta(v)) for k, v in days.items()], "bbl string, event_id string, event_date date")
    assert [(r.mortgage_id, r.gap_days) for r in rules.nearest_mortgage(deed, loans).collect()] == [("m3", 3)]
    far = loans.where("event_id in ('m-15', 'm61')")
    assert rules.nearest_mortgage(deed, far).count() == 0


def test_mortgage_concealment(spark):
    kinds = "bbl string, event_id string, event_date date, {} string"
    old, later, far = DAY - timedelta(50), DAY + timedelta(3), DAY + timedelta(61)
    deeds = spark.createDataFrame([("same", "d1", DAY, "ANN LEE"), ("same", "d2", later, None), ("other", "d3", DAY, "ANN LEE"), ("other", "d0", old, "BO RAY"), ("late", "d4", DAY, "ANN LEE"), ("odd", "d5", DAY, "1 2"), ("blank", "d6", DAY, "")], kinds.format("grantee_names"))
    loans = spark.createDataFrame([("same", "m1", later, "LEE, A."), ("other", "m2", later, "BO RAY"), ("other", "m3", DAY + timedelta(9), "ANN LEE"), ("other", "m4", DAY, None), ("late", "m5", far, "ANN LEE"), ("odd", "m6", DAY, "ANN LEE"), ("blank", "m7", DAY, "ANN LEE")], kinds.format("mortgagor_names"))
    buildings = spark.createDataFrame([(k,) for k in ("same", "other", "late", "odd", "blank", "none")], "bbl string")
    out = {r.bbl: (r.deed_id, r.mortgage_id, r.flagged, r.reason) for r in rules.mortgage_concealment(buildings.union(spark.createDataFrame([("gone",)], "bbl string")), buildings, deeds, loans).collect()}
    assert out == {
        "same": ("d1", "m1", False, None),
        "other": ("d3", "m2", True, None),
        "late": ("d4", None, None, "no_contemporaneous_mortgage"),
        "odd": ("d5", "m6", None, "unparseable_names"),
        "blank": ("d6", "m7", None, "no_deed_transfer"),
        "none": (None, None, None, "no_deed_transfer"),
        "gone": (None, None, None, "building_not_resolved"),
    }


def test_ownership_change(spark):
    deed = spark.createDataFrame([(b, "d" + b, date(2025, 7, 1), 1) for b in "abc"], "bbl string, event_id string, event_date date, amount long")
    start = date(2025, 7, 1) - timedelta(730)
    rows = [("a", start, "Closed"), ("a", start + timedelta(9), "Closed")] + [("a", date(2025, 8, k), "Open") for k in (1, 2, 3)] + [("b", date(2025, 8, 1), "Open")]
    out = {r.bbl: r for r in rules.ownership_change(violations(spark, rows), deed, str(DAY)).collect()}
    assert out["a"].signal and out["b"].signal and not out["c"].signal
    assert (out["a"].before, out["a"].after, out["a"].days_before, out["a"].days_after) == (2, 3, 730, 365)


def test_rent_stabilization(spark):
    rows = spark.createDataFrame([("a", 10, 7), ("b", None, 7), ("c", 7, 7)], "bbl string, first long, last long")
    out = {r.bbl: (r.change, r.deregulating) for r in rules.rent_stabilization(rows).collect()}
    assert out == {"a": (-3, True), "b": (None, False), "c": (0, False)}


def test_references(spark):
    refs = spark.createDataFrame([("x", "a", None), ("y", " ", "7"), ("z", None, None), ("a", "a", None), ("x", "gone", None)], "document string, by_id string, by_number string")
    docs = spark.createDataFrame([("a", "1"), ("c", "7"), ("b", "7")], "document string, number string")
    assert sorted((r.document, r.target) for r in relational.resolve_references(refs, docs).collect()) == [("x", "a"), ("y", "b")]


def test_versions_change_nothing_twice(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 4), ("d", 5)], "k string, v int")
    assert {r.k: r.action for r in relational.version_diff(old, new, "k", "v").collect()} == {"a": "close", "b": "keep", "c": "supersede", "d": "insert"}
    assert {r.action for r in relational.version_diff(new, new, "k", "v").collect()} == {"keep"}
    assert [tuple(r) for r in relational.set_once_upsert(old.withColumn("w", F.lit(1)), new.withColumn("w", F.lit(2)), "k", ["v"], ["w"]).orderBy("k").collect()] == [("a", 1, 1), ("b", 2, 2), ("c", 3, 2), ("d", 5, 2)]


def test_jaccard_best_match(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "q")], "id int, bbl string")
    b = spark.createDataFrame([(7, "x"), (8, "x"), (8, "y"), (8, "z"), (9, "q"), (9, "r")], "id int, bbl string")
    assert sorted((r.id, r.other, r.shared) for r in relational.best_jaccard(a, b).collect()) == [(1, 8, 2), (2, 9, 1)]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (4, 5), (6, 6), (None, 1), (10, 9), (9, 8), (8, 7), (7, 1)], "src int, dst int")
    assert {r.node: r.component for r in connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 10: 1, 4: 4, 5: 4, 6: 6}
    assert connected_components(edges.where("false")).count() == 0
