"""Rules as rows, look-ups that reach the files, counters of a write, agents."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from parcelgraph.operators import relational
from parcelgraph.plans import verdicts
from parcelgraph.sources import adapters, ingest

FACTS = "bbl string, open_c long, oldest_days int"


def judged(rule, facts):
    return {r.subject: (r.verdict, r.reason, r.text) for r in verdicts.compile_rule(rule, facts).collect()}


def test_a_row_decides(spark):
    facts = spark.createDataFrame([("a", 3, 200), ("b", 2, 500), ("c", None, None)], FACTS)
    rule = next(r for r in verdicts.RULES if r.name == "PHC-001")
    assert judged(rule, facts) == {"a": (True, None, "3 open class C violations, the oldest for 200 days"), "b": (False, None, None), "c": (False, None, None)}
    assert {k: v[0] for k, v in judged(rule.where(least=2, days=400), facts).items()} == {"a": False, "b": True, "c": False}
    # the same change made to the table's row
    table = verdicts.rule_table(spark).where("name = 'PHC-001'").withColumn("thresholds", F.map_concat(F.map_filter("thresholds", lambda k, v: k != "least"), F.create_map(F.lit("least"), F.lit(2.0))))
    changed = verdicts.from_table(table)[0]
    assert {k: v[0] for k, v in judged(changed, facts).items()} == {"a": True, "b": True, "c": False}
    assert verdicts.compile_rule(changed, facts).first().statement.startswith("at least 2 open class C")
    assert verdicts.from_table(verdicts.rule_table(spark)) == verdicts.RULES


def test_the_first_reason_counts(spark):
    rule = verdicts.Rule("R", "R", "bbl", "f", "open_c > :k", "s", "t", {"k": 1}, (("open_c is null", "no_count"), ("oldest_days is null", "no_days_{open_c}_:k")))
    facts = spark.createDataFrame([("a", None, None), ("b", 5, None), ("c", 5, 1)], FACTS)
    assert {k: v[:2] for k, v in judged(rule, facts).items()} == {"a": (None, "no_count"), "b": (None, "no_days_5_1"), "c": (True, None)}
    assert verdicts.evaluate((rule, verdicts.replace(rule, deprecated=True)), lambda name: facts).count() == 3


def test_the_catalogue():
    ids = [r.rule_id for r in verdicts.RULES]
    assert ids == [f"RUL-{k:05d}" for k in range(1, 18)] and len(verdicts.QUESTIONS) == 18
    names = {r.name for r in verdicts.RULES}
    assert all(set(q[1].split("|")) - {""} <= names for q in verdicts.QUESTIONS)


def test_a_look_up_reaches_the_files(spark):
    found = adapters.violations_of(spark, "/root/testdata/sf0.001", "0000000005")
    everyone = adapters.violations(spark, "/root/testdata/sf0.001").where("bbl = '0000000005'")
    assert sorted(map(str, found.collect())) == sorted(map(str, everyone.collect())) != []
    plan = found._jdf.queryExecution().toString()
    assert "EqualTo(o_custkey,5)" in plan and "In(l_orderkey," in plan
    assert adapters.violations_of(spark, "/root/testdata/sf0.001", "x").count() == 0
    joined = adapters.violations_of(spark, "/root/testdata/sf0.001", "0000000005", listed=1)
    assert sorted(map(str, joined.collect())) == sorted(map(str, found.collect()))


def test_counters_are_observed_in_the_write(spark, tmp_path):
    events = spark.createDataFrame([("a", 1), ("a", None), ("b", 1), (None, 1)], "bbl string, v int").repartition(3)
    counts = Observation()
    relational.counted_known(events, spark.createDataFrame([("a",)], "bbl string"), counts, F.col("v").isNull()).write.parquet(f"{tmp_path}/out")
    assert counts.get == {"processed": 4, "missing": 2, "skipped": 1, "written": 1}
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("a", 1)]


def test_instruments_name_their_parties(spark):
    master = spark.createDataFrame([("d1", "1", "MTGE", None), ("d2", "2", "ASST", None), ("d3", "3", "SAT", None)], "documentid string, crfn string, doctype string, modifieddate date")
    master = master.withColumns({"docdate": F.lit(None).cast("date"), "recordedfiled": F.lit("2020-01-01").cast("date"), "reelyear": F.lit(1)})
    parties = spark.createDataFrame([("d1", 1, "B"), ("d1", 1, "A"), ("d1", 2, "Bank"), ("d2", 1, "Old"), ("d2", 2, "New")], "documentid string, partytype int, name string")
    events, _ = ingest.mortgage_instruments(master, spark.createDataFrame([("d1", "x")], "documentid string, bbl string"), ingest.EVIDENTIARY, parties)
    got = {r.source_record_id: (r.mortgagor_names, r.mortgagee_names, r.assignor_names, r.assignee_names) for r in events.collect()}
    assert got == {"d1": ("A | B", "Bank", None, None), "d2": (None, None, "Old", "New"), "d3": (None, None, None, None)}


def test_agents_manage_known_buildings(spark):
    found = spark.createDataFrame([("MGT-1", "Ann", "1 ST", ["a", "b"]), ("MGT-2", "Bo", "2 ST", ["z"])], "agent_id string, name string, address string, bbls array<string>")
    rel, seen = ingest.managed_by(found, spark.createDataFrame([("a",), ("a",), ("c",)], "bbl string"), "SRC-X", "2020-01-02")
    assert [(r.agent_id, r.bbl, r.type) for r in rel.collect()] == [("MGT-1", "a", "ManagedBy")]
    assert sorted((r.agent_id, r.raw_name, r.context, r.n_bbls) for r in seen.collect()) == [("MGT-1", "Ann", "1 ST", 2), ("MGT-2", "Bo", "2 ST", 1)]
