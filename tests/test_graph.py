from datetime import date

from pyspark.sql import functions as F

from parcelgraph.operators import portfolio, provenance
from parcelgraph.plans import rules
from parcelgraph.streaming import incremental


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_two_hops_takes_the_shortest(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 3), (5, 5)], "src long, dst long")
    out = provenance.within_two_hops(edges, spark.createDataFrame([(1,), (5,)], "node long"))
    assert rows(out, "start", "node", "hops") == [(1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2), (5, 5, 0)]


def test_lineage_needs_record_and_source(spark):
    claims = spark.createDataFrame([("c1", "b1", "r")], "claim_id string, subject_id string, rule_id string")
    cited = spark.createDataFrame([("c1", ["e1", "e2"])], "claim_id string, event_ids array<string>")
    events = spark.createDataFrame([("e1", "1", "SRC-HPD"), ("e2", "1", "SRC-DOB")], "event_id string, source_record_id string, source_id string")
    observed = provenance.observations(events.where("event_id = 'e1'"), "SRC-HPD")
    out = provenance.claim_lineage(claims, cited, events, observed, provenance.sources(spark, ["HPD", "DOB"], "2020-01-02"))
    assert rows(out, "event_id", "source_name", "retrieval_date") == [("e1", "HPD", date(2020, 1, 2))]


def test_roll_up(spark):
    members = spark.createDataFrame([(1, 1, "x"), (2, 1, "y"), (3, 1, "y"), (4, 4, "z"), (5, 5, "q")], "nodeid long, community long, name string")
    held = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "c"), (4, "d")], "nodeid long, bbl string")
    names = spark.createDataFrame([(1, 2, 1.0), (1, 3, 3.0)], "src long, dst long, weight double")
    addresses = spark.createDataFrame([(2, 3, 9.0)], "src long, dst long, weight double")
    out = portfolio.roll_up(members, held, portfolio.node_averages(names, addresses)).collect()
    assert [(r.community, r.nodes, r.name_edges, r.address_edges, r.weight, r.anchor, r.name, r.n_bbls, r.bridge) for r in out] == [(1, 3, 2, 1, 2.0, 2, "y", 3, True)]
    linked = portfolio.with_connections(members.select("nodeid"), names, addresses).where("nodeid = 2").first()
    assert [(x.nodeid, x.weight) for x in linked.name_match_info] == [(1, 1.0)] and [x.nodeid for x in linked.bizaddr_match_info] == [3]


def test_recluster_leaves_out_the_hub(spark):
    contacts = spark.createDataFrame([("b1", "HeadOfficer", "Ann", "hub", "1"), ("b2", "Officer", " ann", "hub", "1"), ("b3", "Agent", "Ann", "9 St", "2"), ("b4", "Agent", "Bo", "9 st", "2"), ("b5", "Agent", "Cy", "hub", "1")], "bbl string, role string, name string, address string, zip string")
    links, components = portfolio.recluster(contacts, F.col("address") == "hub")
    assert rows(links, "src", "dst", "weight", "kind") == [("b1", "b2", 1.5, "name"), ("b3", "b4", 2.0, "address")]
    assert rows(components, "bbl", "component") == [("b1", "b1"), ("b2", "b1"), ("b3", "b3"), ("b4", "b3")]


def test_stubs_and_look_ups(spark):
    known = spark.createDataFrame([("1", " ", None, 5), ("2", "A", "Bronx", 6)], "bbl string, address string, borough string, units long")
    seen = spark.createDataFrame([("1", "B", "Queens"), ("2", "C", "Queens"), ("3", "D", None)], "bbl string, address string, borough string")
    assert rows(provenance.stub_upsert(known, seen), "bbl", "address", "borough", "units") == [("1", "B", "Queens", 5), ("2", "A", "Bronx", 6), ("3", "D", None, None)]
    actors = spark.createDataFrame([(1, "ANN LEE"), (2, "Joanna"), (3, None)], "actor_id long, name string")
    assert [r.actor_id for r in rules.resolve_actor(actors, "Ann").collect()] == [2, 1]


def test_an_upsert_that_broke_off_leaves_the_version_before(spark, tmp_path):
    path, src = f"file://{tmp_path}/table", str(tmp_path / "in")
    schema = "k long, address string, score long, at long"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    run = lambda checkpoint: incremental.keyed_upsert(spark.readStream.schema(schema).parquet(src), path, str(tmp_path / checkpoint), "k", ["address"], ["score"], "at").awaitTermination()
    put([(1, "a", 1, 1), (1, "b", 2, 2)])
    run("c")
    assert rows(incremental.current(spark, path), "k", "address", "score") == [(1, "b", 2)]
    put([(1, "c", 3, 3), (2, "d", 1, 1)])
    run("c")
    assert rows(incremental.current(spark, path), "k", "address", "score") == [(1, "b", 3), (2, "d", 1)]
    # what a writer left before its commit is not seen, and a batch that is run again changes nothing
    (tmp_path / "table" / "versions" / "draft-x").write_text("{")
    run("fresh")
    assert rows(incremental.current(spark, path), "k", "address", "score") == [(1, "b", 3), (2, "d", 1)]
