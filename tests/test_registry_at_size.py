"""Queries over keys and groups larger than those of the given tables, against their SQL."""

import os
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from parcelgraph.operators import components, ontology, relational
from parcelgraph.operators.components import connected_components
from parcelgraph.plans import portfolio_registry

DIR = "/root/testdata/sf0.001"
TABLES = ("customer", "supplier", "part", "orders", "lineitem", "nation", "region")


@pytest.fixture
def copied(tmp_path):
    """Makes a copy of the star schema in which the tables named are what a query makes of them."""

    def make(**changed):
        for name in TABLES:
            if name in changed:
                duckdb.sql(f"COPY ({changed[name].replace('{}', f"'{DIR}/{name}.parquet'")}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
            else:
                os.symlink(f"{DIR}/{name}.parquet", tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return make


def wanted(folder, name):
    with duckdb.connect() as c:
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        found = c.execute(entry.oracle_sql()[name])
        columns = [x[0] for x in found.description]
        return columns, Counter(found.fetchall())


def check(spark, folder, name):
    columns, rows = wanted(folder, name)
    found = entry.queries()[name](spark, folder)
    assert sorted(found.columns) == sorted(columns) and rows
    assert Counter(tuple(r) for r in found.select(*columns).collect()) == rows


def test_keys_of_parts_are_cut_as_the_question_cuts_them(spark, copied):
    """blocks of more than five digits."""
    check(spark, copied(customer="SELECT c_custkey + k * 300000 AS c_custkey, * EXCLUDE (c_custkey, k) FROM {}, range(4) t(k)"), "bbl_normalize")


def jobs_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_claims_need_no_jobs_a_round(spark):
    """the rounds of Louvain were about ten jobs each."""
    run = lambda: entry.queries()["portfolio_claims"](spark, "/root/testdata/sf0.01").collect()
    assert jobs_of(spark, "claims", run) < 200


def test_connections_list_all_others(spark, copied):
    """the lists of linked nodes, not their numbers alone."""
    folder = copied(part="SELECT p_partkey + k * 200 AS p_partkey, * EXCLUDE (p_partkey, k) FROM {}, range(7) t(k)")
    check(spark, folder, "landlords_with_connections")
    row = entry.queries()["landlords_with_connections"](spark, folder).where("nodeid = 3").first()
    assert len(row["names"].split(",")) == row.n_names >= 6 and len(row.addresses.split(",")) == row.n_addresses >= 6


def test_name_pairs_are_made_of_classes(spark, copied, monkeypatch):
    """equal nodes are compared once, and make their pairs afterwards."""
    folder = copied(part="SELECT p_partkey + k * 200 AS p_partkey, * EXCLUDE (p_partkey, k) FROM {}, range(7) t(k)")
    monkeypatch.setattr(relational, "CHUNK", 3)
    check(spark, folder, "name_edges")
    part = spark.read.parquet(f"{folder}/part.parquet").withColumnRenamed("p_partkey", "nodeid")
    classes = relational.node_classes(part, ["p_name", "p_size", "p_type", "p_brand"])
    assert part.count() == 1400 and classes.count() == 600 and classes.selectExpr("sum(size(ids)) AS n").first().n == 1400


def test_address_pairs_are_made_of_classes(spark, copied, monkeypatch):
    """the similarity of names is computed once for equal nodes, so the join is one of their classes."""
    folder = copied(part="SELECT p_partkey + k * 200 AS p_partkey, * EXCLUDE (p_partkey, k) FROM {}, range(7) t(k)")
    monkeypatch.setattr(relational, "CHUNK", 3)
    check(spark, folder, "address_edges")
    assert "collect_list" in entry.queries()["address_edges"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()


def test_best_match_sends_lists_and_not_pairs(spark, copied):
    """pairs are counted where their left set is, without an exchange of them."""
    lines = "SELECT l_orderkey, l_partkey % 40 + k * 200 AS l_partkey, l_suppkey + k * 10 AS l_suppkey, * EXCLUDE (l_orderkey, l_partkey, l_suppkey, k) FROM {}, range(3) t(k)"
    folder = copied(lineitem=f"SELECT * REPLACE (CASE WHEN l_suppkey % 10 = 3 THEN NULL ELSE l_partkey END AS l_partkey) FROM ({lines})")
    check(spark, folder, "jaccard_best_match")
    plan = entry.queries()["jaccard_best_match"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in plan and not re.search(r"hashpartitioning\(id#\d+L?, other", plan)


def test_claims_lie_in_buckets_of_bounded_size(spark, monkeypatch):
    """F8: the number of buckets grows with the events."""
    seen = []
    apply = portfolio_registry.deltas.apply_batch
    monkeypatch.setattr(portfolio_registry.deltas, "apply_batch", lambda *a, **k: seen.append(k["buckets"]) or apply(*a, **k))
    monkeypatch.setattr(portfolio_registry, "BUCKET_ROWS", 400)
    check(spark, DIR, "incremental_claims")
    assert len(set(seen)) == 1 and seen[0] > 8


def test_lines_are_prepared_once_for_network_verdicts(spark):
    """every question of the lines deduplicated and joined them again."""
    check(spark, DIR, "network_verdicts")
    plan = entry.queries()["network_verdicts"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") <= 2 and "lines-" in plan


def test_lines_are_prepared_once_for_graph_checks(spark):
    """every question of the lines deduplicated and joined them again."""
    check(spark, DIR, "graph_checks")
    plan = entry.queries()["graph_checks"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") <= 0 and "lines-" in plan


def test_lines_are_prepared_once_for_building_verdicts(spark):
    """every question of the lines deduplicated and joined them again."""
    check(spark, DIR, "building_verdicts")
    plan = entry.queries()["building_verdicts"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") <= 1 and "lines-" in plan


def test_owners_names_read_the_written_lines(spark):
    """one of the rules, that of owners' names, deduplicated all lines once more and joined their orders."""
    plan = entry.queries()["building_verdicts"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan


def test_components_of_stars_need_one_round(spark):
    """the rounds of components; edges that a task holds are contracted before them."""
    rows = [(k, k + 1) for k in range(300)] + [(1000 + k, 1000 + 7 * k % 90) for k in range(90)] + [(5000, 5000), (None, 3)]
    edges = spark.createDataFrame(rows, "src long, dst long")
    as_set = lambda df: {tuple(r) for r in df.collect()}
    for n in (1, 5):
        assert as_set(connected_components(edges.repartition(n), contract=True)) == as_set(connected_components(edges.repartition(n)))
    one = edges.coalesce(1)
    assert jobs_of(spark, "contracted", lambda: connected_components(one, contract=True).collect()) < jobs_of(spark, "rounds", lambda: connected_components(one).collect()) / 2


def test_claims_need_few_jobs(spark):
    """a hundred small jobs took longer than their work."""
    run = lambda: entry.queries()["portfolio_claims"](spark, "/root/testdata/sf0.01").collect()
    assert jobs_of(spark, "few-claims", run) < 90


def test_checks_of_the_graph_leave_no_pair_or_link_out(spark, copied):
    """affiliations were those of suppliers 25 keys apart, and evidence the first 50 events of a claim."""
    lines = "SELECT * REPLACE ('R' AS l_returnflag, 'O' AS l_linestatus, CASE WHEN l_linenumber = 2 THEN l_shipdate + INTERVAL 90 DAY ELSE l_shipdate END AS l_shipdate) FROM {}"
    supplier = "SELECT s_suppkey + k * 10 AS s_suppkey, s_nationkey % 3 AS s_nationkey, * EXCLUDE (s_suppkey, s_nationkey, k) FROM {}, range(4) t(k)"
    folder = copied(orders="SELECT * REPLACE (o_custkey % 9 + 1 AS o_custkey) FROM {}", lineitem=lines, supplier=supplier)
    check(spark, folder, "graph_checks")
    found = {r.name[:3]: r.n for r in entry.queries()["graph_checks"](spark, folder).collect()}
    nations = Counter(r[0] for r in duckdb.sql(f"SELECT s_nationkey FROM '{folder}/supplier.parquet'").fetchall())
    assert found["C08"] == sum(n * (n - 1) // 2 for n in nations.values()) > 0
    late = "SELECT count(*) FROM (SELECT l_orderkey, l_linenumber, max(l_shipdate) AS seen FROM '{0}/lineitem.parquet' GROUP BY ALL) JOIN '{0}/orders.parquet' ON l_orderkey = o_orderkey WHERE seen::DATE - o_orderdate::DATE > 60"
    assert found["C03"] == duckdb.sql(late.format(folder)).fetchall()[0][0] > 50 * 9


def test_pairs_are_counted_as_they_are_made(spark):
    """repeated and missing keys too."""
    rows = [(k % 7 if k % 11 else None, k % 3 if k % 5 else None) for k in range(60)]
    found = {r.component: r.pairs for r in ontology.affiliation_counts(spark.createDataFrame(rows, "actor_id long, component long")).collect()}
    whole = [(a, c) for a, c in rows if a is not None and c is not None]
    assert found == Counter(c for a, c in whole for b, d in whole if c == d and a < b)


def test_one_task_ends_the_rounds_of_components(spark, monkeypatch):
    """edges that fit a task went through five rounds of joins."""
    rows = [(k, (k * 7919 + 13) % 5000) for k in range(0, 5000, 2)] + [(9000 + k, 9001 + k) for k in range(200)] + [(7, 7), (8000, 8000), (None, 3)]
    edges = spark.createDataFrame(rows, "src long, dst long").repartition(6)
    found = lambda **how: {tuple(r) for r in connected_components(edges, **how).collect()}
    jobs, whole = jobs_of(spark, "one-task", lambda: found(contract=True)), found(contract=True)
    assert whole == found()
    monkeypatch.setattr(components, "LAST_EDGES", 0)
    assert found(contract=True) == whole and jobs < jobs_of(spark, "rounds-of-joins", lambda: found(contract=True)) / 1.5
