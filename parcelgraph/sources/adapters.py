"""The domain's tables as views over the star schema that exists here.

Each function returns a lazy DataFrame; filters and column choices made on it reach the scans.
``SQL`` has the same views as common table expressions for DuckDB.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelgraph.sources.shared import shared_dir, write

#: The views that :func:`written_once` holds while it is open, by their folder.
_WRITTEN: dict[str, dict[str, DataFrame]] = {}

#: All ages are measured to this date; nothing asks the clock.
AS_OF = "2001-12-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bbl, borough, units, dof_owner."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", "r_name")
    # 25 rows of a fixed table
    return table(spark, sf_dir, "customer").join(F.broadcast(named), F.col("c_nationkey") == F.col("n_nationkey")).select(F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("bbl"), F.col("r_name").alias("borough"), (F.col("c_custkey") % 50 + 1).alias("units"), F.col("c_name").alias("dof_owner"))


def latest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line of each (order, number): the last shipped, ties by the other columns."""
    return _last_lines(table(spark, sf_dir, "lineitem"))


def _last_lines(lines: DataFrame) -> DataFrame:
    rest = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_quantity", "l_returnflag", "l_linestatus"]
    last = F.max(F.struct(*rest)).alias("last")
    return lines.groupBy("l_orderkey", "l_linenumber").agg(last).select("l_orderkey", "l_linenumber", "last.*")


def _class() -> F.Column:
    return F.create_map(*[F.lit(x) for x in ("A", "A", "N", "B", "R", "C")])[F.col("l_returnflag")]


def ordered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest lines with their order's customer and date."""
    if sf_dir in _WRITTEN:
        return _WRITTEN[sf_dir]["lines"]
    return _with_orders(latest_lines(spark, sf_dir), table(spark, sf_dir, "orders"))


def written_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`ordered_lines` as a table in the shared folder, for queries that use them several times."""
    return write(ordered_lines(spark, sf_dir), f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}")


@contextmanager
def written_once(spark: SparkSession, sf_dir: str) -> Iterator[None]:
    """Within it all views of lines with their orders, and of control, read one written table each,
    which plans made here still do afterwards: for queries that ask many questions of them."""
    lines = ordered_lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "o_custkey", "o_orderdate", "l_partkey", "l_shipdate", "l_returnflag", "l_linestatus", "l_extendedprice", "l_discount")
    made = {"lines": lines, "control": control(spark, sf_dir)}
    before = _WRITTEN.get(sf_dir)
    _WRITTEN[sf_dir] = {name: write(rows, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}") for name, rows in made.items()}
    try:
        yield
    finally:
        _WRITTEN.pop(sf_dir)
        if before is not None:
            _WRITTEN[sf_dir] = before


def _with_orders(lines: DataFrame, orders: DataFrame) -> DataFrame:
    return lines.join(orders.select("o_orderkey", "o_custkey", "o_orderdate"), lines["l_orderkey"] == orders["o_orderkey"])


def violations(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """event_id, bbl, open_date, status_date, violation_class, status."""
    return _violations(ordered_lines(spark, sf_dir) if lines is None else lines)


def _violations(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.concat_ws("-", F.lit("EVT-HPD"), "l_orderkey", "l_linenumber").alias("event_id"),
        F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("bbl"),
        F.to_date("o_orderdate").alias("open_date"),
        F.to_date("l_shipdate").alias("status_date"),
        _class().alias("violation_class"),
        F.when(F.col("l_linestatus") == "O", "Open").otherwise("Closed").alias("status"),
    )


def key_number(bbl: str) -> int | None:
    """The number that a key is computed from; None for texts that are no key."""
    return int(bbl) if len(bbl) == 10 and bbl.isdigit() else None


def violations_of(spark: SparkSession, sf_dir: str, bbl: str, listed: int = 10_000) -> DataFrame:
    """:func:`violations` of one building, asked by the columns that its key is computed from.

    The building's orders are found by their customer and its lines by those orders, as conditions on
    columns that the files hold, so files sorted by them skip what can't match. A building of more
    than ``listed`` orders is joined instead.
    """
    number = key_number(bbl)
    orders = table(spark, sf_dir, "orders").where(F.lit(False) if number is None else F.col("o_custkey") == number).select("o_orderkey", "o_custkey", "o_orderdate")
    keys = [r[0] for r in orders.select("o_orderkey").distinct().limit(listed + 1).collect()]
    lines = table(spark, sf_dir, "lineitem")
    mine = lines.where(F.col("l_orderkey").isin(keys)) if len(keys) <= listed else lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return _violations(_with_orders(_last_lines(mine), orders))


def judgments(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """bbl, penalty, paid, balance, in whole cents so that sums are exact."""
    penalty = F.round(F.col("l_extendedprice") * 100).cast("long")
    percent = F.round(F.col("l_discount") * 100).cast("long")
    made = (ordered_lines(spark, sf_dir) if lines is None else lines).where("l_returnflag = 'N'")
    made = made.select(F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("bbl"), penalty.alias("penalty"), F.floor(penalty * (100 - percent) / 100).alias("paid"))
    return made.withColumn("balance", F.col("penalty") - F.col("paid"))


def filings(spark: SparkSession, sf_dir: str, status: str, prefix: str) -> DataFrame:
    """event_id, bbl, event_date, amount (cents) of the orders of one status."""
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).select(F.concat_ws("-", F.lit(prefix), "o_orderkey").alias("event_id"), F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("bbl"), F.to_date("o_orderdate").alias("event_date"), F.round(F.col("o_totalprice") * 100).cast("long").alias("amount"))


def control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """actor_id, bbl: the supplier of most lines of a customer, ties to the smaller key."""
    if sf_dir in _WRITTEN:
        return _WRITTEN[sf_dir]["control"]
    lines, orders = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    counted = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("n"))
    return counted.groupBy("o_custkey").agg(F.max_by("l_suppkey", F.struct("n", -F.col("l_suppkey"))).alias("l_suppkey")).select(F.col("l_suppkey").alias("actor_id"), F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("bbl"))


def landlords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nodeid, name, street, apt, zip."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("nodeid"), F.col("p_name").alias("name"), F.concat_ws(" ", F.col("p_size").cast("string"), F.lower("p_type")).alias("street"), F.regexp_replace("p_brand", r"\D", "").alias("apt"), F.col("p_size").cast("string").alias("zip"))


SQL = """
building AS (SELECT lpad(c_custkey::VARCHAR, 10, '0') AS bbl, r_name AS borough, c_custkey % 50 + 1 AS units, c_name AS dof_owner
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
line AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_discount DESC, l_quantity DESC, l_returnflag DESC, l_linestatus DESC) = 1),
violation AS (SELECT 'EVT-HPD-' || l_orderkey || '-' || l_linenumber AS event_id, lpad(o_custkey::VARCHAR, 10, '0') AS bbl, o_orderdate::DATE AS open_date, l_shipdate::DATE AS status_date,
  CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'B' WHEN 'R' THEN 'C' END AS violation_class, CASE WHEN l_linestatus = 'O' THEN 'Open' ELSE 'Closed' END AS status
  FROM line JOIN orders ON l_orderkey = o_orderkey),
judgment AS (SELECT bbl, penalty, penalty * (100 - percent) // 100 AS paid, penalty - penalty * (100 - percent) // 100 AS balance FROM (
  SELECT lpad(o_custkey::VARCHAR, 10, '0') AS bbl, round(l_extendedprice * 100)::BIGINT AS penalty, round(l_discount * 100)::BIGINT AS percent FROM line JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'N')),
deed AS (SELECT 'DEED-' || o_orderkey AS event_id, lpad(o_custkey::VARCHAR, 10, '0') AS bbl, o_orderdate::DATE AS event_date, round(o_totalprice * 100)::BIGINT AS amount FROM orders WHERE o_orderstatus = 'F'),
mortgage AS (SELECT 'MTGE-' || o_orderkey AS event_id, lpad(o_custkey::VARCHAR, 10, '0') AS bbl, o_orderdate::DATE AS event_date, round(o_totalprice * 100)::BIGINT AS amount FROM orders WHERE o_orderstatus = 'P'),
filing AS (SELECT 'LIT-' || o_orderkey AS event_id, lpad(o_custkey::VARCHAR, 10, '0') AS bbl, o_orderdate::DATE AS event_date, round(o_totalprice * 100)::BIGINT AS amount FROM orders WHERE o_orderstatus = 'O'),
control AS (SELECT l_suppkey AS actor_id, lpad(o_custkey::VARCHAR, 10, '0') AS bbl FROM (SELECT o_custkey, l_suppkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, l_suppkey) = 1),
landlord AS (SELECT p_partkey AS nodeid, p_name AS name, p_size || ' ' || lower(p_type) AS street, regexp_replace(p_brand, '\\D', '', 'g') AS apt, p_size::VARCHAR AS zip FROM part),
phc AS (SELECT bbl, count(*) AS open_c, min(open_date) AS oldest FROM violation WHERE violation_class = 'C' AND status = 'Open' AND open_date IS NOT NULL
  GROUP BY bbl HAVING count(*) >= 3 AND DATE '2001-12-31' - min(open_date) > 180)"""
