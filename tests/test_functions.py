import uuid

from pyspark.sql import functions as F

from parcelgraph.functions import keys, text
from parcelgraph.plans import rules


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


def test_keys(spark):
    c = [F.col(x) for x in ("k", "b", "bl", "l")]
    assert one(spark, keys.normalize_key(*c), k="  1000010001 ", b=None, bl=None, l=None) == "1000010001"
    assert one(spark, keys.normalize_key(*c), k="", b="2", bl="12", l="3") == "2000120003"
    assert one(spark, keys.normalize_key(*c), k="", b="2", bl="12", l=None) is None
    assert one(spark, keys.normalize_key_valid(*c), k="0", b="3", bl="45", l="6") == "3000450006"
    assert one(spark, keys.normalize_key_blank_only(*c), k="0", b="3", bl="45", l="6") == "0"
    assert one(spark, keys.zero_fill(F.col("k"), 5), k="123456") == "123456"
    assert one(spark, keys.borough_of(F.col("k")), k="3000450006") == "Brooklyn"
    assert one(spark, keys.borough_of(F.col("k")), k="9") is None
    assert one(spark, keys.event_id("HPD", F.col("k"), F.col("b")), k="1", b=None) == "EVT-HPD-1-None"


def test_status_and_names(spark):
    k = F.col("k")
    for given, expected in (("V*-DOB VIOLATION - DISMISSED", "Dismissed"), ("V*-DOB VIOLATION - Resolved", "Resolved"), ("VH-VIOLATION - ACTIVE", "Active"), ("V%-DOB VIOLATION", None)):
        assert one(spark, text.status_by_keyword(k, text.DOB_KEYWORDS), k=given) == expected
    assert one(spark, text.mapped(k, text.HPD_STATUS, "Unknown"), k="Close") == "Closed"
    assert one(spark, text.mapped(k, text.HPD_STATUS, "Unknown"), k=None) == "Unknown"
    assert sorted(one(spark, text.name_tokens(k), k="O'NEIL & SONS, LLC")) == ["LLC", "NEIL", "SONS"]
    assert [one(spark, text.looks_corporate(k), k=n) for n in ("ABE LINCOLN", "RALPH KING", "JOHN SMITH")] == [True, True, False]
    assert one(spark, text.without_legal_suffix(k), k=" Main St Realty, L.L.C. ") == "MAIN ST REALTY"
    assert one(spark, text.lookup_address(k), k="530 East 169th Street") == "530 EAST 169 STREET"
    assert one(spark, text.joined_address(k, F.col("b")), k=" 1 A St ", b=" ") == "1 A St"
    house, street = text.split_address(k)
    assert (one(spark, house, k="12 MAIN ST"), one(spark, street, k="12 MAIN ST")) == ("12", "MAIN ST")


def test_identifiers_and_similarity(spark):
    assert one(spark, text.uuid5(F.col("k")), k="A||B") == str(uuid.uuid5(uuid.NAMESPACE_DNS, "A||B"))
    assert abs(one(spark, text.trigram_similarity(F.col("k"), F.col("b")), k="word", b="two words") - 0.363636) < 1e-5
    assert one(spark, text.trigram_similarity(F.col("k"), F.col("b")), k="word", b=None) is None
    sets = spark.createDataFrame([([], [], 1.0), (["a", "b"], ["b", "c"], 1 / 3), (["a"], ["a", "b"], 0.5)], "a array<string>, b array<string>, x double")
    assert all(abs(r.j - r.x) < 1e-12 for r in sets.select(text.jaccard(F.col("a"), F.col("b")).alias("j"), "x").collect())


def test_code_pairs(spark):
    pairs = [(F.col("a"), F.col("b")), (F.col("c"), F.col("d"))]
    assert len(one(spark, text.code_pairs(pairs), a="1", b="x", c=None, d=" ")) == 1
    assert one(spark, text.code_text(pairs), a="1", b="x  y", c=None, d="z") == "1 x y"
    assert one(spark, text.code_text(pairs), a=None, b="x", c=None, d=None) is None
    address, name = text.edge_counts(F.col("k"))
    assert (one(spark, address, k="linked by 4 address-based and 2 name-based"), one(spark, name, k="nothing")) == (4, 0)


def test_thresholds(spark):
    rows = spark.createDataFrame([(11, 2.6, False, "", "High"), (11, 2.5, False, "", "Medium"), (2, 3.0, False, "", "Low"), (20, 1.4, False, "", "Low"), (50, 3.0, False, "no_meaningful_split", "Low")], "e int, w double, b boolean, r string, x string")
    assert all(r.c == r.x for r in rows.select(rules.confidence(F.col("e"), F.col("w"), F.col("b"), F.col("r")).alias("c"), "x").collect())
    rows = spark.createDataFrame([(2, 0, 1, "Medium", False), (2, 1, 0, "Medium", True), (2, 0, 2, "High", True), (5, 9, 9, "Low", False)], "n int, a int, m int, s string, x boolean")
    assert all(r.c == r.x for r in rows.select(rules.meets_claim_threshold(F.col("n"), F.col("a"), F.col("m"), F.col("s")).alias("c"), "x").collect())
    rows = spark.createDataFrame([(2, 0, True), (1, 0, False), (10, 1, False), (11, 1, True)], "a int, n int, x boolean")
    assert all(r.c == r.x for r in rows.select(rules.concealment_flag(F.col("a"), F.col("n")).alias("c"), "x").collect())
