"""The corpus pipeline: quality filter, near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelgraph.llm import decontamination, neardup, packing, quality, util

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at least 0.5, learnt from the labelled ones among them.

    Every row is scored by its own text, repeated rows and null ids too; null texts are empty ones.
    With fewer than two labelled rows of a class every score is 0.5 and all rows stay. An empty
    table gives no rows; other columns than those of ``documents`` are dropped.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    model = quality.learn(docs, labels, ~held_out, shrinkage=0.001, fit_rows=100_000)
    return quality.apply(docs, model, COLUMNS).where("score >= 0.5").select(*COLUMNS)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near duplicates.

    Rows with a null id are in no component and stay; of rows that repeat a kept id and their text
    one stays. An id that repeats with different texts is one node: all its texts stay, or none.
    Null and empty texts link with nothing. An empty table gives no rows; other columns than those
    of ``documents`` are dropped.
    """
    groups = neardup.near_duplicates(docs, similarity=0.75, width=5)
    dropped = util.materialize(groups.where("doc_id is not null and not kept").select("doc_id").distinct(), "dropped")
    # few ids are sent to the texts, so that these stay where they are
    few = dropped.count() <= neardup.BROADCAST_IDS
    kept = docs.select(*COLUMNS).join(F.broadcast(dropped) if few else dropped, "doc_id", "left_anti")
    repeated = groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.isEmpty():
        once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(once)
    return kept.select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 75 % of the shingles of every test item.

    Rows are judged by id: of rows that repeat an id (null among them) all go if one holds an item.
    Null and empty texts hold nothing. Without items all rows stay; an empty table gives no rows;
    other columns than those of ``documents`` are dropped.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contaminated(docs, items, containment=0.75, width=5).select("doc_id").distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]), "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    Every row is packed, repeated ones and those with null ids too; a null text is an empty one and
    has the end's token alone. An empty table gives no rows.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_duplicate_filter", near_duplicate_filter),
    ("decontaminate", decontaminate),
    ("pack_sequences", pack_sequences),
]

#: SQL can neither fit the classifier nor encode the texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = util.materialize(docs, f"pipeline-{name}")
    return docs
