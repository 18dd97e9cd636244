"""The queries of this subpackage: one per operator and the pipeline, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), similarity=0.75, width=5)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), containment=0.75, width=5)


#: Distinct five-word shingles of a text, or the whole text with fewer words.
_SHINGLES = """
{1} AS (SELECT DISTINCT id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT {2} AS id, [x for x in regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') if x <> ''] AS w FROM {0}),
    unnest(range(1, greatest(len(w) - 3, 2))) AS r(i) WHERE len(w) > 0)"""

OP9_SQL = f"""
WITH {_SHINGLES.format("documents", "d", "doc_id")}, {_SHINGLES.format("benchmark", "b", "item_id")},
n AS (SELECT id, count(*) AS n FROM b GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, any_value(n.n) AS n_item_shingles, count(*) AS n_shared
FROM d JOIN b ON d.s = b.s JOIN n ON n.id = b.id GROUP BY d.id, b.id HAVING 100 * count(*) >= 75 * any_value(n.n)"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), limit=512)


def _remainder(n: int) -> Column:
    """crc32 of the document's id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_tree import score_texts

    held_out = _remainder(7) == 2
    made = score_texts(_table(spark, sf_dir, "documents"), ~held_out)
    return made.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    said = "</s>[INST] ok [/INST]"
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], table.schema)
    made = chat.format_conversations(table.unionByName(more))
    turns = F.transform(chat.read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    return made.select("conv_id", turns.alias("turns"), loss.alias("loss"), "formatted").select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: Characters that escaping adds to a text: see chat.escape.
_ADDED = """(length({0}) - length(replace({0}, chr(92), ''))) + (length({0}) - length(replace(replace(replace(replace(replace({0}, '<s', ''), '</', ''), '<|', ''), '[I', ''), '[/', ''))) // 2
 + (length({0}) - length(replace({0}, '<', '')) - len(regexp_extract_all({0}, '<+'))) + ends_with({0}, '<')::int + ends_with({0}, '[')::int"""

OP2_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    7 + sum(16 + length(role) + length(text) + {_ADDED.format("text")} + {_ADDED.format("role")} + length(role) - length(replace(role, chr(10), ''))) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars
FROM c"""


def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    made = shard_by_bytes(_table(spark, sf_dir, "documents"), shards=40, tolerance=0.005)
    return made.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    held_out = _remainder(3) == 1
    made = score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ~held_out, shrinkage=0.001)
    return made.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_collision_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collisions import link_vectors

    return link_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.98)


OP5_SQL = """
WITH RECURSIVE unit AS (
  SELECT vec_id, label, [x::DOUBLE for x in embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, least(e.vec_id, coalesce(l.m, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(l.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN degree d ON d.a = e.vec_id LEFT JOIN low l ON l.a = e.vec_id"""


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .extraction import extract

    made = extract(_table(spark, sf_dir, "pages"))
    return made.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), capacity=2048, end_id=1)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import util
    from .alignment import aligned

    with aligned(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model")) as made:
        digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
        return util.materialize(made.withColumn("groups_sha256", digest).drop("groups"), "alignment")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    held_out = _remainder(5) == 0
    made = score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ~held_out)
    return made.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP13_SQL = """
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    [x for x in regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if x <> ''] AS words
  FROM documents),
flags AS (
  SELECT w.part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e,
    coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
  FROM w LEFT JOIN (SELECT doc_id AS id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id) l ON l.id = w.doc_id),
kinds AS (SELECT *, count(*) AS n FROM flags GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT p.f || q.f || r.f || s.f || t.f AS o FROM letters p, letters q, letters r, letters s, letters t
  WHERE p.f NOT IN (q.f, r.f, s.f, t.f) AND q.f NOT IN (r.f, s.f, t.f) AND r.f NOT IN (s.f, t.f) AND s.f <> t.f),
gone AS (
  SELECT *, least(if(a, strpos(o, 'A'), 6), if(b, strpos(o, 'B'), 6), if(c, strpos(o, 'C'), 6), if(d, strpos(o, 'D'), 6), if(e, strpos(o, 'E'), 6)) AS pos,
    a::INT + b::INT + c::INT + d::INT + e::INT AS fails
  FROM kinds, orders),
steps AS (
  SELECT gone.*, step, o[step] AS f, CASE o[step] WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS hit
  FROM gone, unnest([1, 2, 3, 4, 5]) AS u(step)),
found AS (
  SELECT part, o AS filter_order, step::INT AS step, f, coalesce(sum(n) FILTER (pos > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (pos = step), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (hit AND pos < step), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (hit AND fails = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (pos = step AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (pos = step AND toxic), 0)::BIGINT AS toxic_lost
  FROM steps GROUP BY ALL)
SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM found"""


QUERIES = {
    "op1_suffix_tree": op1_suffix_tree,
    "op2_chat_format": op2_chat_format,
    "op3_histogram_shards": op3_histogram_shards,
    "op4_quality": op4_quality,
    "op5_collision_links": op5_collision_links,
    "op6_main_text": op6_main_text,
    "op7_packing": op7_packing,
    "op8_chosen_path": op8_chosen_path,
    "op9_decontamination": op9_decontamination,
    "op10_token_counts": op10_token_counts,
    "op11_alignment": op11_alignment,
    "op12_toxicity": op12_toxicity,
    "op13_filter_audit": op13_filter_audit,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {"op2_chat_format": OP2_SQL, "op5_collision_links": OP5_SQL, "op9_decontamination": OP9_SQL, "op13_filter_audit": OP13_SQL}
