"""Every registered query over whole small tables: its contract's columns, and a row for each row read."""

import pytest

from parcelgraph.llm import queries

DIR = "/root/testdata/sf0.001"
ANSWERS = {
    "op1_suffix_tree": ("documents", "doc_id held_out n_tokens n_known train_tokens base_score score"),
    "op2_chat_format": (None, "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars"),
    "op3_histogram_shards": ("documents", "doc_id size text_crc32 law shard slot grown_shard"),
    "op4_quality": ("documents", "doc_id held_out score predicted"),
    "op5_collision_links": ("embeddings", "vec_id n_links component_id kept"),
    "op6_main_text": ("pages", "page_id url text n_chars"),
    "op7_packing": (None, "doc_id start length ids_crc32 doc_tokens sequence_id offset"),
    "op8_chosen_path": ("documents", "doc_id n_shingles component_id kept"),
    "op9_decontamination": (None, "doc_id item_id n_item_shingles n_shared"),
    "op10_token_counts": ("documents", "doc_id n_bytes n_tokens over_limit"),
    "op11_alignment": ("documents", "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256"),
    "op12_toxicity": ("documents", "doc_id held_out score predicted"),
    "op13_filter_audit": (None, "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley"),
}


@pytest.mark.parametrize("name", sorted(ANSWERS))
def test_query(spark, name):
    table, columns = ANSWERS[name]
    found = queries.QUERIES[name](spark, DIR)
    assert found.columns == columns.split()
    n = found.count()
    read = lambda t: spark.read.parquet(f"{DIR}/{t}.parquet")
    if table:
        assert n == read(table).count()
        assert found.select(found.columns[0]).distinct().count() == n
    elif name == "op2_chat_format":
        assert n == read("conversations").select("conv_id").distinct().count() + 1
    elif name == "op13_filter_audit":
        assert n == 600 * read("documents").select("source").distinct().count()
    else:
        assert n > 0


def test_all_are_here():
    assert set(ANSWERS) == set(queries.QUERIES)
