"""Packing of token sequences: first-fit decreasing inside random groups.

Every document is encoded whole, gets an end id, and is cut into full pieces and one remainder.
Pieces (a few dozen bytes each, never their ids) are dealt into random groups of about
``group_rows``; each group is packed by first-fit decreasing, where a tournament tree over the
bins' free space finds the first bin that still has room in logarithmic time. Groups are
independent, so packing scales with the number of groups, and what a group wastes is its last
few bins.
"""

from __future__ import annotations

import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import bpe, util


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) for each length, longest first, each into the first bin with room.

    The tree's leaves are the bins' free space, its inner nodes the larger of their children; the
    leftmost leaf with enough room is found from the root down.
    """
    n = len(lengths)
    size = 1 << max(0, int(n - 1).bit_length())
    tree = [capacity] * (2 * size)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[k]), 1
        while node < size:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[k], offsets[k] = node - size, capacity - tree[node]
        tree[node] -= need
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            top = a if a > b else b
            if tree[node] == top:
                break
            tree[node] = top
            node >>= 1
    return bins, offsets


def cut_documents(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids: id, start, length, ids_crc32, doc_tokens, draw.

    draw is a random number for dealing pieces into groups; it is drawn with the partition's
    number as seed.
    """
    spec = Path(tokenizer_file).read_text(encoding="utf-8")
    shared = docs.sparkSession.sparkContext.broadcast((spec, bpe.unsure_characters(spec)))
    key = ("encode", tokenizer_file, len(spec))
    longs = ["start", "length", "ids_crc32", "doc_tokens", "draw"]
    schema = T.StructType([util.field(docs, id_col), *(T.StructField(c, T.LongType()) for c in longs)])
    arrow = to_arrow_schema(schema)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = bpe.kept(key, lambda: bpe.WordEncoder(*shared.value))
        draw = random.Random(TaskContext.get().partitionId()).getrandbits
        for batch in batches:
            row, out = [], []
            for k, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "") + end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    row.append(k)
                    out.append((start, len(piece) // 4, zlib.crc32(piece), total, draw(62)))
            cols = np.array(out, np.int64).reshape(-1, len(longs)).T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())).cast(arrow.field(0).type), *(pa.array(c) for c in cols)], schema=arrow)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 1, group_rows: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where each piece of each document goes: id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    Each id of a document, its end id included, lies in exactly one piece; the pieces of a
    sequence fill it gaplessly from offset 0 to at most ``capacity``. A null text is an empty one
    and becomes a piece with the end id alone. Repeated rows and null ids are packed like any
    others; an empty table gives no rows; other columns are not read. Very long texts are cut as
    often as needed. sequence_id holds the group above the low 32 bits and the bin in them.
    """
    pieces = util.materialize(cut_documents(docs, tokenizer_file, capacity, end_id, id_col, text_col), "pieces")
    groups = max(1, -(-pieces.count() // group_rows))
    longs = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([util.field(docs, id_col), *(T.StructField(c, T.LongType()) for c in longs)])
    arrow = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("draw", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(table["length"].to_numpy(), capacity)
        group = table["grp"][0].as_py()
        return pa.Table.from_arrays([table[0].cast(arrow.field(0).type), *(table[c] for c in longs[:4]), pa.array(bins + (group << 32)), pa.array(offsets)], schema=arrow)

    dealt = pieces.withColumn("grp", F.col("draw") % F.lit(groups))
    return dealt.groupBy("grp").applyInArrow(run, schema)
