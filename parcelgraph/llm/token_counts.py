"""Token counts with a whole-token shortcut.

Which vocabulary strings encode alone as one token is proved once, on the driver, by merging each
of them. A text is then cut into pre-tokens; those in the proved set count one without any merge,
and only the rest are merged (each distinct one once while it is remembered).

The work is one pass over the documents without a shuffle. What is broadcast is the tokenizer's
file and the proved strings, both bounded by the vocabulary.
"""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import bpe, util


def count_tokens(docs: DataFrame, tokenizer_file: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of ``docs``.

    A null text counts as an empty one: 0 bytes, 0 tokens. Repeated rows and null ids give one
    row each; an empty table gives none; other columns, whatever their names, are not read. Texts
    of any length are counted whole. Strings of the tokenizer's special tokens inside a text count
    as that one token, as the tokenizers library has it by default.
    """
    spec = Path(tokenizer_file).read_text(encoding="utf-8")
    shared = docs.sparkSession.sparkContext.broadcast((spec, bpe.whole_tokens(spec), bpe.unsure_characters(spec)))
    key = ("count", tokenizer_file, len(spec))
    schema = T.StructType([util.field(docs, id_col), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        count = bpe.kept(key, lambda: bpe.ByteLevelCounter(*shared.value))
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                n_bytes.append(len(text.encode()))
                n_tokens.append(count(text))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], schema=arrow)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
