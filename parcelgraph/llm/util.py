"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelgraph.sources.shared import delete, shared_dir, write


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage ends there, and
    whatever happens to executors later, nothing above it is computed twice."""
    return write(df, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", **options)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize` that no later plan reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, path)


def words(text) -> F.Column:
    """ASCII-lower-cased words between runs of the six ASCII white-space characters."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, "[ \\t-\\r]+"), lambda w: w != "")


def field(df: DataFrame, name: str, as_name: str | None = None) -> T.StructField:
    """The schema entry of one column, nullable, under another name if wanted."""
    return T.StructField(as_name or name, df.schema[name].dataType, True)
