"""The folder that the driver and all executors share, for tables between stages."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting to remove an execution's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """What the cluster names in ``spark.checkpoint.dir``; where that is unset and Spark runs on
    this machine alone, a temporary folder, which the session then remembers."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="parcelgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def write(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Write ``df`` to a new folder and read it again; the shuffle files that made it go at once."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder, wherever it is stored."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Give this package, and the modules beside it, to the session's Python workers wherever they run.

    Once for each application; queries of ``__spark_entry__`` do it themselves, and who calls an
    operator without them does it before.
    """
    sc = spark.sparkContext
    if getattr(sc, "_parcelgraph_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    target = os.path.join(tempfile.mkdtemp(prefix="parcelgraph-code-"), "parcelgraph.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for path in [*sorted((root / "parcelgraph").rglob("*.py")), *root.glob("corpus_pipeline.py")]:
            archive.write(path, path.relative_to(root))
    sc.addPyFile(target)
    sc._parcelgraph_shipped = True
