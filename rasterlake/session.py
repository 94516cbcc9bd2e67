"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: What materialize() gave last, with its folder; weakly held, so that it is forgotten with the DataFrame.
_KEPT: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python, once per application, unless PYTHONPATH names its folder."""
    package = Path(__file__).resolve().parent
    named = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    app = spark.sparkContext.applicationId
    if package.parent in named or app in _SHIPPED:
        return
    _SHIPPED.add(app)
    target = Path(tempfile.mkdtemp(prefix="ship-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Only where it is unset and the master is local, as in tests, a new local one is taken."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _KEPT[out] = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the folder of a DataFrame that materialize() gave, once nothing reads it any more; of others nothing is deleted."""
    kept = _KEPT.pop(df, None)
    if kept is not None:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(kept)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
