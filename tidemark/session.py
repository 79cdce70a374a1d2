"""Sessions, and this package's way to the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def session(name: str = "tidemark", **conf: str) -> SparkSession:
    """A session with the settings that all operators assume: UTC, adaptive plans, Arrow."""
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": "false"}
    return SparkSession.builder.appName(name).config(map=fixed | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once per application, as functions in Arrow maps refer to it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, with a folder for this application in it, which can go when that has ended.

    Where the setting is missing, a local folder serves a local master; on a cluster executors would not see each other's files, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(named or '/tmp/checkpoints').rstrip('/')}/tables/{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
