"""Session settings and the shared scratch folder.

Intermediate tables live under `spark.checkpoint.dir`, the folder every executor can reach, so a
lost executor never loses them. A folder of our own is used only where that setting is absent.
"""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDER: dict[str, str] = {}

# Runtime SQL settings every job relies on. None of them depends on the size of the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    # Python workers look for this package where the driver found it (as well as where it is installed)
    root = str(Path(__file__).resolve().parent.parent)
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is named, a local session gets a temporary one; a cluster is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        root = named
    elif not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
    else:
        app = spark.sparkContext.applicationId
        root = _OWN_FOLDER.get(app)
        if root is None:
            root = _OWN_FOLDER[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root.rstrip('/')}/attestry/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage for good."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)  # hashes as hex halve
    return df.sparkSession.read.parquet(path)
