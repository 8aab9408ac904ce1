"""Tables that cut lineage, kept in the folder that all executors and the driver share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The temporary folder of each local application that names no shared folder.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as named by ``spark.checkpoint.dir``.

    Only a local session may leave the setting out: driver and executors are one process there, so
    a temporary folder is visible to all of them. Elsewhere a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="kinsift-")
    return _LOCAL[app]


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes df once as Parquet into the shared folder and returns the table that was written.

    Later readers neither recompute df nor depend on any executor's disk. Each call takes a new
    folder, so reruns and retries never meet.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinsift-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
