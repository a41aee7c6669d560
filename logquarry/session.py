"""Session settings, scratch locations and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # All timestamps are UTC instants.
    "spark.sql.session.timeZone": "UTC",
    # JSON objects with a repeated key keep the last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # The JVM interprets methods above 8,000 bytes of bytecode instead of compiling them. Stages
    # with that much generated code run faster as separate operators, whose code is split up.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings every operator relies on. Safe to call repeatedly."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and scratch tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may leave it unset; a
    local temporary folder is used then.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        base = named
    else:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark, "_logquarry_scratch", None)
        if base is None:
            base = tempfile.mkdtemp(prefix="logquarry-")
            spark._logquarry_scratch = base
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Run ``df`` once and cut its lineage through Parquet files in the shared folder."""
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
