"""Session helpers: a local session for tests and benches, and reliable materialisation."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every plan in this package is written for. They only take effect where the
# session still has Spark's own default, so a cluster's explicit choice always wins.
ADAPTIVE_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = 8, app: str = "convhist", memory: str = "12g") -> SparkSession:
    """Single-JVM session for tests and the bench; a cluster brings its own.

    Python workers find the package wherever the session is started from.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [root, os.environ.get("PYTHONPATH")]))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in ADAPTIVE_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    If it is unset, a temporary folder serves sessions whose master is local; elsewhere executors would write to disks of
    their own, so that is an error. Tables stay until the folder is cleaned.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="convhist-checkpoint-")
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write the rows as a table in the shared folder and read them back.

    A lost executor never invalidates it, and unlike a row checkpoint it is columnar, so later reads
    prune columns and know its size. Used once per round by the iterative graph operators, where a
    non-deterministic partition number has to be frozen, and where several branches of one plan
    would otherwise recompute an expensive input.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder, for data that one query writes and reads back."""
    return f"{checkpoint_dir(spark).rstrip('/')}/convhist-{name}-{uuid.uuid4().hex}"
