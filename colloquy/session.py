"""Session settings and durable intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings the operators count on.

    Timestamps are rendered in UTC, and adaptive execution splits skewed join
    partitions. Everything else is left to the cluster's own settings.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Split a skewed join partition even where that costs another shuffle.
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Where the session names none, a local master gets a folder beside its
    warehouse. Other masters must name one: a folder of the driver's own machine
    would lose rows.
    """
    named = spark.conf.get(CHECKPOINT_SETTING, None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_SETTING} must name a folder that all executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
        spark.conf.set(CHECKPOINT_SETTING, named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of iterative jobs; the written table survives the loss of
    executors, and its size on disk is known to the optimizer.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths of stage tables by application, input version and name.
_STAGES: dict[tuple, str] = {}


def input_version(df: DataFrame) -> tuple:
    """Files of a table and the newest change among them: another version, another stage."""
    changed = df.select(F.max("_metadata.file_modification_time")).first()[0]
    return (*sorted(df.inputFiles()), str(changed))


def staged(spark: SparkSession, version: tuple, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stage table ``name`` of this input, written when first asked for in a session."""
    key = (spark.sparkContext.applicationId, shared_dir(spark), version, name)
    if key in _STAGES:
        try:
            return spark.read.parquet(_STAGES[key])
        except AnalysisException:  # its owner has removed the folder
            del _STAGES[key]
    df, path = build(), new_path(spark, name)
    df.write.parquet(path)
    _STAGES[key] = path
    return spark.read.schema(df.schema).parquet(path)


def forget_stages(spark: SparkSession) -> list[str]:
    """Forget this session's stage tables; returns their paths, for the owner to remove."""
    own = [key for key in _STAGES if key[0] == spark.sparkContext.applicationId]
    return [_STAGES.pop(key) for key in own]
