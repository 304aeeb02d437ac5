"""Materialised stages and sinks."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..config import fingerprint


def cached_stage(spark: SparkSession, folder: str, name: str, cfg: dict, make: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The Parquet table of a stage, written on first use. Its path holds the settings' fingerprint, so a
    stage of other settings is never taken for this one."""
    path = f"{folder.rstrip('/')}/{name}-{fingerprint(cfg)}"
    if not refresh:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    made = make()
    made.write.mode("overwrite").parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once into the folder that all executors share (``spark.checkpoint.dir``) and read again, for
    what a plan needs several times. Where that is unset and the master is local, into a temporary folder."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        base = f"file://{base}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tessera-panels/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def to_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, one file a partition."""
    df.write.mode("overwrite").option("header", True).csv(path)
