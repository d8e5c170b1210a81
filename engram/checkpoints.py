"""Where lineage is cut: the folder that the session names, and a temporary one in tests only."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder of checkpoints: spark.checkpoint.dir, or what the context has. Where both are unset, a process of its
    own (local mode) takes a temporary folder; on a cluster that is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if named := spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir"):
            sc.setCheckpointDir(named)
        elif re.match(r"local(\[[^\]]*\])?$", sc.master):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints"))
        else:
            raise RuntimeError("spark.checkpoint.dir is not set")
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Runs df and cuts its lineage."""
    folder(df.sparkSession)
    return df.checkpoint(True)
