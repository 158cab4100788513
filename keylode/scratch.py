"""A folder that the driver and all executors share, for tables and files that a plan reads again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; on one machine, where it is unset, in a local one.  It goes when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.keylode.scratch", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="keylode-")
        spark.conf.set("spark.keylode.scratch", root)
    path = f"{root.rstrip('/')}/s-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path
