"""Cutting the lineage of iterative results."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() into spark.checkpoint.dir.

    Where that is unset and Spark runs inside this process, as in tests, a
    temporary folder is made; on a cluster an unset folder is an error.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.match(r"local(\[|$)", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="lumicell-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
        sc.setCheckpointDir(root)
    return df.checkpoint()
