"""A folder that driver and executors share, for lakes that live as long as a query."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="fernlake-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return f"{found.rstrip('/')}/lake-{uuid.uuid4().hex}"
