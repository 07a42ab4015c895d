"""Steps of a long job, written to a folder that all executors share, so that later steps don't plan or compute them again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names; a folder of this machine only where the session runs on it alone (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="protolith-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def staged(df: DataFrame, seen: dict[str, int] | None = None, name: str = "") -> DataFrame:
    """The rows written and read back: the lineage ends there, and a lost executor costs no earlier step.

    With `seen` the rows are counted under a name as they are written, without a pass of their own.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/protolith/{uuid.uuid4().hex}"
    if seen is None:
        df.write.parquet(path)
    else:
        count = Observation(f"{name}-{uuid.uuid4().hex}")
        df.observe(count, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        seen[name] = count.get["rows"]
    return df.sparkSession.read.schema(df.schema).parquet(path)
