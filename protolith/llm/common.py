"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches of whole documents may hold long texts, so a batch stays small in bytes.
BATCH_BYTES = "8m"


def session(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches by bytes, so that a few very long texts can't fill a worker."""
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    except Exception as e:  # a Spark without this setting bounds the rows only
        if "CANNOT_MODIFY" not in str(e) and "UNKNOWN" not in str(e).upper():
            raise
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a folder of this machine only where the session runs on it alone (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="protolith-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder, read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/protolith/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for df in tables:
        for f in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/protolith/" in f}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release() -> None:
    """Give back what earlier stages left free in a reused Python worker: Arrow's pool and, with glibc, the heap's top and holes."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run):
    """A function of batches that gives its free memory back at its end: the worker lives on beside later stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text under these names only, whatever else the input has; a null text stays null."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def carry(df: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one column `carried`, so that no name of theirs meets an operator's own."""
    other = [F.col(f"`{c}`").alias(c) for c in df.columns if c not in ("doc_id", "text")]
    return df.select("doc_id", "text", (F.struct(*other) if other else F.struct(F.lit(None).cast("int").alias("none"))).alias("carried"))


def uncarry(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that `carry` packed, in their order, with doc_id and text as they are now."""
    return df.select(*[F.col(c) if c in ("doc_id", "text") else F.col("carried").getField(c).alias(c) for c in columns])


def groups_of(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Slices [i, j) of consecutive items whose sizes sum to at most `most`, or that hold one item."""
    i, total = 0, 0
    for j, n in enumerate(sizes):
        if j > i and total + n > most:
            yield i, j
            i, total = j, 0
        total += n
    if len(sizes) > i:
        yield i, len(sizes)
