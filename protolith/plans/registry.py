"""The queries by name, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table's files that are one task's.
DEALT = 2 << 20


def spread(df: DataFrame, dealt: int = DEALT, source: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows of a table, or made of the table `source`, dealt to many tasks: for work that costs far more than its input is long.

    Files are cut by their row groups, which are few and large. With `by`, rows of one key are one task's: later joins
    and windows by it take these partitions, so that a task's share doesn't grow with the table.
    """
    size = int((source or df)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // dealt)), *by)
