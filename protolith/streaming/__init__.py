"""Documents that arrive: each batch is extracted like a table and appended as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import extract


def ingest(body: DataFrame, path: str, known: DataFrame, vocabulary: DataFrame, checkpoint: str) -> StreamingQuery:
    """Starts a query that takes all there is and ends. body: as `sources.docx.read_stream` gives it.

    A document is whole within its file, so no state is kept between batches; a batch that is run again after a failure
    replaces its own part.
    """

    def batch(df: DataFrame, number: int) -> None:
        extract.rows_of(extract.tables_of(df), known, vocabulary).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return body.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
