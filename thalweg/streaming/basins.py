"""New basins as they arrive: a stream over a folder of cells, each micro-batch run as one distributed plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

CELLS = "basin string, cell_id long, r long, c long, z double"


def process_arrivals(spark: SparkSession, source: str, sink: str, checkpoint: str, run: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Run a plan over the cells of each new set of files and write its result by batch, so that a retry overwrites its own.

    A basin's cells have to arrive in one file set; the query stops once all that is there is done.
    """

    def each(batch: DataFrame, number: int) -> None:
        if batch.limit(1).count():
            run(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(CELLS).parquet(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
