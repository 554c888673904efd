"""File-stream form of the monthly preparation.

De-accumulation is closed within one forecast run, so each micro-batch of whole run
files needs no state from earlier batches; the sink appends run by run and a replayed
batch overwrites its own folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from coastgrid.operators.timeaxis import deaccumulate


def stream_deaccumulated_months(
    spark: SparkSession,
    source: str,
    schema: StructType | str,
    target: str,
    checkpoint: str,
    cell: Sequence[str] = ("cell",),
    accumulated: str = "acc",
) -> StreamingQuery:
    """Prepare every run file that has arrived, then stop (``availableNow``).

    Each source file must hold whole runs.  The batch number names the output folder,
    which makes a retried batch idempotent.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        deaccumulate(batch, cell, accumulated).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        spark.readStream.schema(schema)
        .parquet(source)
        .writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
