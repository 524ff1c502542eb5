"""Rows in use of a stream: late and corrected rows are merged into a stored table batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from wayfold.operators.rows import rows_in_use
from wayfold.sources import files


def merge_batch(batch: DataFrame, number: int, path: str, keys: list[str], newest: str, payload: list[str]) -> None:
    """Writes version `number` of the table: the newest row of each key of the batch and of the version before.

    A version is written as a whole under its own name, so a batch that is repeated after a failure replaces itself and
    never counts twice.
    """
    spark = batch.sparkSession
    cols = [*keys, newest, *payload]
    before, there = files.load(spark, f"{path}/{number - 1}") if number else (None, False)
    rows = batch.select(*cols) if not there else batch.select(*cols).unionByName(before.select(*cols))
    kept = rows.withColumn("__n", rows[newest])
    rows_in_use(kept, keys, "__n", [newest, *payload]).write.mode("overwrite").parquet(f"{path}/{number}")


def keep_rows_in_use(stream: DataFrame, path: str, checkpoint: str, keys: list[str], newest: str, payload: list[str]) -> StreamingQuery:
    """Starts the query; each trigger takes what has arrived. The table is the version of the greatest number."""
    write = stream.writeStream.foreachBatch(lambda b, n: merge_batch(b, n, path, keys, newest, payload))
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
