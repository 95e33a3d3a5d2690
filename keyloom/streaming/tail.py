"""The log as a stream: files of mutation rows in, changes or folded values out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from keyloom.streaming.mutlog import fold


def tail(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """Rows of the log as they are appended; max_files bounds a micro-batch, which is the back-pressure."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def promote_stream(source: DataFrame, log_path: str, checkpoint: str, pov_id: str = "global") -> StreamingQuery:
    """Appends each micro-batch to the parent's log under its batch number, so a batch that is run again replaces itself."""
    from pyspark.sql import functions as F

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("pov_id", F.lit(pov_id)).write.mode("overwrite").parquet(f"{log_path}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fold_stream(source: DataFrame, key: Sequence[str], state_path: str, checkpoint: str) -> StreamingQuery:
    """Keeps folded values at state_path/value: each micro-batch is folded together with the log so far."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{state_path}/log/batch={number}")
        fold(spark.read.parquet(f"{state_path}/log").drop("batch"), key).write.mode("overwrite").parquet(f"{state_path}/value")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
