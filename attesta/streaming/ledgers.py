"""Incremental validation: ledgers that land in a folder are judged as they come. No state is kept between ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ledger_rules
from ..sources import ledgers as src


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Whole JSON documents below ``path``: ledger_id, body."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("ledger_id"), F.col("value").alias("body"))


def validate(stream: DataFrame, out: str, checkpoint: str, only: set[str] | None = None, once: bool = True) -> StreamingQuery:
    """Findings of each micro-batch below ``out``/batch=N; a batch that is run again replaces its own folder, so each ledger's findings stand once."""

    def judge(batch: DataFrame, number: int) -> None:
        tables = src.flatten(src.parse_ledgers(batch, "body", "ledger_id"))
        ledger_rules.findings(tables, only).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
