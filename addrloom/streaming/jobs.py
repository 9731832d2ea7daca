"""Structured Streaming forms of the file drivers and of the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ledger import ensure_recorded
from ..plans.standardize import standardize
from ..sources.files import check_paths


def stream_standardize(spark: SparkSession, source: str, output: str, checkpoint: str, schema: str, fmt: str = "csv", columns: dict[str, str] | None = None, files_per_batch: int = 100) -> StreamingQuery:
    """Files of a folder, each once: read, standardized and written by micro-batches of bounded size; the checkpoint makes a restart go on where
    it stopped. Standardization is one projection, so a batch needs no shuffle and no state."""
    check_paths(source, output, checkpoint)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    rows = reader.option("header", True).csv(source) if fmt == "csv" else reader.json(source)
    out = standardize(rows, columns)
    flat = [F.to_json(F.col(f"`{c}`")).alias(c) if kind.startswith("array") and fmt == "csv" else F.col(f"`{c}`") for c, kind in out.dtypes]
    writer = out.select(*flat).writeStream.format(fmt).option("checkpointLocation", checkpoint).option("path", output)
    return (writer.option("header", True) if fmt == "csv" else writer).trigger(availableNow=True).start()


def stream_to_ledger(rows: DataFrame, ledger_path: str, checkpoint: str) -> StreamingQuery:
    """Appends new records to a ledger table: a record whose id is there already is left out, so a batch that runs twice adds nothing."""

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            ledger = spark.read.parquet(ledger_path)
        except Exception as e:  # the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            ledger = spark.createDataFrame([], batch.schema)
        ensure_recorded(ledger, batch).write.mode("append").parquet(ledger_path)

    return rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_within(rows: DataFrame, keys: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """Repeats of a key within the delay are dropped; the state of older keys goes with the watermark."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
