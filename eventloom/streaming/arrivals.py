"""Sample files that arrive over time (ST1, ST2)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import file_stem, q
from ..operators.joins import auto_sample_rows
from ..sources.tables import read_sheet, write_sheet


def arriving_events(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    *,
    kind: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Streaming scan of a folder with the sample's name from the file name."""
    reader = spark.readStream.schema(schema).format(kind)
    if kind == "csv":
        reader = reader.option("header", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder).select(
        file_stem(F.col("_metadata.file_name")).alias("file_name"), "*"
    )


def append_batches(events_path: str, sheet_path: str) -> Callable[[DataFrame, int], None]:
    """ST1: append each batch to the event table and its new files to the sheet.

    A batch owns its folder, so a repeated batch replaces itself. The sheet is
    versioned by batch for the same reason: a batch reads the version before
    it and writes its own.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        target = f"{events_path}/batch={number}"
        batch.write.mode("overwrite").parquet(target)
        stored = spark.read.schema(batch.schema).parquet(target)
        sheet = read_sheet(spark, f"{sheet_path}/version={number - 1}")
        sheet = sheet.filter(F.trim(q("file_name")) != "")
        rows = auto_sample_rows(sheet, stored.select("file_name").distinct())
        write_sheet(sheet.unionByName(rows), f"{sheet_path}/version={number}")

    return write


def ingest(
    events: DataFrame, events_path: str, sheet_path: str, checkpoint: str, *, once: bool = False
) -> StreamingQuery:
    """ST1: start the ingest; ``once`` takes what is there and stops."""
    writer = (
        events.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(append_batches(events_path, sheet_path))
    )
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="3 seconds")
    return writer.start()


def latest_sheet(spark: SparkSession, sheet_path: str) -> DataFrame:
    """The newest sheet version."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(sheet_path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [entry.getPath().getName() for entry in system.listStatus(folder)]
    newest = max(int(n.removeprefix("version=")) for n in names if n.startswith("version="))
    return read_sheet(spark, f"{sheet_path}/version={newest}")


def count_status(
    events: DataFrame, out: str, checkpoint: str, *, by: str = "file_name", once: bool = False
) -> StreamingQuery:
    """ST2: running number of events per file, rewritten as a table."""
    counts = events.groupBy(q(by)).agg(F.count(F.lit(1)).alias("n_events"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    writer = (
        counts.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
    )
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")
    return writer.start()
