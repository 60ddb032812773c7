"""Statement ingest as a file stream, and last activity kept up to date without rescans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import banner, dedupe_entries, statement_rows

ENTRY_STATE = "sku string, last_purchase date, last_sale date"


def tidy(grid: DataFrame) -> DataFrame:
    """A batch of grids as statement rows with their periods."""
    return dedupe_entries(statement_rows(grid)).join(F.broadcast(banner(grid)), "file")


def ingest_stream(spark: SparkSession, grids: str, schema, out: str, checkpoint: str):
    """Grid files (Parquet) as they arrive, tidied and appended; the trigger takes what is there and stops.

    A batch's rows go to a folder of its own number and replace it, so that a batch that is run again leaves no copies.
    """

    def save(batch: DataFrame, number: int) -> None:
        tidy(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(grids)
    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(rows: DataFrame) -> DataFrame:
    """Last paid purchase and last sale of every SKU in these rows."""
    sold = (F.col("sales") > 0) | (F.col("sales_free") > 0)
    return rows.groupBy("sku").agg(F.max(F.when(F.col("purchase") > 0, F.col("period_end"))).alias("last_purchase"), F.max(F.when(sold, F.col("period_end"))).alias("last_sale"))


def activity_stream(spark: SparkSession, rows: str, schema, out: str, checkpoint: str, files: int = 4):
    """History files as they arrive: the state store keeps every SKU's dates, and each batch of ``files`` files writes the SKUs that it changed.

    Late and backfilled periods are normal, and a maximum takes them in any order. Batch ``n`` goes to a folder of its own number and
    replaces it, so a batch that is run again leaves no copies. Removed reports can't be taken out of a maximum: rebuild with
    ``activity`` over the live history.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(rows)
    return activity(stream).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_activity(spark: SparkSession, out: str) -> DataFrame:
    """The dates of every SKU after all batches in ``out``; no rows before the first one."""
    empty = spark.createDataFrame([], ENTRY_STATE)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return empty
    changes = spark.read.schema(empty.schema).parquet(f"{out}/batch=*")
    return changes.groupBy("sku").agg(F.max("last_purchase").alias("last_purchase"), F.max("last_sale").alias("last_sale"))
