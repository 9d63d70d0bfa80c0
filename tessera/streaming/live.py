"""The index as a stream: source files arrive as rows, each micro-batch is a refresh of what it brings.

A batch is handled by foreachBatch: its files are parsed, replace the records they had, and are saved as the next
generation, so a batch that is run again after a failure gives the same records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from tessera.sources import index
from tessera.sources.discovery import with_language

FILES = "root string, path string, mtime double, size long, content string"


def newest(batch: DataFrame) -> DataFrame:
    """One row a file: that of the latest time (of equal times, the greatest content)."""
    order = Window.partitionBy("root", "path").orderBy(F.desc("mtime"), F.desc("content"))
    return batch.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def apply_batch(store: index.Store, fingerprint: str, batch: DataFrame) -> DataFrame:
    """Saves the records with the batch's files put in; files with null content leave."""
    files = newest(batch)
    parsed = index.parse(with_language(files.filter("content IS NOT NULL")))
    old = store.load(fingerprint)
    if old is None:
        return store.save(fingerprint, parsed, "fresh")
    kept = old.join(files.select("root", "path"), ["root", "path"], "left_anti").select(*index.RECORD.names)
    return store.save(fingerprint, kept.unionByName(parsed), "refreshed")


def follow(spark: SparkSession, folder: str, store: index.Store, fingerprint: str, checkpoint: str) -> StreamingQuery:
    """Starts a query over Parquet files of FILES rows that keeps the index up to date; it ends when all are read."""
    rows = spark.readStream.schema(FILES).parquet(folder)

    def each(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            apply_batch(store, fingerprint, batch)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
