"""What several corpus operators share: written tables, batches for Python workers, fixed splits, dropping rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.shared import drop, forget, salted_join, ship  # noqa: F401
from tessera.plans.shared import written as materialize

#: A Python worker works on so many rows at once, and on so many bytes if they are more than one row. Spark itself hands
#: over batches of 64 MB at most.
BATCH, BATCH_BYTES = 1_000, 8 << 20
ROWS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """For jobs (the registered queries and the pipeline): Spark hands over BATCH rows at once, unless the session says
    another number than Spark's own. Operators leave the session's settings alone."""
    if spark.conf.get(ROWS_PER_BATCH) == "10000":
        spark.conf.set(ROWS_PER_BATCH, str(BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most BATCH rows and about BATCH_BYTES bytes; a row is never split."""
    n = batch.num_rows
    step = max(1, min(BATCH, BATCH_BYTES * n // max(1, batch.nbytes)))
    for i in range(0, max(n, 1), step):
        part = batch.slice(i, step)
        if part.num_rows > 1 and part.nbytes > 2 * BATCH_BYTES:  # long texts side by side
            yield from (part.slice(k, 1) for k in range(part.num_rows))
        else:
            yield part


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema), with batches that bound what a Python worker holds at once; what a partition took goes
    back to the system when it ends, as workers are kept for the next."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(part for batch in batches for part in sliced(batch))
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)

    ship(df.sparkSession)
    return df.mapInArrow(lean, schema)


def without(docs: DataFrame, judged: DataFrame, name: str, keyed: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """docs without the rows that are judged gone: judged has doc_id, key and gone of every row, alike where the first two
    are; keyed(rows, column) adds the key to rows of docs.

    The ids that go are written first: few as a rule, so that the texts need not be shuffled to drop them. Keys are only
    made for ids (null is one) of which some rows go and others stay.
    """
    judged = materialize(judged.select("doc_id", "key", "gone"), name)
    ids = judged.groupBy("doc_id").agg(F.bool_and("gone").alias("whole"), F.bool_or("gone").alias("some"))
    ids = materialize(ids.filter("some").select(F.col("doc_id").alias("_gone_id"), "whole"), f"{name}-ids")
    out = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_gone_id"]), "left_anti")
    mixed = ids.filter("NOT whole").select("_gone_id")
    if mixed.isEmpty():
        return out
    own = keyed(docs.join(mixed, docs["doc_id"].eqNullSafe(mixed["_gone_id"]), "left_semi"), "_judged_key")
    gone = judged.filter("gone").select(F.col("doc_id").alias("_gone_id"), F.col("key").alias("_gone_key")).distinct()
    stay = own.join(gone, own["doc_id"].eqNullSafe(gone["_gone_id"]) & (own["_judged_key"] == gone["_gone_key"]), "left_anti")
    return out.unionByName(stay.select(*docs.columns))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; all-ASCII texts take the JVM's fast path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds
