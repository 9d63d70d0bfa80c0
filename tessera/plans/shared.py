"""The folder that driver and executors share, tables written there to cut lineage, and a join that survives hot keys."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys with more rows than this are hot in salted_join; at most HOT_KEYS of them, those with the most rows, are broadcast.
#: A key beyond these has one in HOT_KEYS of all rows at most.
HOT_ROWS, HOT_KEYS = 2_000, 10_000
SALTS = 64
#: Paths that written() wrote and nothing has deleted yet.
WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a session on this machine alone may lack it and gets a folder of its own;
    on a cluster that would be a folder which other machines do not see, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def ship(spark: SparkSession) -> None:
    """Makes this package known to the Python workers, wherever they run: once a context, as a zip that Spark hands out."""
    context, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(context, "_tessera_shipped", False) or not root.is_dir():
        return
    path = os.path.realpath(os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip"))
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    context.addPyFile(path)
    context._tessera_shipped = True


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet into the shared folder and read back: lineage ends there, losing an executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/tessera-{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(*frames: DataFrame) -> None:
    """Deletes tables that written() returned and nothing reads any more."""
    for df in frames:
        path = getattr(df, "_tessera_path", None)
        if path in WRITTEN:
            WRITTEN.remove(path)
            delete(df.sparkSession, path)


def forget(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Deletes what was written after the first `since` tables but for `keep`; results that read them must be saved before."""
    kept = {getattr(df, "_tessera_path", None) for df in keep}
    for path in [p for p in WRITTEN[since:] if p not in kept]:
        WRITTEN.remove(path)
        delete(spark, path)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str, by: list[str] | None = None) -> DataFrame:
    """left LEFT JOIN right ON keys, where right has one row a key and its column `rows` tells how many rows of left have that key.

    Hot keys meet their rows where these are (HOT_KEYS rows at most are broadcast) and then go on spread by a salt, as do
    rows with a null key, which match nothing; the others are shuffled once, by key. The salt is a hash of the columns `by`,
    all if not given, so a task that runs again deals its rows out alike.
    """
    extra = [c for c in right.columns if c not in keys]
    if not extra:
        raise ValueError("right has nothing but keys")
    side = lambda df, name: df.select(*keys, F.struct(*extra).alias(name))
    hot = right.filter(F.col(rows) > HOT_ROWS).orderBy(F.desc(rows)).limit(HOT_KEYS)
    out = left.withColumn("_join_spread", F.pmod(F.xxhash64(*(by or left.columns)), F.lit(SALTS)).cast("int"))
    out = out.join(F.broadcast(side(hot, "_join_hot")), keys, "left")
    lost = F.lit(False)
    for k in keys:
        lost = lost | F.col(k).isNull()
    out = out.withColumn("_join_salt", F.when(lost | F.col("_join_hot").isNotNull(), F.col("_join_spread")).otherwise(-1))
    out = out.join(side(right, "_join_cold").withColumn("_join_salt", F.lit(-1)), [*keys, "_join_salt"], "left")
    met = F.coalesce("_join_hot", "_join_cold")
    return out.select(*left.columns, *[met[c].alias(c) for c in extra])
