"""Exact deduplication through an extendible-hash index in shared files (DataFrame functions only).

Texts are equal when identical after each run of [\\x20\\x09-\\x0D] has become one space.

1. Keys: the hash of each normalised text. Counts of distinct hashes by their top bits (2 ** MAX_DEPTH numbers at most,
   whatever the data) make the directory: a bucket that holds more than CAPACITY hashes is split by doubling until it
   does not, or until MAX_DEPTH; what is more then stays chained in its bucket.
2. Insertion: buckets are dealt in order to owner tasks, a range of the hash each, by their numbers of rows. Each text
   goes to the owner of its bucket, there it meets the chain of its hash, and its bytes are compared with those of the
   chain's texts: it joins the one that it equals or becomes the next. An entry is a distinct text: its place in the
   chain, SHA-256, smallest doc_id and number of rows.
3. Hot hashes, of over HOT_ROWS rows (HOT_KEYS at most, those with the most rows), would fill one owner: their rows are
   spread over all owners by a salt, and the entries these make, one a distinct text and owner, meet in the chain again.
4. The entries, sorted by bucket, hash and place, are the index's files. Rows find theirs by bucket, hash and digest;
   only entries of two rows or more are looked for.

Cases: a null text counts as empty; empty texts are one group. A null doc_id never is the smallest unless all of its
group are null, then keep_id is null and the rows are kept. Rows repeated with the same doc_id and text are the same
document: each is returned, with the same answer; deduplicate() keeps all rows of the doc_id that stays. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import drop, materialize, salted_join, table, without

CAPACITY = 256
MAX_DEPTH = 16
HOT_ROWS, HOT_KEYS = 2_000, 10_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def directory(counts: dict[int, int], capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> list[tuple[int, int, int]]:
    """(slot, bucket, local depth) of the doubled directory, from counts by the top max_depth bits.

    A bucket is a prefix of the hash; one of more than `capacity` entries is split in two until max_depth.
    Buckets are numbered in the order of their prefixes, so that ranges of buckets are ranges of hashes.
    """
    sums = [counts.get(i, 0) for i in range(1 << max_depth)]
    levels = [sums]
    while len(levels[0]) > 1:
        below = levels[0]
        levels.insert(0, [below[i] + below[i + 1] for i in range(0, len(below), 2)])
    leaves, todo = [], [(0, 0)]
    while todo:
        depth, prefix = todo.pop()
        if levels[depth][prefix] <= capacity or depth == max_depth:
            leaves.append((depth, prefix))
        else:
            todo += [(depth + 1, 2 * prefix + 1), (depth + 1, 2 * prefix)]
    global_depth = max(depth for depth, _ in leaves)
    out = []
    for bucket, (depth, prefix) in enumerate(leaves):
        width = 1 << (global_depth - depth)
        out += [(slot, bucket, depth) for slot in range(prefix * width, (prefix + 1) * width)]
    return out


def slot_of(hash_: Column, depth: int) -> Column:
    """The directory slot of a hash: its top `depth` bits."""
    return F.shiftrightunsigned(hash_, 64 - depth).cast("int") if depth else F.lit(0)


def owners_of(slots: list[tuple[int, int, int]], rows: dict[int, int], owners: int, max_depth: int = MAX_DEPTH) -> list[tuple[int, int, int, int]]:
    """The directory (slot, bucket, depth) with each bucket's owner: ranges of buckets with about the same number of rows,
    which are given by the top max_depth bits."""
    width = (1 << max_depth) // len(slots)
    total, before, of = max(1, sum(rows.values())), 0, {}
    for slot, bucket, _ in slots:
        of.setdefault(bucket, min(owners - 1, before * owners // total))
        before += sum(rows.get(i, 0) for i in range(slot * width, (slot + 1) * width))
    return [(slot, bucket, depth, of[bucket]) for slot, bucket, depth in slots]


def keyed(docs: DataFrame, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, hash and digest of every row, written."""
    norm = normalised(F.col("text"))
    return materialize(docs.select("doc_id", hashed(norm).alias("hash"), F.unhex(F.sha2(norm, 256)).alias("digest")), "keys")


def build_index(docs: DataFrame, keys: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, hashed: Callable[[Column], Column] = F.xxhash64) -> tuple[DataFrame, DataFrame, int]:
    """The index (bucket, hash, chain, digest, keep_id, group_size), its directory (slot, bucket, depth, owner) and depth;
    keys: what keyed() gives for docs."""
    spark = docs.sparkSession
    hashes = materialize(keys.groupBy("hash").agg(F.count(F.lit(1)).alias("n")), "hashes")
    counted = hashes.groupBy(slot_of(F.col("hash"), max_depth).alias("slot")).agg(F.count(F.lit(1)).alias("hashes"), F.sum(F.least("n", F.lit(HOT_ROWS))).alias("rows")).collect()
    slots = directory({r["slot"]: r["hashes"] for r in counted}, capacity, max_depth)
    depth = (len(slots) - 1).bit_length()
    owners = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    held = spark.createDataFrame(owners_of(slots, {r["slot"]: r["rows"] for r in counted}, owners, max_depth), "slot int, bucket int, depth int, owner int")
    hot = hashes.filter(F.col("n") > HOT_ROWS).orderBy(F.desc("n"), "hash").limit(HOT_KEYS).select(F.col("hash").alias("hot"))

    norm = normalised(F.col("text"))
    rows = docs.select("doc_id", norm.alias("norm"), hashed(norm).alias("hash")).withColumn("slot", slot_of(F.col("hash"), depth))
    rows = rows.join(F.broadcast(held.select("slot", "bucket", "owner")), "slot").join(F.broadcast(hot), F.col("hash") == F.col("hot"), "left")
    spread = F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(owners)).cast("int")
    rows = rows.withColumn("owner", F.when(F.col("hot").isNull(), F.col("owner")).otherwise(spread)).withColumn("is_hot", F.col("hot").isNotNull())
    # An owner holds all rows of its buckets, so their chains are built where they are.
    dealt = rows.select("owner", "bucket", "hash", "is_hot", "norm", "doc_id").repartitionById(owners, "owner")
    found = dealt.groupBy("owner", "bucket", "hash", "is_hot", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Of entries of hot hashes, the text goes on to be compared with those that other owners made; the others are complete.
    found = materialize(found.select("bucket", "hash", "is_hot", F.unhex(F.sha2("norm", 256)).alias("digest"), F.when(F.col("is_hot"), F.col("norm")).alias("norm"), "keep_id", "group_size"), "entries")
    met = found.filter("is_hot").groupBy("bucket", "hash", "norm").agg(F.first("digest").alias("digest"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    entries = found.filter("NOT is_hot").drop("norm", "is_hot").unionByName(met.drop("norm"))
    place = F.row_number().over(Window.partitionBy("bucket", "hash").orderBy("digest")) - 1
    index = materialize(entries.repartitionByRange("bucket", "hash").withColumn("chain", place), "index")
    drop(found, hashes)
    return index, held, depth


def groups(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = keyed(docs, hashed)
    index, held, depth = build_index(docs, keys, capacity, max_depth, hashed)
    rows = keys.withColumn("slot", slot_of(F.col("hash"), depth)).join(F.broadcast(held.select("slot", "bucket")), "slot").drop("slot")
    several = index.filter("group_size > 1").select("bucket", "hash", "digest", "keep_id", "group_size")
    found = salted_join(rows, several, ["bucket", "hash", "digest"], "group_size")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows that stay, with their columns; a doc_id with several texts loses those alone that are copies."""
    judged = groups(docs).select("doc_id", F.col("text_sha256").alias("key"), (~F.col("kept")).alias("gone"))
    return without(docs, judged, "copies", lambda rows, key: rows.withColumn(key, F.sha2(normalised(F.col("text")), 256)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
