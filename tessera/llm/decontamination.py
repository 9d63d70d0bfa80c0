"""Benchmark decontamination by winnowing (DataFrame functions only).

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased. A window is WINDOW consecutive words of a
benchmark item; an item of fewer words, but not none, is one window of its own length.

For every window length t in the benchmark, k-grams of words are hashed and each window's smallest hash is its
fingerprint, kept once a run of windows that share it. Two equal windows have the same smallest hash, so every shared
span of t words or more is found. Document fingerprints join those of the benchmark; the runs that meet one are
extended: their windows are compared, word for word, with the benchmark's, and the words they cover are counted.

A benchmark of at most BROADCAST_WORDS words, counted before, is broadcast: nothing is exploded but fingerprints (about 2 in
9 words) inside the task that read them; what leaves it is one row a document and the windows that are hit. A larger one is
joined by shuffles, in one pass as well: fingerprints of documents meet those of the benchmark by value, only the runs that
met one go back to their texts, and only their windows meet the benchmark's. Both joins survive hot keys (a passage in a
third of all documents) by salts.

Cases: a null text has no words and is not contaminated. Items that are null or have no word have no window; a null
item_id is not counted. Items of equal text or id count once an id. Repeated documents are returned a row each; rows that
share a doc_id, a null one too, are judged each by its own text. Empty documents give an empty result; an empty benchmark
hits nothing. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import lower_ascii, materialize, salted_join, table, without

WINDOW = 13
#: Words of the benchmark up to which it is broadcast.
BROADCAST_WORDS = 200_000
DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), DELIMITERS), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def runs(words_: Column, t: int) -> Column:
    """array<struct<fp,t,first,after>>: windows first..after-1 (starts, from 0) of t words share the fingerprint fp."""
    k = (t + 1) // 2 - (t > 8)
    w = t - k + 1
    size = F.size(words_)

    def of_hashes(h: Column) -> Column:
        grams = F.transform(F.slice(h, 1, F.size(h) - (k - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]))
        return let(grams, of_grams)

    def of_grams(g: Column) -> Column:
        least = (lambda x, i: F.least(x, *[F.get(g, i + j) for j in range(1, w)])) if w > 1 else (lambda x, i: x)
        return let(F.transform(F.slice(g, 1, F.size(g) - (w - 1)), least), of_windows)

    def of_windows(m: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1)))
        return let(starts, lambda s: F.transform(s, lambda i, j: F.struct(F.get(m, i).alias("fp"), F.lit(t).alias("t"), i.alias("first"), F.coalesce(F.get(s, j + 1), F.size(m)).alias("after"))))

    found = let(F.transform(words_, lambda x: F.xxhash64(x)), of_hashes)
    return F.when(size >= t, found).otherwise(F.array().cast("array<struct<fp:bigint,t:int,first:int,after:int>>"))


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, n, t, words): the items that have words, and the length of their windows."""
    return items.select("item_id", words(F.col("text")).alias("words")).withColumn("n", F.size("words")).filter("n > 0").withColumn("t", F.least("n", F.lit(window)))


def indexed(windows_of: DataFrame, lengths: list[int]) -> tuple[DataFrame, DataFrame]:
    """The distinct fingerprints (fp, t) of the benchmark, and its windows (window, items)."""
    each = [windows_of.filter(F.col("t") == t) for t in lengths]
    prints = reduce(DataFrame.unionByName, [x.select(F.inline(runs(F.col("words"), t))).select("fp", "t").distinct() for x, t in zip(each, lengths, strict=True)])
    windows = windows_of.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.col("n") - F.col("t") + 1), lambda i: F.slice("words", i, F.col("t")))).alias("window"))
    return prints, windows.groupBy("window").agg(F.collect_set("item_id").alias("items"))


def text_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def merged(tried: DataFrame, *more: Column) -> DataFrame:
    """One row a document from rows (rid, doc_id, n, start, t, items), of which those with a start were hit."""
    span = F.when(F.col("start") >= 0, F.struct(F.col("start").alias("first"), (F.col("start") + F.col("t")).alias("after")))
    return tried.groupBy("rid").agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), F.max("n").alias("n"), F.collect_set(span).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), *more)


def hits(docs: DataFrame, prints: DataFrame, windows: DataFrame, lengths: list[int], with_key: bool) -> DataFrame:
    """(rid, doc_id, n, spans, items) of every row of docs, and key if asked for; the benchmark is broadcast."""
    key = [text_key(F.col("text")).alias("key")] if with_key else []
    keys = ["key"] if with_key else []
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", words(F.col("text")).alias("words"), *key)
    # First of all runs is one that stands for the document itself, so that one pass also returns what has no hit.
    itself = F.array(F.struct(F.lit(None).cast("long").alias("fp"), F.lit(0).alias("t"), F.lit(-1).alias("first"), F.lit(0).alias("after")))
    rows = rows.select("rid", "doc_id", "words", *keys, F.size("words").alias("n"), F.concat(itself, *[runs(F.col("words"), t) for t in lengths]).alias("runs"))
    met = rows.select("rid", "doc_id", "words", "n", *keys, F.inline("runs"))
    met = met.join(F.broadcast(prints.withColumn("met", F.lit(True))), ["fp", "t"], "left").filter("met OR first < 0")
    starts = F.when(F.col("first") < 0, F.array(F.lit(-1))).otherwise(F.sequence(F.col("first"), F.col("after") - 1))
    tried = met.select("rid", "doc_id", "n", "t", "words", *keys, F.explode(starts).alias("start"))
    tried = tried.select("rid", "doc_id", "n", "t", "start", *keys, F.when(F.col("start") >= 0, F.slice("words", F.col("start") + 1, F.col("t"))).alias("window"))
    tried = tried.join(F.broadcast(windows), "window", "left").filter("start < 0 OR items IS NOT NULL")
    return merged(tried, *[F.first("key").alias("key")] * with_key)


def shuffled_hits(docs: DataFrame, prints: DataFrame, windows: DataFrame, lengths: list[int], with_key: bool) -> DataFrame:
    """As hits(), with a benchmark too large to broadcast. The rows are written once, so that their numbers hold."""
    key = [text_key(F.col("text")).alias("key")] if with_key else []
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", words(F.col("text")).alias("words"), *key), "words")
    prints, windows = materialize(prints, "prints"), materialize(windows, "windows")
    own = rows.select("rid", F.inline(F.concat(*[runs(F.col("words"), t) for t in lengths])))
    # How many runs share a print of the benchmark is counted with partial sums before anything is joined by it.
    counted = own.groupBy("fp", "t").agg(F.count(F.lit(1)).alias("n")).join(prints, ["fp", "t"])
    met = salted_join(own, materialize(counted, "met"), ["fp", "t"], "n").filter("n IS NOT NULL")
    met = met.groupBy("rid").agg(F.collect_list(F.struct("t", "first", "after")).alias("runs"))
    tried = rows.join(met, "rid").select("rid", "words", F.inline("runs")).select("rid", "words", "t", F.explode(F.sequence(F.col("first"), F.col("after") - 1)).alias("start"))
    tried = materialize(tried.select("rid", "t", "start", F.slice("words", F.col("start") + 1, F.col("t")).alias("window")), "tried")
    counted = tried.groupBy("window").agg(F.count(F.lit(1)).alias("n")).join(windows, "window")
    found = salted_join(tried, materialize(counted, "found"), ["window"], "n").filter("items IS NOT NULL").select("rid", "t", "start", "items")
    none = F.lit(None)
    itself = rows.select("rid", "doc_id", F.size("words").alias("n"), none.cast("int").alias("t"), F.lit(-1).alias("start"), none.cast(found.schema["items"].dataType).alias("items"), *["key"] * with_key)
    hit = found.select("rid", none.cast(rows.schema["doc_id"].dataType).alias("doc_id"), none.cast("int").alias("n"), "t", "start", "items", *[none.cast("string").alias("key")] * with_key)
    return merged(itself.unionByName(hit), *[F.first("key", ignorenulls=True).alias("key")] * with_key)


def contamination(docs: DataFrame, items: DataFrame, broadcast_words: int = BROADCAST_WORDS, with_key: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans (words from, to) and,
    if asked for, key, a digest of the text."""
    held = materialize(benchmark_windows(items), "benchmark")
    total = held.agg(F.sum("n").alias("n"), F.collect_set("t").alias("t")).first()
    lengths = sorted(total["t"]) or [WINDOW]
    how = hits if (total["n"] or 0) <= broadcast_words else shuffled_hits
    out = how(docs, *indexed(held, lengths), lengths, with_key)
    start = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"))
    add = lambda a, x: F.struct((a["hit"] + F.greatest(F.lit(0), x["after"] - F.greatest(x["first"], a["end"]))).alias("hit"), F.greatest(a["end"], x["after"]).alias("end"))
    n_hit = F.aggregate(F.col("spans"), start, add, lambda a: a["hit"])
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    out = out.withColumn("spans", F.array_sort("spans"))
    out = out.select("doc_id", F.col("n").cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), F.col("spans").alias("hit_spans"), *["key"] * with_key)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows that are not contaminated, with their columns."""
    judged = contamination(docs, items, with_key=True).select("doc_id", "key", F.col("contaminated").alias("gone"))
    return without(docs, judged, "contaminated", lambda rows, key: rows.withColumn(key, text_key(F.col("text"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bt AS (SELECT item_id, w, least(13, len(w)) AS t FROM bw WHERE len(w) > 0),
bx AS (SELECT DISTINCT item_id, t, list_slice(w, i, i + t - 1) AS win FROM (SELECT item_id, w, t, unnest(range(1, len(w) - t + 2)) AS i FROM bt)),
ts AS (SELECT DISTINCT t FROM bt),
dx AS (SELECT doc_id, i, t, list_slice(w, i, i + t - 1) AS win FROM (SELECT doc_id, w, t, unnest(range(1, len(w) - t + 2)) AS i FROM dw, ts WHERE len(w) >= t)),
hit AS (SELECT dx.doc_id, dx.i, dx.t, bx.item_id FROM dx JOIN bx ON dx.t = bx.t AND dx.win = bx.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + t)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(dw.w) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
