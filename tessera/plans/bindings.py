"""The driver's tables as the engine's relations, in DataFrames and as SQL common table expressions.

entity: `part` as definitions. text: lines of `documents`; the first word of a line is a definition, the others refer.
graph: keys of the star schema as nodes, foreign keys as links. paths: `pages`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = F.concat(F.lit("w"), (F.col("p_size") % 3).cast("string"))
    path = F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select(root.alias("root"), path.alias("path"), F.col("p_brand").alias("language"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"), F.col("p_partkey").alias("start"))


ENTITY = """
defs AS (SELECT 'w' || (p_size % 3) AS root, p_brand || '/' || p_partkey AS path, p_brand AS language, p_type AS kind, p_name AS name, p_partkey AS start FROM part)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as files: root, path, language, content."""
    path = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("root"), path.alias("path"), F.col("lang").alias("language"), F.col("text").alias("content"))


FILES = "files AS (SELECT source AS root, lang || '/' || doc_id AS path, lang AS language, text AS content FROM documents)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with words: root, path, language, line, words (not empty)."""
    each = files(spark, sf_dir).select("root", "path", "language", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    return each.select("root", "path", "language", "line", F.filter(F.split("text", " "), lambda w: w != "").alias("words")).filter(F.size("words") > 0)


LINES = FILES + """,
lines0 AS (SELECT root, path, language, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line FROM files),
lines AS (SELECT * FROM (SELECT root, path, language, line, list_filter(string_split(text, ' '), lambda w: w <> '') AS words FROM lines0) WHERE len(words) > 0)"""


def line_kind():
    return F.when(F.col("line") % 2 == 0, "function").otherwise("class")


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("line").cast("long") * LINE
    return lines(spark, sf_dir).select("root", "path", "language", line_kind().alias("kind"), F.col("words")[0].alias("name"), start.alias("start"), (start + LINE - 1).alias("stop"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words after the first: calls where they end with a stop or a comma; each third line encloses nothing."""
    held = F.when(F.col("line") % 3 != 2, F.col("words")[0])
    each = lines(spark, sf_dir).select("root", "path", "language", "line", held.alias("encl_name"), line_kind().alias("encl_kind"), F.posexplode("words").alias("place", "name")).filter("place > 0")
    call = F.when(F.col("name").endswith(".") | F.col("name").endswith(","), "call").otherwise("reference")
    return each.select("root", "path", "language", call.alias("ref_kind"), "name", (F.col("line").cast("long") * LINE + F.col("place")).alias("start"), "encl_name", "encl_kind")


TEXT = LINES + f""",
defs AS (SELECT root, path, language, CASE WHEN line % 2 = 0 THEN 'function' ELSE 'class' END AS kind, words[1] AS name, line * {LINE} AS start, line * {LINE} + {LINE - 1} AS stop FROM lines),
refs0 AS (SELECT root, path, language, line, CASE WHEN line % 3 <> 2 THEN words[1] END AS encl_name, CASE WHEN line % 2 = 0 THEN 'function' ELSE 'class' END AS encl_kind, unnest(words) AS name, generate_subscripts(words, 1) - 1 AS place FROM lines),
refs AS (SELECT root, path, language, CASE WHEN name LIKE '%.' OR name LIKE '%,' THEN 'call' ELSE 'reference' END AS ref_kind, name, line * {LINE} + place AS start, encl_name, encl_kind FROM refs0 WHERE place > 0)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, kind, target) between keys: customer > order > part and supplier > nation > region."""
    key = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    t = lambda name: table(spark, sf_dir, name)
    row = lambda df, a, kind, b: df.select(a.alias("source"), F.lit(kind).alias("kind"), b.alias("target"))
    out = row(t("orders"), key("customer", "o_custkey"), "call", key("order", "o_orderkey"))
    out = out.unionByName(row(t("lineitem"), key("order", "l_orderkey"), "reference", key("part", "l_partkey")).distinct())
    out = out.unionByName(row(t("lineitem"), key("order", "l_orderkey"), "call", key("supplier", "l_suppkey")).distinct())
    out = out.unionByName(row(t("supplier"), key("supplier", "s_suppkey"), "call", key("nation", "s_nationkey")))
    out = out.unionByName(row(t("customer"), key("customer", "c_custkey"), "reference", key("nation", "c_nationkey")))
    return out.unionByName(row(t("nation"), key("nation", "n_nationkey"), "reference", key("region", "n_regionkey")))


LINKS = """
links AS (
  SELECT 'customer:' || o_custkey AS source, 'call' AS kind, 'order:' || o_orderkey AS target FROM orders
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'reference', 'part:' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'call', 'supplier:' || l_suppkey FROM lineitem
  UNION ALL SELECT 'supplier:' || s_suppkey, 'call', 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'reference', 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'nation:' || n_nationkey, 'reference', 'region:' || n_regionkey FROM nation)"""
