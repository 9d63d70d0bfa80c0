"""Complexity, callers and symbol context from the rows that frontends emit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import half_up, snippet

MODULE = "(module level)"


def function_metrics(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Per function: 1 + branch nodes, statements, greatest branch depth, lines.

    nodes: one row a syntax node with the keys of its function, is_branch, is_statement, depth (branches above it) and line.
    """
    return nodes.groupBy(*keys).agg(
        (1 + F.sum(F.col("is_branch").cast("long"))).alias("cyclomatic_complexity"),
        F.sum(F.col("is_statement").cast("long")).alias("statement_count"),
        F.max("depth").cast("long").alias("max_nesting_depth"),
        (F.max("line") - F.min("line") + 1).cast("long").alias("lines_of_code"),
    )


def complexity_summary(metrics: DataFrame) -> DataFrame:
    """Total functions, average complexity (half up, 2 places) and the greatest; zeros without functions."""
    c = F.col("cyclomatic_complexity")
    return metrics.agg(F.count(F.lit(1)).alias("total"), F.coalesce(half_up(F.avg(c)), F.lit(0.0)).alias("average"), F.coalesce(F.max(c), F.lit(0)).cast("long").alias("greatest"))


def find_callers(call_sites: DataFrame, symbol: str, depth: int = 2) -> DataFrame:
    """Call sites whose callee is exactly the symbol and whose chain of enclosing functions is at most `depth` long."""
    found = call_sites.filter((F.col("callee") == symbol) & (F.size("chain") <= depth))
    return found.withColumn("function_name", F.when(F.size("chain") > 0, F.element_at("chain", -1)).otherwise(MODULE)).withColumn("snippet", snippet(F.col("text"), 120))


def callees(call_sites: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct callees of each function, in the order of their first call."""
    first = call_sites.groupBy(*keys, "callee").agg(F.min("start").alias("first_start"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("first_start", "callee"))), lambda x: x["callee"]).alias("callees"))


def signature(definitions: DataFrame) -> DataFrame:
    """`name(params) -> ret` for functions and methods, `class name extends base` for classes."""
    params = F.concat(F.lit("("), F.coalesce("params", F.lit("")), F.lit(")"))
    tail = F.when(F.col("returns").isNotNull(), F.concat(F.lit(" -> "), "returns")).otherwise("")
    base = F.when(F.col("base").isNotNull(), F.concat(F.lit(" extends "), "base")).otherwise("")
    return definitions.withColumn("signature", F.when(F.col("kind").isin("class", "interface"), F.concat("kind", F.lit(" "), "name", base)).otherwise(F.concat("name", params, tail)))
