"""Snapshots compared, freshness states folded, diagnostics made distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From best to worst.
STATES = ["fresh", "refreshed", "degraded", "rebuilding"]
SNAPSHOT = ("mtime", "size", "hash")
DIAGNOSTIC = ("code", "severity", "message", "reason", "path", "root", "language")


def classify(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per file of either snapshot (root, path, mtime, size, hash): unchanged, refreshed, added or removed.

    Unchanged takes equal time, size and hash. One full outer join on the file.
    """
    o, n = old.select("root", "path", F.struct(*SNAPSHOT).alias("o")), new.select("root", "path", F.struct(*SNAPSHOT).alias("n"))
    status = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") == F.col("n"), "unchanged").otherwise("refreshed")
    return o.join(n, ["root", "path"], "full_outer").select("root", "path", status.alias("status"))


def removed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files of the old snapshot that the new one lacks."""
    return old.join(new, ["root", "path"], "left_anti").select("root", "path")


def severity(state: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STATES)), state)


def worst_state(states: DataFrame, keys: list[str]) -> DataFrame:
    """The worst state of each key."""
    out = states.groupBy(*keys).agg(F.max(severity(F.col("state"))).cast("int").alias("rank"))
    return out.select(*keys, F.element_at(F.array(*map(F.lit, STATES)), F.col("rank")).alias("state"))


def fold_states(states: DataFrame) -> DataFrame:
    """One row: the worst state of all; rebuilding if there is none."""
    worst = states.agg(F.max(severity(F.col("state"))).cast("int").alias("rank"))
    return worst.select(F.coalesce(F.element_at(F.array(*map(F.lit, STATES)), F.col("rank")), F.lit("rebuilding")).alias("state"))


def combine_freshness(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: refreshed and degraded files (sorted, distinct), latest check, worst state."""
    files = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    out = parts.groupBy(*keys).agg(files("refreshed").alias("refreshed"), files("degraded").alias("degraded"), F.max("checked_at").alias("checked_at"), F.max(severity(F.col("state"))).cast("int").alias("rank"))
    return out.withColumn("state", F.element_at(F.array(*map(F.lit, STATES)), F.col("rank"))).drop("rank")


def distinct_diagnostics(diagnostics: DataFrame, place: str = "place") -> DataFrame:
    """Equal diagnostics once, the first by place."""
    key = [c for c in DIAGNOSTIC if c in diagnostics.columns]
    rest = [c for c in diagnostics.columns if c not in key]
    return diagnostics.groupBy(*key).agg(F.min(F.struct(place, *[c for c in rest if c != place])).alias("_first")).select(*key, "_first.*")


def labels(files: DataFrame) -> DataFrame:
    """A file's label: its path, or root and path where several roots have that path."""
    twice = files.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return files.join(twice, "path").select("root", "path", F.when(F.col("n") > 1, F.concat("root", F.lit("/"), "path")).otherwise(F.col("path")).alias("label"))
