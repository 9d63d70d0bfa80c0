"""Filters, ranked search, pages and their summaries over definitions.

Definitions have root, path, language, kind, name, start and more columns; files have root, path, language.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import in_locale, name_score, under

MAX_PAGE, PAGE = 200, 50


@dataclass(frozen=True)
class Filters:
    """What a request restricts: roots in order (empty: all), language, path prefix, kinds."""

    roots: list[str] = field(default_factory=list)
    language: str | None = None
    prefix: str | None = None
    kinds: list[str] = field(default_factory=list)

    def files(self) -> Column:
        parts = [F.lit(True)]
        if self.roots:
            parts.append(F.col("root").isin(self.roots))
        if self.language:
            parts.append(F.col("language") == self.language)
        if self.prefix and self.prefix != ".":
            parts.append(under(F.col("path"), self.prefix))
        return reduce(lambda a, b: a & b, parts)

    def definitions(self) -> Column:
        return self.files() & F.col("kind").isin(self.kinds) if self.kinds else self.files()


def root_place(roots: list[str], root: Column | None = None) -> Column:
    """The place of a row's root among the configured ones; unknown roots come last."""
    root = F.col("root") if root is None else root
    out = F.lit(float(len(roots)))  # a whole number alone would be read as the number of a column
    for i, r in reversed(list(enumerate(roots))):
        out = F.when(root == r, float(i)).otherwise(out)
    return out


def by_path(*columns: str, locale: bool) -> list[Column]:
    """Keys that sort by these text columns, with `locale` in dictionary order."""
    return [in_locale(F.col(c)) if locale else F.col(c) for c in columns]


def ordered(df: DataFrame, keys: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """The rows offset..offset+limit of df in this order, with their rank (from 1).

    The limit is applied first (a top-k a task), so only a page of rows is ever numbered in one place.
    """
    top = df.orderBy(*keys).limit(offset + limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*keys))).filter(F.col("rank") > offset)


def scored(definitions: DataFrame, query: str, filters: Filters) -> DataFrame:
    return definitions.filter(filters.definitions()).withColumn("score", name_score(F.col("name"), query)).filter("score IS NOT NULL")


def search(definitions: DataFrame, query: str, filters: Filters = Filters(), roots: list[str] | None = None, limit: int = PAGE, locale: bool = False) -> DataFrame:  # noqa: B008
    """The best matches by score, root order, path (with `locale` in dictionary order) and place. An empty query finds nothing."""
    if not query.strip():
        return definitions.withColumn("score", F.lit(0)).withColumn("rank", F.lit(0)).limit(0)
    keys = [F.col("score"), root_place(roots or filters.roots), *by_path("root", "path", locale=locale), F.col("start")]
    return ordered(scored(definitions, query, filters), keys, min(limit, MAX_PAGE))


def page_facts(total: DataFrame, limit: int, offset: int) -> DataFrame:
    """One row: limit, offset, returned, total, has_more, next_offset (null on the last page)."""
    returned = F.greatest(F.lit(0), F.least(F.lit(limit), F.col("total") - offset))
    more = F.col("total") > offset + returned
    return total.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(limit).alias("limit_"), F.lit(offset).alias("offset_"), returned.cast("long").alias("returned"), "total", more.alias("has_more"), F.when(more, (offset + returned).cast("long")).alias("next_offset")
    )


def breakdown(files: DataFrame, page: DataFrame, roots: list[str]) -> DataFrame:
    """Per root: files searched, distinct files on the page, rows on the page; selected roots without rows stay, with zeros."""
    searched = files.groupBy("root").agg(F.count(F.lit(1)).alias("searched_files"))
    found = page.groupBy("root").agg(F.count_distinct("path").alias("matched_files"), F.count(F.lit(1)).alias("returned_results"))
    chosen = F.broadcast(files.sparkSession.createDataFrame([(r,) for r in roots], "root string")) if roots else files.select("root").distinct()
    out = chosen.join(searched, "root", "left").join(found, "root", "left")
    return out.select("root", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("searched_files", "matched_files", "returned_results")])
