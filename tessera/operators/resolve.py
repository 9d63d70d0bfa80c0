"""Resolution of names to definitions: the best one of a request, and that of each reference.

Names are compared without case. Where many definitions share a name, the best of each key is found by one aggregation
and references join at most one row a tier, so a name that all files use costs no more rows than it has references, and
these are spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.search import Filters, ordered
from tessera.plans import shared

TARGET = ("root", "path", "start", "kind", "name")
ONE_IN = 64
COMPATIBLE = {"typescript": ("typescript", "tsx"), "tsx": ("typescript", "tsx")}


def resolve_definition(definitions: DataFrame, name: str, filters: Filters = Filters()) -> DataFrame:  # noqa: B008
    """The best definition of exactly this name (no row: not found): the file the prefix names first, then root, path, place."""
    found = definitions.filter(filters.definitions() & (F.lower("name") == name.strip().lower()))
    away = F.when(F.col("path") == filters.prefix, 0).otherwise(10) if filters.prefix else F.lit(0)
    return ordered(found.withColumn("penalty", away), [F.col("penalty"), F.col("root"), F.col("path"), F.col("start")], 1).drop("penalty", "rank")


def best(definitions: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """One definition a key: the least by `order`, as the struct `name`."""
    row = F.struct(*[F.col(c).alias(c) for c in dict.fromkeys([*order, *TARGET])])
    return definitions.withColumn("lname", F.lower("name")).groupBy(*keys, "lname").agg(F.min(row).alias(name))


def hot_names(references: DataFrame, place: Column) -> DataFrame:
    """(language, lname, hot) of the names most used, HOT_KEYS at most: those with over HOT_ROWS references by the count of
    one in ONE_IN of them, by the hash of their place. It only decides how rows are dealt out, not what joins."""
    some = references.filter(F.pmod(place, F.lit(ONE_IN)) == 0).groupBy("language", F.lower("name").alias("lname")).agg((ONE_IN * F.count(F.lit(1))).alias("uses"))
    return some.filter(F.col("uses") > shared.HOT_ROWS).orderBy(F.desc("uses")).limit(shared.HOT_KEYS).select("language", "lname", F.lit(True).alias("hot"))


def three_tiers(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """References with `target`, the definition of their name and language in the same file, else the same root, else
    anywhere (least path and place; anywhere: root first), and `tier` 0, 1 or 2; unresolved ones have nulls.

    Each join has one row a name on its right. References of the names most used are spread by a salt, by which the
    definitions of these names, few as they are, are copied.
    """
    pick = lambda c: F.struct(*[F.col(f"{c}.{k}").alias(k) for k in TARGET])
    in_file = best(definitions, ["language", "root", "path"], ["start"], "t0")
    in_root = best(definitions, ["language", "root"], ["path", "start"], "t1")
    anywhere = best(definitions, ["language"], ["root", "path", "start"], "t2")
    place = F.xxhash64("root", "path", "start")
    hot = F.broadcast(hot_names(references, place))
    copies = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(shared.SALTS - 1))).otherwise(F.array(F.lit(-1)))
    copied = lambda df: df.join(hot, ["language", "lname"], "left").withColumn("salt", F.explode(copies)).drop("hot")
    out = references.withColumn("lname", F.lower("name")).join(in_file, ["language", "root", "path", "lname"], "left").join(hot, ["language", "lname"], "left")
    out = out.withColumn("salt", F.when(F.col("hot"), F.pmod(place, F.lit(shared.SALTS)).cast("int")).otherwise(-1)).drop("hot")
    out = out.join(copied(in_root), ["language", "root", "lname", "salt"], "left").join(copied(anywhere), ["language", "lname", "salt"], "left")
    tier = F.when(F.col("t0").isNotNull(), 0).when(F.col("t1").isNotNull(), 1).when(F.col("t2").isNotNull(), 2)
    target = F.when(F.col("t0").isNotNull(), pick("t0")).when(F.col("t1").isNotNull(), pick("t1")).when(F.col("t2").isNotNull(), pick("t2"))
    return out.select(*references.columns, target.alias("target"), tier.alias("tier"))


def owners(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """References with `owner`: the first definition in their file with the name and kind of what encloses them."""
    held = best(definitions, ["language", "root", "path", "kind"], ["start"], "own").withColumnsRenamed({"kind": "encl_kind", "lname": "lencl"})
    out = references.withColumn("lencl", F.lower("encl_name")).join(held, ["language", "root", "path", "encl_kind", "lencl"], "left")
    owner = F.when(F.col("own").isNotNull(), F.struct(*[(F.col("encl_kind") if k == "kind" else F.col(f"own.{k}")).alias(k) for k in TARGET]))
    return out.select(*references.columns, owner.alias("owner"))


def named(references: DataFrame, definitions: DataFrame, known: bool = True) -> DataFrame:
    """References whose name some definition of their language has, or with known=False those whose name none has."""
    names = definitions.select("language", F.lower("name").alias("lname")).distinct()
    out = references.withColumn("lname", F.lower("name")).join(names, ["language", "lname"], "left_semi" if known else "left_anti")
    return out.select(*references.columns)


def best_of_each(definitions: DataFrame) -> DataFrame:
    """The definition that each name resolves to, compared without case: least root, path and place."""
    return best(definitions, [], ["root", "path", "start"], "found").select("lname", "found.*")


def nearest_before(rows: DataFrame, keys: list[str], place: str, scope: Column, name: str) -> DataFrame:
    """rows with `name`: the place of the last row before, among those of the same keys, that is a scope."""
    before = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.max(F.when(scope, F.col(place))).over(before))


def language_pairs(spark: SparkSession, compatible_: dict[str, tuple[str, ...]] = COMPATIBLE) -> DataFrame:
    """(language, other): languages whose references can mean each other's definitions; one without an entry, its own alone."""
    return spark.createDataFrame([(k, o) for k, others in compatible_.items() for o in others], "language string, other string")


def compatible(language: str) -> Column:
    """Rows of a language whose references can mean definitions of this one."""
    return F.col("language").isin(list(COMPATIBLE.get(language, (language,))))


def references_to(references: DataFrame, target: dict) -> DataFrame:
    """References to the target's name in compatible languages, but for the target's own name."""
    same = F.lower("name") == target["name"].lower()
    itself = (F.col("root") == target["root"]) & (F.col("path") == target["path"]) & (F.col("start") == target["start"])
    return references.filter(same & compatible(target["language"]) & ~itself)
