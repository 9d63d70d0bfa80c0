"""URL filters: a list of host and path rules, and association rules mined by FP-growth for what the list leaves open
(DataFrame functions and Spark ML only).

A listed rule (host, path) fits its host and all subdomains if the url's path starts with the rule's; the longest that
fits decides. The verdicts of the list are the labels to learn from: the tokens of each labelled url (labels of the
host, words of the path, keys of the query) and its verdict are one transaction. Tokens that stand in exactly the same
transactions are one item for mining, so that a site whose urls share many tokens does not ask for all their subsets. No
item, set or rule is left out but what another rule makes useless: the mined rules "tokens -> verdict" are all that have
the confidence and support asked for, whose tokens are closed (no other token is in all of their urls, so that nothing is
concluded from what only stood beside the reason) and which no rule of fewer tokens makes redundant. FP-growth mines a
database as it is if its transactions have ITEMS items at most once condensed(); else it is divided into the conditional
databases of its items, as FP-growth itself goes on, which are condensed and mined or divided in turn. So ITEMS bounds what
is enumerated without condensing (2 ** ITEMS sets a transaction), not what is found; what tokens that vary freely cost
is in the README. The inverted index has each rule under its rarest token and is broadcast in blocks of about BLOCK_RULES
rules, so that each is of bounded size; no rule is left out. The most confident rule decides; without one, the page is allowed.

Cases: a null url, or one without "://", has empty host and path, no listed rule and no token: it is allowed. Without
labelled urls nothing is mined. Repeated rows are returned each; null page_ids are kept; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import drop, lower_ascii, materialize, table

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
SUPPORT, CONFIDENCE, BLOCK_RULES = 0.005, 0.9, 2_000
#: Databases with rows of more than ITEMS items are divided; lists of up to BROADCAST_ITEMS conditional items are broadcast.
ITEMS, BROADCAST_ITEMS = 12, 100_000
LABEL = "verdict="


def host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host_: Column, path_: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (null: none) and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host_: Column, path_: Column) -> Column:
    """Distinct tokens: h: labels of the host and their parts, p: words of the path, q: keys of the query."""
    mark = lambda kind, words: F.transform(F.filter(words, lambda w: (w != "") & ~w.rlike("^[0-9]+$")), lambda w: F.concat(F.lit(kind), w))
    labels = F.split(host_, r"\.")
    keys = F.regexp_extract_all(F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("")), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))
    return F.array_distinct(F.concat(mark("h:", F.concat(labels, F.flatten(F.transform(labels, lambda x: F.split(x, "-"))))), mark("p:", F.split(F.lower(path_), r"[/._-]+")), mark("q:", keys)))


def numbered(labelled: DataFrame, support: float) -> tuple[DataFrame, DataFrame]:
    """labelled (rid, tokens, verdict) as (rid, verdict, items), and the frequent items: item (a number, the rarest has the
    highest) and parts (the tokens that always stand together). items are sorted."""
    total = labelled.count()
    held = labelled.select("rid", F.explode("tokens").alias("token"))
    seen = held.groupBy("token").agg(F.count(F.lit(1)).alias("freq"), *same_rows()).filter(F.col("freq") >= support * total)
    items = seen.groupBy("freq", "a", "b").agg(F.array_sort(F.collect_list("token")).alias("parts"))
    # At most the length of a url over support of them; numbered by frequency and first token, so the same whatever the plan.
    items = items.agg(F.array_sort(F.collect_list(F.struct((-F.col("freq")).alias("rank"), "parts"))).alias("all"))
    items = materialize(items.select(F.posexplode("all").alias("item", "of")).select("item", "of.parts"), "items")
    of = items.select(F.col("parts")[0].alias("token"), "item")
    own = held.join(F.broadcast(of), "token").groupBy("rid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    # A left join, so that Spark broadcasts no labelled rows.
    out = labelled.join(own, "rid", "left").select("rid", "verdict", F.coalesce("items", F.array().cast("array<int>")).alias("items"))
    return materialize(out, "transactions"), items


def same_rows() -> list[Column]:
    """Two sums over the hashes of rows: with their number, groups that agree in them have the same rows."""
    return [F.sum(F.xxhash64("rid", F.lit(salt)).cast("decimal(20,0)")).alias(name) for salt, name in ((1, "a"), (2, "b"))]


def condensed(open_: DataFrame, least: int, confidence: float) -> tuple[DataFrame, DataFrame]:
    """Of conditional databases (target, prefix, bad_before, rid, hit, items): the rules of their prefix and one item
    (target, items, confidence, good), and their rows (items: structs of item, good, bad) without the items that no better rule needs.

    Rows that hit have the target's verdict; bad counts the others. Left out are items in too few rows that hit; items in no
    other row, as nothing betters their rule; items in all other rows, as they raise no rule's confidence; of items in
    the same rows all but one; and, where rows are long, items whose rows that hit are too few against the other rows that
    have all items of the database: whatever the rule, these stay.
    """
    each = open_.select("target", "prefix", "bad_before", "rid", "hit", F.explode("items").alias("item"))
    count = lambda what: F.sum(F.when(what, 1).otherwise(0))
    seen = each.groupBy("target", "prefix", "bad_before", "item").agg(count(F.col("hit")).alias("good"), count(~F.col("hit")).alias("bad"), *same_rows())
    seen = seen.filter(F.col("good") >= least).groupBy("target", "prefix", "bad_before", "good", "bad", "a", "b").agg(F.min("item").alias("item"))
    seen = materialize(seen.drop("a", "b"), "conditional-items")
    sure = F.col("good") / (F.col("good") + F.col("bad"))
    rules = seen.filter(sure >= confidence).select("target", F.array_sort(F.array_append("prefix", F.col("item"))).alias("items"), sure.alias("confidence"), "good")
    useful = seen.filter("bad > 0 AND bad < bad_before").select("target", "prefix", "item", "good", "bad")
    few = F.broadcast if useful.count() <= BROADCAST_ITEMS else lambda df: df
    kept = each.join(few(useful), ["target", "prefix", "item"]).groupBy("target", "prefix", "rid", "hit").agg(F.array_sort(F.collect_list(F.struct("item", "good", "bad"))).alias("items"))
    kept = materialize(kept, "kept")
    if kept.filter(F.size("items") > ITEMS).isEmpty():  # nothing to divide
        return rules, kept
    wide = useful.groupBy("target", "prefix").agg(F.count(F.lit(1)).alias("wide"))
    stay = kept.filter("NOT hit").join(few(wide), ["target", "prefix"]).groupBy("target", "prefix").agg(count(F.size("items") == F.col("wide")).alias("stay"))
    stay = materialize(stay, "stay")
    able = kept.join(few(stay), ["target", "prefix"]).withColumn("items", F.filter("items", lambda x: x["good"] / (x["good"] + F.col("stay")) >= confidence))
    able = materialize(able.filter(F.size("items") > 0).drop("stay"), "condensed")
    drop(kept, stay)
    return rules, able


def grown(rows: DataFrame, least: int, confidence: float) -> DataFrame:
    """The rules (target, items, confidence, good) that FP-growth finds in conditional databases (target, prefix, hit, items), all
    at once: each one's items have names of its own."""
    own = F.concat_ws("|", F.array_join(F.col("prefix").cast("array<string>"), "."), "target")
    named = F.transform(F.col("items"), lambda x: F.concat_ws("|", x.cast("string"), own))
    rows = materialize(rows.select(F.when(F.col("hit"), F.array_append(named, F.concat_ws("|", F.lit(LABEL), own))).otherwise(named).alias("items")), "grown")
    n = rows.count()
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(n, 1))).fit(rows).freqItemsets
    # A rule's confidence asks for two sets, with and without the label; FPGrowth's own rules would be made for every item of a set.
    sets = materialize(sets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    label = F.get(F.filter("items", lambda x: x.startswith(LABEL + "|")), F.lit(0))
    bare = sets.filter(label.isNull()).withColumnRenamed("freq", "all")
    met = sets.filter(label.isNotNull() & (F.size("items") > 1)).select(label.alias("label"), F.array_remove("items", label).alias("items"), F.col("freq").alias("good")).join(bare, "items")
    where = F.split("label", r"\|", 3)
    prefix = F.filter(F.split(where[1], r"\."), lambda x: x != "")
    items = F.concat(prefix, F.transform("items", lambda x: F.substring_index(x, "|", 1)))
    sure = F.col("good") / F.col("all")
    return met.filter(sure >= confidence).select(where[2].alias("target"), F.array_sort(items.cast("array<int>")).alias("items"), sure.alias("confidence"), "good")


def without_plainly_redundant(rules: DataFrame) -> DataFrame:
    """Rules (target, items, confidence and more) without those of which another with all their items but one has their target
    with as much confidence: most redundant ones, and cheap to find."""
    part = rules.select("target", "items", "confidence", F.explode("items").alias("x")).select("target", "items", "confidence", F.array_remove("items", F.col("x")).alias("part"))
    general = rules.select("target", F.col("items").alias("part"), F.col("confidence").alias("known"))
    redundant = part.join(general, ["target", "part"]).filter("known >= confidence").select("target", "items").distinct()
    return rules.join(redundant, ["target", "items"], "left_anti")


def without_redundant(rules: DataFrame) -> DataFrame:
    """Rules (target, items, confidence and more) without those of which another with some of their items, but not all, has their
    target with as much confidence. Each rule is looked up under its rarest item."""
    known = rules.select("target", F.array_max("items").alias("item"), F.col("items").alias("part"), F.col("confidence").alias("known"))
    met = rules.select("target", "items", "confidence", F.explode("items").alias("item")).join(known, ["target", "item"])
    met = met.filter((F.col("known") >= F.col("confidence")) & (F.size("part") < F.size("items")) & (F.size(F.array_except("part", "items")) == 0))
    return rules.join(met.select("target", "items").distinct(), ["target", "items"], "left_anti")


def closed(rules: DataFrame, transactions: DataFrame) -> DataFrame:
    """Rules (target, items, ...) with the items that all transactions with theirs have."""
    sets = materialize(rules.select("items").distinct(), "sets")
    kinds = transactions.groupBy("items").agg(F.count(F.lit(1)).alias("n")).select(F.col("items").alias("row"), "n")
    met = kinds.select("row", "n", F.explode("row").alias("key")).join(sets.select("items", F.array_max("items").alias("key")), "key")
    met = met.filter(F.size(F.array_except("items", "row")) == 0).select("items", "n", F.explode("row").alias("item"))
    counts = met.groupBy("items", "item").agg(F.sum("n").alias("n"))
    whole = counts.groupBy("items").agg(F.collect_list(F.struct("n", "item")).alias("all"), F.max("n").alias("freq"))
    # An item of the set itself is in all its rows, so the largest count is theirs.
    whole = whole.select("items", F.array_sort(F.transform(F.filter("all", lambda x: x["n"] == F.col("freq")), lambda x: x["item"])).alias("whole"))
    return rules.join(whole, "items").select(*[F.col("whole" if c == "items" else c).alias(c) for c in rules.columns]).distinct()


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules (tokens, verdict, confidence, support, key) from labelled (tokens, verdict); key is the rarest token."""
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "tokens array<string>, verdict string, confidence double, support double, key string")
    if labelled.isEmpty():
        return empty
    labelled = materialize(labelled.select(F.monotonically_increasing_id().alias("rid"), F.array_distinct("tokens").alias("tokens"), "verdict"), "labelled")
    total = labelled.count()
    least = max(1, math.ceil(support * total))
    transactions, items = numbered(labelled, support)
    targets = labelled.groupBy(F.col("verdict").alias("target")).agg((F.lit(total) - F.count(F.lit(1))).alias("bad_before"))
    open_ = transactions.crossJoin(F.broadcast(targets)).select("target", F.array().cast("array<int>").alias("prefix"), "bad_before", "rid", (F.col("verdict") == F.col("target")).alias("hit"), "items")
    rules, short = [], []
    while True:
        found, rows = condensed(open_, least, confidence)
        drop(open_)
        rules.append(found)
        long = materialize(rows.groupBy("target", "prefix").agg(F.max(F.size("items")).alias("most")).filter(F.col("most") > ITEMS).select("target", "prefix"), "long")
        rest = rows.join(long, ["target", "prefix"], "left_anti")
        short.append(rest.select("target", "prefix", "hit", F.transform("items", lambda x: x["item"]).alias("items")))
        if long.isEmpty():
            break
        # Each set of items is found where its rarest one is the condition.
        parts = rows.join(long, ["target", "prefix"], "left_semi").select("*", F.posexplode("items").alias("place", "last")).filter("place > 0")
        open_ = materialize(parts.select("target", F.array_append("prefix", F.col("last.item")).alias("prefix"), F.col("last.bad").alias("bad_before"), "rid", "hit", F.transform(F.slice("items", F.lit(1), F.col("place")), lambda x: x["item"]).alias("items")), "conditional")
    rules.append(grown(reduce(DataFrame.unionByName, short), least, confidence))
    rules = without_plainly_redundant(materialize(reduce(DataFrame.unionByName, rules).distinct(), "rules"))
    rules = without_redundant(materialize(closed(rules, transactions), "closed"))
    # An item's tokens stand together, so all of them make up the rule; its rarest one is the key.
    placed = rules.select("*", F.explode("items").alias("item")).join(F.broadcast(items), "item")
    out = placed.groupBy("items", "target", "confidence", "good").agg(F.array_sort(F.flatten(F.collect_list("parts"))).alias("tokens"), F.max_by(F.col("parts")[0], "item").alias("key"))
    return materialize(out.select("tokens", F.col("target").alias("verdict"), "confidence", (F.col("good") / total).alias("support"), "key"), "index")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, and mined: the tokens that decided, if any."""
    h, p = F.col("host"), F.col("path")
    rule, verdict = listed(h, p, rules)
    each = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    each = each.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("listed"), tokens(F.col("url"), h, p).alias("tokens"))
    mined = mine(each.filter("listed IS NOT NULL").select("tokens", F.col("listed").alias("verdict")), support, confidence)
    index = mined.select("key", F.struct("confidence", "support", F.col("tokens").alias("mined"), "verdict").alias("found"))
    blocks = max(1, -(-mined.count() // BLOCK_RULES))
    # The empty key stands for the page itself, which so stays without a rule; pages that the list decides look nothing up.
    keys = F.when(F.col("listed").isNull(), F.array_append("tokens", F.lit(""))).otherwise(F.array(F.lit("")))
    each = each.withColumn("rid", F.monotonically_increasing_id())
    each = (materialize(each, "pages") if blocks > 1 else each).withColumn("key", F.explode(keys))
    tried = each.join(F.broadcast(index.filter(F.pmod(F.xxhash64("found.mined"), F.lit(blocks)) == 0)), "key", "left")
    for i in range(1, blocks):
        own = F.broadcast(index.filter(F.pmod(F.xxhash64("found.mined"), F.lit(blocks)) == i))
        tried = tried.unionByName(each.join(own, "key"))
    tried = tried.filter("key = '' OR (found IS NOT NULL AND size(array_except(found.mined, tokens)) = 0)")
    best = tried.groupBy("rid").agg(*[F.first(c).alias(c) for c in ("page_id", "host", "path", "rule", "listed")], F.max("found").alias("found"))
    return best.select("page_id", "host", "path", "rule", F.coalesce("listed", "found.verdict", F.lit("allow")).alias("verdict"), F.col("found.mined").alias("mined"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
