"""SimHash near-duplicates through a Gray-order hierarchical index.

A text's words are [^\\x20\\x09-\\x0D]+ after A-Z are lower-cased; its shingles are SHINGLE words joined by a space
(fewer words: all of them as one; none: fingerprint zero). A bit of the fingerprint is 1 if set in over half of the
shingles' XXH64 (seed 42). Fingerprints that differ in at most DISTANCE = 2 bits are linked; a component is what links
reach.

Equal fingerprints are one row before anything is joined, so copies cost nothing. Of four blocks of 16 bits, two are
equal in any two linked fingerprints: each fingerprint goes to six groups, by the pattern under one of six masks. The
sizes of groups are counted first; a group of over GROUP fingerprints is split by six finer masks each (48 bits, at
most 2 ** 16 fingerprints a group whatever the data), which loses no link by the same argument on the other 32 bits.

A task sorts its groups by Gray rank and builds the index over them: a node keeps the bits that all below it share
(mask and pattern); pairs of nodes descend together, and a pair whose shared bits already differ in more than two
places is pruned with all below it. A task keeps links as a forest and returns one link a fingerprint at most. The
forests' components are found by alternating large-star and small-star steps, each written to the shared folder.

Cases: a null text counts as empty. Null doc_ids are linked like others but name no component unless no one else does
(then component_id is null). Repeated rows are returned each. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import drop, mapped, materialize, salted_join, table, without

SHINGLE = 3
DISTANCE = 2
SEED = 42
#: Fingerprints in a group before it is split; a group is 8 bytes a fingerprint in the task that holds it.
GROUP = 16_384
FAN = 8
#: Pairs of nodes that descend at once.
PAIRS = 20_000
BUFFER = 100_000
CHUNK = 200_000


def fingerprint(text: bytes) -> int:
    """The fingerprint of a text in UTF-8, as a signed number."""
    words = text.lower().split()  # of bytes: both know ASCII only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = len(words)
    if n < SHINGLE:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(SHINGLE)], strict=False))
    hashes = np.array([digest(g, SEED) for g in grams], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed number) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            yield pa.record_batch([batch.column("doc_id"), pa.array([fingerprint(t.as_py() or b"") for t in texts], pa.int64())], ["doc_id", "fp"])

    return mapped(docs.select("doc_id", "text"), run, docs.select("doc_id").schema.add("fp", "long"))


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def block_mask(blocks: tuple[int, ...], width: int, places: list[int]) -> int:
    """The bits of these blocks, `width` of `places` each."""
    return sum(1 << places[b * width + i] for b in blocks for i in range(width))


#: The masks of the six kinds of groups, and the six finer ones of each.
MASKS = [block_mask(c, 16, list(range(64))) for c in combinations(range(4), 2)]
FINER = [[m | block_mask(c, 8, [i for i in range(64) if not m >> i & 1]) for c in combinations(range(4), 2)] for m in MASKS]


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The rank of each code in reflected Gray order."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def forest(group: np.ndarray, codes: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """For codes sorted by (group, Gray rank): the place of a code that each is linked to, within groups, so that
    places linked, directly or not, name the same place."""
    n = len(codes)
    label = np.arange(n)
    # levels: the nodes' patterns, masks (bits that all below share), first child and first place of a group
    levels = [(codes, np.full(n, ~np.uint64(0)), np.arange(n + 1))]
    of = group
    while True:
        codes_, masks_, _ = levels[-1]
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        if len(levels) > 1 and len(starts) == len(of):
            break
        place = np.arange(len(of)) - np.repeat(starts, np.diff(np.append(starts, len(of))))
        first = np.flatnonzero(place % FAN == 0)
        same = np.bitwise_and.reduceat(codes_ & masks_, first), np.bitwise_and.reduceat(~codes_ & masks_, first)
        levels.append((same[0], same[0] | same[1], np.append(first, len(of))))
        of = of[first]

    def join(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal label
        open_ = label[a] != label[b]
        while open_.any():
            a, b = a[open_], b[open_]
            x, y = label[a], label[b]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (low := label[label] != label).any():
                label[low] = label[label[low]]
            open_ = label[a] != label[b]

    tops = np.arange(len(of))
    todo = [(len(levels) - 1, tops, tops)]
    while todo:
        level, a, b = todo.pop()
        if len(a) > PAIRS:
            todo += [(level, a[i : i + PAIRS], b[i : i + PAIRS]) for i in range(0, len(a), PAIRS)]
            continue
        kids = levels[level][2]
        na, nb = kids[a + 1] - kids[a], kids[b + 1] - kids[b]
        sizes = na * nb
        at = np.repeat(np.arange(len(a)), sizes)
        k = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        i, j = kids[a][at] + k // nb[at], kids[b][at] + k % nb[at]
        codes_, masks_, _ = levels[level - 1]
        near = np.bitwise_count((codes_[i] ^ codes_[j]) & masks_[i] & masks_[j]) <= distance
        near &= (i < j) | ((i == j) & (level > 1))
        i, j = i[near], j[near]
        if level == 1:
            join(i, j)
        elif len(i):
            todo.append((level - 1, i, j))
    return label


def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition sorted by (kind, key): (fp, other), one for each fingerprint of a group at most."""

    def flush(kind: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        codes = fp.view(np.uint64)
        order = np.lexsort((gray_rank(codes), key, kind))
        kind, key, codes = kind[order], key[order], codes[order]
        new = np.append(True, (kind[1:] != kind[:-1]) | (key[1:] != key[:-1]))
        group = np.cumsum(new)
        size = np.bincount(group)
        keep = size[group] > 1
        group, codes = group[keep], codes[keep]
        if not len(codes):
            return pa.record_batch([pa.array([], pa.int64())] * 2, ["fp", "other"])
        label = forest(group, codes)
        linked = label != np.arange(len(label))
        pairs = np.unique(np.stack([codes[linked], codes[label[linked]]]), axis=1).view(np.int64)
        return pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], ["fp", "other"])

    held: list[tuple[np.ndarray, ...]] = []
    rows = 0
    for batch in batches:
        part = tuple(batch.column(c).to_numpy() for c in ("kind", "key", "fp"))
        held.append(part)
        rows += len(part[0])
        if rows < BUFFER:
            continue
        kind, key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        last = np.flatnonzero((kind != kind[-1]) | (key != key[-1]))
        end = last[-1] + 1 if len(last) else 0  # the last group may go on
        if end:
            yield flush(kind[:end], key[:end], fp[:end])
        held, rows = [(kind[end:], key[end:], fp[end:])], len(kind) - end
    if held:
        yield flush(*(np.concatenate(x) for x in zip(*held, strict=True)))


def links(distinct: DataFrame, group: int = GROUP) -> DataFrame:
    """(fp, other): links whose components are those of all pairs at DISTANCE or less, from a table of distinct fp."""
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(MASKS)])
    keyed = distinct.select("fp", F.inline(kinds))
    hot = materialize(keyed.groupBy("kind", "key").count().filter(F.col("count") > group).select("kind", "key"), "hot")
    cold = keyed.join(hot, ["kind", "key"], "left_anti")
    fine = F.lit(None).cast("array<struct<kind:int,key:bigint>>")
    for i, masks in enumerate(FINER):
        own = F.array(*[F.struct(F.lit(6 + 6 * i + k).alias("kind"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for k, m in enumerate(masks)])
        fine = F.when(F.col("kind") == i, own).otherwise(fine)
    split = keyed.join(hot, ["kind", "key"], "left_semi").select("fp", F.inline(fine))
    dealt = cold.select("kind", "key", "fp").unionByName(split.select("kind", "key", "fp"))
    return mapped(dealt.repartition("kind", "key").sortWithinPartitions("kind", "key"), link, "fp long, other long").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of every node that links name; root is one node of its component. Alternating star steps."""
    edges = materialize(pairs.select(F.greatest("fp", "other").alias("u"), F.least("fp", "other").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = salted_join(both, low, ["u"], "n").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = salted_join(large, low, ["u"], "n")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        before, edges = edges, materialize(small, "edges")
        # Both are distinct, so they are equal if each edge of one is in the other.
        done = edges.join(before, ["u", "v"], "left_anti").isEmpty() and before.join(edges, ["u", "v"], "left_anti").isEmpty()
        drop(before)
        if done:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (its smallest doc_id)."""
    each = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    found = components(links(distinct.select("fp")))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp")
    least = rooted.groupBy("root").agg(F.min("first").alias("component"), F.count(F.lit(1)).alias("fps"))
    named = salted_join(rooted, least, ["root"], "fps").select("fp", "n", "component")
    alone = distinct.filter("n > 1").join(found.withColumnRenamed("node", "fp"), "fp", "left_anti").select("fp", "n", F.col("first").alias("component"))
    out = salted_join(each, named.unionByName(alone), ["fp"], "n")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component stays, that of the smallest doc_id, with all its columns: exactly the rows whose
    doc_id is the component's. Rows without a doc_id stay only where their whole component has none, then all of them."""

    def keyed(rows: DataFrame, key: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = [f"{fingerprint(t.as_py() or b'') % (1 << 64):016x}" for t in batch.column("text").cast(pa.binary())]
                yield pa.record_batch([*batch.columns, pa.array(own, pa.string())], [*batch.schema.names, key])

        return mapped(rows, run, rows.select("*").schema.add(key, "string"))

    judged = near_duplicates(docs).select("doc_id", F.col("fingerprint").alias("key"), (~F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("gone"))
    return without(docs, judged, "near", keyed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
