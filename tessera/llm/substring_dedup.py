"""Substring deduplication by content-defined chunks.

A gear hash (h = 2h + table[byte]) rolls over the bytes; at the end of each word its value over the last GEAR bytes
stands. A word end is a boundary if its value is the least of the REACH word ends on either side, so boundaries depend
on nothing but the bytes near them: an insertion shifts chunks but changes only those that it touches. Chunks are
REACH + 1 words or longer but for the last of a text, 2 * REACH + 1 in the mean. Where words repeat with a period of
REACH or less no value is the least alone; such a stretch, if it is longer than LONG words, is cut at word ends that share
the least value, STEP words or more apart, so its chunks too depend on its bytes alone. Chunks are deduplicated by digest;
of equal chunks that of the smallest doc_id stays (in a document, the first).

Chunks that occur again, in another document or in their own, and follow each other form a repeated span; spans of
fewer than LEAST words are left alone. spans() counts repeats inside one document only if asked to (`within`); the query
and deduplicate() do. Of passages of 51 words that occur twice, 99.5 % contain LEAST words of whole chunks (of 55, all that were tried). Digests have 64
bits: a span takes several equal ones in a row, so one accidental collision repeats nothing.

Chunks are counted by digest with partial sums, so a passage in a third of all documents is a row a task; the places
of such chunks are marked where they are, without a shuffle; a document's chunks meet only their own.

Cases: a null text counts as empty and has no chunk. Null doc_ids come after all others in who keeps a chunk; rows that
share a doc_id, with equal or different texts, are documents like others, each cut by its own spans, but of the chunks
that their doc_id keeps each keeps its first. Words are runs of bytes above 0x20. deduplicate() returns each row with its
columns; a column n_cut that was there is replaced. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import mapped, materialize, salted_join, table

GEAR = 16
REACH = 3
LEAST = 26
#: Chunks of more than LONG words repeat themselves; they are cut at shared least values STEP words apart or more, a
#: multiple of all periods up to REACH.
LONG, STEP = 32, 6
#: Documents without a doc_id come last in who keeps a chunk.
LAST = (1 << 63) - 1
TABLE = np.random.default_rng(99).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash of the last GEAR bytes (a power of two) at each byte."""
    h = TABLE[data]
    span = 1
    while span < GEAR:
        h[span:] = h[span:] + (h[:-span] << np.uint32(span))
        span *= 2
    return h


def chunks(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (bytes) and words of the chunks of a text: they begin and end with words and cover all of them."""
    data = np.frombuffer(text, np.uint8)
    word = data > 32
    ends = np.flatnonzero(word & np.append(~word[1:], True)) if len(data) else np.zeros(0, np.int64)
    if not len(ends):
        return (np.zeros(0, np.int64),) * 3
    starts = np.flatnonzero(word & np.append(True, ~word[:-1]))
    h = gear(data)[ends].astype(np.int64)
    least = np.ones(len(h), bool)
    for k in range(1, REACH + 1):
        least[k:] &= h[k:] < h[:-k]
        least[:-k] &= h[:-k] <= h[k:]
    # Text ends are not content: near them a boundary would depend on what is missing there.
    least[:REACH] = least[max(0, len(h) - REACH) :] = False
    last = np.append(np.flatnonzero(least), len(h) - 1)
    first = np.append(0, last[:-1] + 1)
    keep = first <= last
    first, last = first[keep], last[keep]
    if (last - first >= LONG).any():  # text without a least value, such as one word again and again
        shared = np.ones(len(h), bool)
        for k in range(1, REACH + 1):
            shared[k:] &= h[k:] <= h[:-k]
            shared[:-k] &= h[:-k] <= h[k:]
        ends_: list[int] = []
        for f, z in zip(first.tolist(), last.tolist(), strict=True):
            if z - f >= LONG:
                at = f
                for i in (f + np.flatnonzero(shared[f:z])).tolist():
                    if i - at >= STEP:
                        ends_.append(i)
                        at = i
            ends_.append(z)
        last = np.array(ends_)
        first = np.append(first[0], last[:-1] + 1)
    return starts[first], ends[last] + 1, last - first + 1


def chunked(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Per row of docs: columns, and parts: array of (digest, start, after, words) in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                found, sizes = [], [0]
                digests: list[int] = []
                for t in part.column("text").cast(pa.binary()):
                    text = t.as_py() or b""
                    c = chunks(text)
                    digests += [digest(text[s:e]) for s, e in zip(c[0].tolist(), c[1].tolist(), strict=True)]
                    found.append(c)
                    sizes.append(sizes[-1] + len(c[0]))
                flat = [np.concatenate(x).astype(np.int32) for x in zip(*found, strict=True)]
                values = pa.StructArray.from_arrays([pa.array(np.array(digests, np.uint64).view(np.int64)), *map(pa.array, flat)], ["digest", "start", "after", "words"])
                yield pa.record_batch([*[part.column(c) for c in columns], pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)], [*columns, "parts"])

    schema = docs.select(*columns).withColumn("parts", F.array().cast("array<struct<digest:bigint,start:int,after:int,words:int>>")).schema
    return mapped(docs.select(*columns, "text"), run, schema)


def marked(docs: DataFrame, within: bool = False, rid: str | None = None) -> DataFrame:
    """Per row with a chunk that another row has too, or with `within` the row itself again: rid (the column of this name,
    else a number of its own), doc_id, and parts: array of (place, digest, start, after, words, keeper) of those."""
    found = chunked(docs, ["doc_id", rid]).withColumnRenamed(rid, "rid") if rid else chunked(docs, ["doc_id"]).withColumn("rid", F.monotonically_increasing_id())
    each = materialize(found, "chunks")
    parts = each.select("rid", "doc_id", F.posexplode("parts").alias("place", "part")).select("rid", "doc_id", "place", "part.*")
    seen = parts.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("one"), F.max("rid").alias("other"), F.min(F.coalesce("doc_id", F.lit(LAST))).alias("keeper"))
    seen = materialize(seen.filter("n > 1" if within else "one <> other").select("digest", "n", "keeper"), "seen")
    again = salted_join(parts, seen, ["digest"], "n", ["rid", "place"]).filter("keeper IS NOT NULL").drop("n")
    own = F.array_sort(F.collect_list(F.struct("place", "digest", "start", "after", "words", "keeper")))
    return again.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), own.alias("parts"))


def spans(docs: DataFrame, least: int = LEAST, within: bool = False, rid: str | None = None) -> DataFrame:
    """One row a span repeated in other documents, with `within` in its own too: rid, doc_id, start and
    after (bytes of the text in UTF-8), n_words, keep_doc_id (the smallest that keeps a part of it), n_removed (words that go) and cuts (the byte ranges that go)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            column = batch.column("parts")
            at = column.offsets.to_numpy()
            at = (at - at[0]).tolist()
            place, digest, start, after, words, keeper = (c.to_numpy().tolist() for c in column.flatten().flatten())
            for row, (rid, doc_id) in enumerate(zip(batch.column("rid").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)):
                met: set[int] = set()
                own = LAST if doc_id is None else doc_id
                k, end = at[row], at[row + 1]
                while k < end:
                    j = k + 1
                    while j < end and place[j] == place[j - 1] + 1:
                        j += 1
                    span = range(k, j)
                    k = j
                    many = sum(words[span.start : j])
                    if many < least:
                        continue
                    cuts, removed = [], 0
                    for i in span:
                        if keeper[i] == own and digest[i] not in met:
                            met.add(digest[i])
                            continue
                        removed += words[i]
                        cuts.append((start[i], after[i]))
                    keep = min(keeper[span.start : j])
                    out.append((rid, doc_id, start[span.start], after[j - 1], many, None if keep == LAST else keep, removed, cuts))
            sizes = np.cumsum([0, *(len(r[-1]) for r in out)], dtype=np.int32)
            flat = np.array([c for r in out for c in r[-1]], np.int32).reshape(-1, 2)
            cuts = pa.ListArray.from_arrays(pa.array(sizes), pa.StructArray.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], ["start", "after"]))
            yield pa.record_batch([*[pa.array([r[i] for r in out], t) for i, t in enumerate(types)], cuts], names)

    names = ["rid", "doc_id", "start", "after", "n_words", "keep_doc_id", "n_removed", "cuts"]
    types = [pa.int64()] * 2 + [pa.int32()] * 3 + [pa.int64(), pa.int32()]
    return mapped(marked(docs, within, rid), run, "rid long, doc_id long, start int, after int, n_words int, keep_doc_id long, n_removed int, cuts array<struct<start:int,after:int>>")


def deduplicate(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with the repeated chunks cut out of their texts, row by row, and n_cut: how many."""
    names = [c for c in docs.columns if c != "n_cut"]
    rows = materialize(docs.select(*names, F.monotonically_increasing_id().alias("_tessera_rid")), "texts")
    cuts = spans(rows, least, within=True, rid="_tessera_rid").groupBy(F.col("rid").alias("_tessera_rid")).agg(F.array_sort(F.flatten(F.collect_list("cuts"))).alias("_tessera_cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n = [], []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("_tessera_cuts").to_pylist(), strict=True):
                if own:
                    data, at, kept = text.encode(), 0, []
                    for c in own:
                        kept.append(data[at : c["start"]])
                        at = c["after"]
                    text = b"".join([*kept, data[at:]]).decode()
                texts.append(text)
                n.append(len(own or []))
            columns = {c: batch.column(c) for c in names} | {"text": pa.array(texts, pa.string()), "n_cut": pa.array(n, pa.int32())}
            yield pa.record_batch(list(columns.values()), list(columns))

    return mapped(rows.join(cuts, "_tessera_rid", "left").select(*names, "_tessera_cuts"), run, docs.select(*names).schema.add("n_cut", "integer"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"), within=True).select("doc_id", "start", "after", "n_words", "keep_doc_id", "n_removed")
