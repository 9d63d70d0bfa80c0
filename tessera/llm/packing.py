"""Packing of tokenised documents into sequences: best fit, then swap-based local search.

A document is its byte-level BPE ids and an end id; only one longer than a sequence is cut, into full pieces behind a
first piece that may be shorter. Full pieces are sequences already. The others are dealt by hash into blocks of about
BLOCK pieces (30 bytes each, so a task holds a few MB whatever the data), and each block is packed by itself:

1. best fit: a bin takes the longest piece that is left, then again and again the one that fits its room best, the
   longest that does not exceed it;
2. local search between underfull bins, least full first: move pieces, exchange one for one, or two for one, whenever the
   sum of squared fills grows, those first that fill the other bin wholly; a bin whose last piece leaves is gone. It ends
   when no exchange of any bin improves anything, or when the bins are as few as their sum allows.

A block costs less than one sequence over packing all at once, 1 in some 10,000 at BLOCK.

Cases: a null text counts as empty and is the end id alone. Null and repeated doc_ids are packed like others, a row
each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import re
import sys
from array import array
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import mapped, materialize, table

LENGTH = 1024
END = 2
BLOCK = 32_768
WORDS_HELD = 80_000

#: The pre-tokenizer's pattern for texts of Latin letters, in the standard library's syntax; LATIN_NOT tells the other texts.
LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
LATIN_NOT = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbeɐ-\U0010ffff]")


@cache
def encoding(name: str = "byte_bpe_50k.tiktoken"):
    """The vocabulary as ranks: the same ids as byte_bpe_50k.json, several times as fast."""
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Words(dict):
    """The ids of a word as little-endian bytes, filled as words come. When WORDS_HELD are held they become the old
    ones, from which those that come again return; the old ones before are dropped."""

    def __init__(self) -> None:
        super().__init__()
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        out = self.old.pop(word, None)
        if out is None:
            # A word is one piece of the pre-tokenizer, so its pattern need not run again.
            out = array("I", encoding()._encode_single_piece(word)).tobytes()
        if len(self) >= WORDS_HELD:
            self.old = dict(self)
            self.clear()
        self[word] = out
        return out


@cache
def words() -> Words:
    assert sys.byteorder == "little" and array("I").itemsize == 4
    return Words()


def ids_of(text: str) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit numbers; special tokens' strings are ordinary text."""
    if LATIN_NOT.search(text):
        return np.asarray(encoding().encode_ordinary(text), "<u4").tobytes()
    return b"".join(map(words().__getitem__, LATIN.findall(text)))


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    first = n % length or min(n, length)
    return [(0, first)] + [(at, length) for at in range(first, n, length)]


def pieces(docs: DataFrame, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, and ids if asked for."""
    tail = np.asarray([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                rows: list[tuple] = []
                for k, text in enumerate(part.column("text").to_pylist()):
                    ids = ids_of(text or "") + tail
                    for p, (start, n) in enumerate(cut(len(ids) // 4, length)):
                        own = ids[4 * start : 4 * (start + n)]
                        rows.append((k, p, start, n, crc32(own), np.frombuffer(own, "<i4") if with_ids else None))
                at, piece, start, n, crc, own = zip(*rows, strict=True) if rows else ([],) * 6
                columns = [part.column("doc_id").take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array(own, pa.list_(pa.int32())))
                yield pa.record_batch(columns, names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = docs.select("doc_id").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    return mapped(docs.select("doc_id", "text"), run, schema)


def best_fit(lengths: list[int], capacity: int = LENGTH) -> list[list[int]]:
    """Bins of indices into lengths: each takes the longest piece left, then those that fit its room best."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = 0  # bit n: a piece of length n is left
    for i in range(len(lengths) - 1, -1, -1):
        stacks[lengths[i]].append(i)
        there |= 1 << lengths[i]
    bins: list[list[int]] = []
    while there:
        own, room = [], capacity
        while fits := there & ((2 << room) - 1):
            n = fits.bit_length() - 1
            own.append(stacks[n].pop())
            room -= n
            if not stacks[n]:
                there &= ~(1 << n)
        bins.append(own)
    return bins


class Underfull:
    """Bins with room, found by their room and the lengths they hold; length 0 stands for no piece and is in each."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros((capacity + 1) ** 2, np.int32)  # bins by room * (capacity + 1) + length
        self.where: dict[int, dict[int, None]] = {}
        self.known = np.zeros(0, np.int64)

    def add(self, b: int, room: int, held: set[int], one: int = 1) -> None:
        for n in {0, *held}:
            key = room * (self.capacity + 1) + n
            self.count[key] += one
            if one < 0:
                del self.where[key][b]
            else:
                self.where.setdefault(key, {})[b] = None

    def remove(self, b: int, room: int, held: set[int]) -> None:
        self.add(b, room, held, -1)

    def best(self, parts: list[int], level: int) -> tuple[int, int, int] | None:
        """The exchange of a part (a sum of lengths) from a bin of this level for a piece of another bin, or for none, that
        raises the sum of squared fills most: among those that fill the other bin if there are such. Part, bin, piece."""
        wide = self.capacity + 1
        room, found = 0, None
        for p in parts:
            # Rooms 1 to p, each with the length p - room that must come back.
            exact = np.flatnonzero(self.count[wide + p - 1 : p * wide + 1 : self.capacity])
            if len(exact) and exact[-1] + 1 > room:
                room = int(exact[-1]) + 1
                found = p, room * wide + p - room, p - room
        if found is None:
            if len(self.known) < len(self.where):
                self.known = np.fromiter(self.where, np.int64, len(self.where))
            keys = self.known[self.count[self.known] > 0]
            rooms, backs = keys // wide, keys % wide
            most = 0
            for p in parts:
                grow = p - backs
                gain = np.where((grow > 0) & (grow <= rooms), grow * (self.capacity - rooms + grow - level), 0)
                k = int(gain.argmax()) if len(gain) else 0
                if len(gain) and gain[k] > most:
                    most, found = int(gain[k]), (p, int(keys[k]), int(backs[k]))
        return found and (found[0], next(iter(self.where[found[1]])), found[2])


def improve(bins: list[list[int]], lengths: list[int], capacity: int = LENGTH) -> list[list[int]]:
    """Local search between underfull bins until no exchange improves anything; bins without pieces are left out."""
    level = [sum(lengths[i] for i in b) for b in bins]
    sizes = lambda b: {lengths[i] for i in bins[b]}
    under = {b for b in range(len(bins)) if level[b] < capacity}
    held = Underfull(capacity)
    for b in under:
        held.add(b, capacity - level[b], sizes(b))
    fewest, left = -(-sum(level) // capacity), len(bins)
    steps, tried = 0, {}  # steps so far, and those when a bin was last found to have no exchange
    while left > fewest:
        before = steps
        queue = [(level[b], b) for b in under]
        heapq.heapify(queue)
        while queue and left > fewest:
            fill, a = heapq.heappop(queue)
            if a not in under or level[a] != fill or tried.get(a) == steps:
                continue
            held.remove(a, capacity - level[a], sizes(a))
            while bins[a]:
                own = bins[a]
                parts = {lengths[i] + lengths[j]: (i, j) for k, i in enumerate(own) for j in own[k + 1 :]}
                parts = {n: x for n, x in parts.items() if n <= capacity} | {lengths[i]: (i,) for i in own}
                found = held.best(list(parts), level[a])
                if found is None:
                    break
                steps += 1
                n, b, back = found
                held.remove(b, capacity - level[b], sizes(b))
                if back:
                    j = next(i for i in bins[b] if lengths[i] == back)
                    bins[b].remove(j)
                    bins[a].append(j)
                for i in parts[n]:
                    bins[a].remove(i)
                    bins[b].append(i)
                level[a] -= n - back
                level[b] += n - back
                if level[b] < capacity:
                    held.add(b, capacity - level[b], sizes(b))
                else:
                    under.discard(b)
            if bins[a]:
                held.add(a, capacity - level[a], sizes(a))
                tried[a] = steps
            else:
                under.discard(a)
                left -= 1
        if steps == before:
            break
    return [b for b in bins if b]


def pack_block(block: pa.Table) -> pa.Table:
    lengths = block.column("length").to_pylist()
    bins = improve(best_fit(lengths), lengths)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, own in enumerate(bins):
        at = 0
        for i in own:
            sequence[i], offset[i] = b, at
            at += lengths[i]
    sequence += block.column("block").to_numpy().astype(np.int64) << 32
    return block.drop_columns(["block"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))


def pack(docs: DataFrame, block: int = BLOCK, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for."""
    cut_up = materialize(pieces(docs, with_ids=with_ids), "pieces").withColumn("place", F.monotonically_increasing_id())
    full = cut_up.filter(F.col("length") == LENGTH)
    short = cut_up.filter(F.col("length") < LENGTH)
    blocks = max(1, -(-short.count() // block))
    columns = [c for c in cut_up.columns if c != "place"]
    dealt = short.withColumn("block", F.pmod(F.xxhash64("place"), F.lit(blocks))).select(*columns, "block")
    schema = cut_up.select(*columns).schema.add("sequence_id", "long").add("offset", "long")
    packed = dealt.groupBy("block").applyInArrow(pack_block, schema)
    alone = full.select(*columns, (-1 - F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
