"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1; an n-gram of three letters binds them after permuting by place,
v(abc) = p(p(a)) * p(b) * c, where p rotates; a text bundles (adds) its n-gram vectors and is compared by cosine with
a prototype per language, the bundle of its training texts. Bundling is linear, so the product of a text with a
prototype is the sum of the products of its n-grams, which are tabulated once for all 2 ** 18 n-grams; the norm of
the text's vector is taken by the quasi-orthogonality of random vectors, DIM * sum of squared n-gram counts.

Letters are the characters with str.isalpha(), case-folded to one of 63 symbols (a-z apart, others by code point);
anything else is a word end, symbol 0.

Training: rows whose lang is not null, crc32(doc_id as text) mod 5 is not 0; about SAMPLE of them at most, chosen by
the hash of their id and text. Only counts of n-grams by language reach the driver: languages * 2 ** 18 numbers at most.

keep_identified() rejects texts without a letter and texts without evidence: the cosine of unrelated vectors is 1 / sqrt(DIM)
in the mean square, and a text of LEAST_GRAMS n-grams or more whose best cosine is below SIGMAS times that shares no more
with any language than chance does (encoded data, keys struck at random, scripts that nothing was learned from).

Cases: a null text, or one without a letter, is `und` with score 0. If no row can be learned from, all are `und`.
A text that shares no n-gram with training goes to the language that sorts first, with a low score. Repeated rows get
the same answer each, empty tables give empty results, other columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import crc_fold, mapped, table

DIM = 2048
SYMBOLS = 64
CODES = SYMBOLS**3
SAMPLE = 40_000
SEED = 20240
#: Sharpness of the score: a softmax over cosines.
SHARP = 20.0
CHUNK = 250_000
#: Evidence that a text is in any of the languages; shorter texts are not rejected for lack of it.
SIGMAS, LEAST_GRAMS = 3.0, 30


@cache
def alphabet() -> np.ndarray:
    """Symbol of each code point: 0 for non-letters, 1-26 for a-z, 27-63 for the other letters by their lower case."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[i] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % 37
    return out


def codes_of(text: str) -> np.ndarray:
    """The codes of the text's n-grams, word ends included once each; empty without letters."""
    s = alphabet()[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    s = s[np.append(True, (s[1:] | s[:-1]) != 0)].astype(np.int32)
    return (s[:-2] << 12) | (s[1:-1] << 6) | s[2:]


def letter_vectors(dim: int = DIM) -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), (SYMBOLS, dim))


def code_products(prototypes: np.ndarray) -> np.ndarray:
    """(CODES, languages): the product of each n-gram's vector with each prototype."""
    c = letter_vectors(prototypes.shape[1])
    b, a = np.roll(c, 1, 1), np.roll(c, 2, 1)
    out = np.empty((SYMBOLS, SYMBOLS, SYMBOLS, len(prototypes)), np.float32)
    for i in range(SYMBOLS):
        for k, p in enumerate(prototypes):
            out[i, :, :, k] = (b * (a[i] * p)) @ c.T
    return out.reshape(CODES, -1)


def bundle(counts: np.ndarray, dim: int = DIM) -> np.ndarray:
    """The vector that bundles n-grams with these counts."""
    c = letter_vectors(dim)
    b, a = np.roll(c, 1, 1), np.roll(c, 2, 1)
    n = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float32)
    out = np.zeros(dim, np.float32)
    for i in range(SYMBOLS):
        out += a[i] * ((n[i] @ c) * b).sum(0)
    return out


def count_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts by language of a partition."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            codes = codes_of(text or "")
            if lang not in held:
                held[lang] = np.zeros(CODES, np.int64)
            held[lang] += np.bincount(codes, minlength=CODES) if len(codes) > 20_000 else 0
            if len(codes) <= 20_000:
                np.add.at(held[lang], codes, 1)
    for lang, counts in held.items():
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["lang", "code", "n"])


def learn(docs: DataFrame, sample: int = SAMPLE, dim: int = DIM) -> tuple[list[str], np.ndarray] | None:
    """Languages and products of each n-gram with their prototypes (normed, cosines but for the text's norm)."""
    rows = docs.filter(F.col("lang").isNotNull() & (crc_fold(F.col("doc_id"), 5) != 0))
    share = min(1.0, sample / max(1, rows.count()))
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    counts = mapped(chosen.select("lang", "text"), count_codes, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    found = counts.toArrow()
    if not found.num_rows:
        return None
    langs, code, n = np.array(found["lang"].to_pylist()), found["code"].to_numpy(), found["n"].to_numpy()
    names = sorted(set(langs))
    prototypes = np.empty((len(names), dim), np.float32)
    for k, name in enumerate(names):
        full = np.zeros(CODES)
        full[code[langs == name]] = n[langs == name]
        v = bundle(full / np.linalg.norm(full), dim)
        prototypes[k] = v / np.linalg.norm(v)
    return names, code_products(prototypes)


def scorer(names: list[str], products: np.ndarray, dim: int = DIM):
    """A function over texts: language and score of each, and whether there is evidence of it."""

    def score(texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        langs, scores, sure = [], [], []
        for text in texts:
            codes = codes_of(text or "")
            if not len(codes):
                langs.append("und")
                scores.append(0.0)
                sure.append(False)
                continue
            dots = np.zeros(products.shape[1])
            for i in range(0, len(codes), CHUNK):
                dots += products[codes[i : i + CHUNK]].sum(0, dtype=np.float64)
            codes.sort()
            runs = np.diff(np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1], [True]))))
            cosines = dots / np.sqrt(dim * float((runs.astype(np.float64) ** 2).sum()))
            best = int(cosines.argmax())
            langs.append(names[best])
            scores.append(float(1 / np.exp(SHARP * (cosines - cosines[best])).sum()))
            sure.append(len(codes) < LEAST_GRAMS or bool(cosines[best] >= SIGMAS / np.sqrt(dim)))
        return langs, scores, sure

    return score


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray] | None, columns: list[str], names: tuple[str, str, str] = ("lang_pred", "score", "identified")) -> DataFrame:
    """`columns` of docs with the language, its score and whether there is evidence of it, under these names. Without a
    model all is `und`, and each text with a letter counts as identified."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(*held.value) if held.value else lambda texts: (["und"] * len(texts), [0.0] * len(texts), [bool(len(codes_of(t or ""))) for t in texts])
        for batch in batches:
            langs, scores, sure = score(batch.column(len(columns)).to_pylist())
            yield pa.record_batch([*batch.columns[: len(columns)], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sure, pa.bool_())], [*columns, *names])

    schema = docs.select(*columns).schema.add(names[0], "string").add(names[1], "double").add(names[2], "boolean")
    return mapped(docs.select(*columns, F.col("text").alias("_tessera_text")), run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    out = predict(docs, learn(docs), ["doc_id"])
    return out.select("doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows whose text is in a language: without a letter (null texts too), or without evidence of any of the languages
    learned, they go. If no row can be learned from, all with a letter stay."""
    return predict(docs, learn(docs), docs.columns, ("_tessera_lang", "_tessera_score", "_tessera_sure")).filter("_tessera_sure").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
