"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of insulting words (a fixed list, and words or stems, that is first letters of words,
learned as frequent in toxic and rare in other training texts, in whatever language), also after undoing digits and signs put for letters; how many stand near a word that addresses
the reader; capitals, capital words, punctuation, exclamation and question marks, digits, repeated letters and the
rate of obfuscated words; length.

Training: labelled rows with crc32(doc_id as text) mod 3 not 1, at most SAMPLE of them by the hash of their id. Only
their features (FEATURES numbers a row, thrice) and LEARNED words and stems at most reach the driver. The trees are grown
there by histograms; the isotonic map is fitted on scores of rows whose labels had no part in them: each of two folds is
scored by trees grown on the other one, over words and stems learned from the other one.

Cases: null labels are left out; of repeated labels of an id the largest counts. Null texts count as empty and are
scored like others. Without rows of both labels to learn from, all scores are the share of label 1 (0 without rows).
Repeated documents get the same score each; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import crc_fold, drop, mapped, materialize, table

SAMPLE = 30_000
LEARNED = 300
#: Bytes of the stems that are tried, besides the whole word (0).
STEMS = (4, 5, 6, 0)
#: Units that a task counts before it hands them on.
UNITS_HELD = 200_000
#: A learned word or stem occurs in so many toxic training texts and such a share of them, and its odds there are so many times
#: those elsewhere.
LEAST_TEXTS, LEAST_SHARE, LEAST_ODDS = 5, 0.01, 8.0
TREES, DEPTH, RATE, BINS, LEAST_LEAF, RIDGE = 80, 3, 0.15, 64, 10, 1.0
THRESHOLD = 0.7
NEAR = 5

INSULTS = frozenset(
    b"idiot idiots moron morons stupid dumb dumbass scum trash garbage pathetic worthless loser losers clown clowns fool fools freak freaks creep "
    b"jerk liar liars disgusting filthy filth vermin pig pigs ugly hate hated crap damn bastard bastards bitch shit fuck fucking asshole "
    b"retard retarded imbecile cretin dimwit nitwit coward cowards parasite parasites braindead useless degenerate".split()
)
SECOND = frozenset(b"you your yours yourself u ur youre thou du dein deine dich dir ihr euch tu te toi ton ta vous votre usted ustedes tus ti vosotros".split())
#: A-Z lower-cased, other ASCII than letters and digits to spaces.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Signs put for letters.
LEET = bytes.maketrans(b"0134578@$!", b"oieastbasi")
OBFUSCATED = re.compile(rb"(?<=[A-Za-z])[0-9@$!*#]+[A-Za-z]")
CAPITALS = re.compile(rb"[A-Z]{3,}")
STRETCHED = re.compile(rb"([A-Za-z])\1\1")
FEATURES = 17


def units(word: bytes) -> list[bytes]:
    """The word and its stems, marked with their lengths so that a stem is not a word."""
    return [b"%d:%b" % (k, word[:k] if k else word) for k in STEMS if len(word) > k]


def by_length(learned: frozenset[bytes]) -> list[tuple[int | None, frozenset[bytes]]]:
    """Learned stems by length; None for whole words."""
    sets = [(k or None, frozenset(u.partition(b":")[2] for u in learned if u.startswith(b"%d:" % k))) for k in STEMS]
    return [x for x in sets if x[1]]


def features(text: bytes, stems: list[tuple[int | None, frozenset[bytes]]]) -> list[float]:
    """FEATURES numbers of a text in UTF-8; stems: what by_length gives."""
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = max(1, int(count[65:91].sum() + count[97:123].sum() + count[128:].sum()))
    words = text.translate(PLAIN).split()
    n = max(1, len(words))
    fixed = [i for i, w in enumerate(words) if w in INSULTS]
    own = sorted({i for k, known in stems for i, w in enumerate(words) if w[:k] in known})
    either = sorted({*fixed, *own})
    near = sum(any(w in SECOND for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in either)
    obfuscated = undone = 0
    for word in text.split() if OBFUSCATED.search(text) else ():
        if signs := len(OBFUSCATED.findall(word)):
            obfuscated += signs
            plain = word.translate(LEET).translate(PLAIN).strip()
            undone += plain in INSULTS or any(plain[:k] in known for k, known in stems)
    return [
        np.log1p(n),
        len(fixed), len(fixed) / n, len(own), len(own) / n, len(either), len(either) / n, len({words[i] for i in either}),
        near / n, near,
        count[65:91].sum() / letters,
        len(CAPITALS.findall(text)) / n,
        count[33] / n, (count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()) / letters,
        len(STRETCHED.findall(text)) / n,
        obfuscated / n, undone / n,
    ]


def featured(rows: DataFrame, columns: list[str], learned: list[frozenset[bytes]]) -> DataFrame:
    """`columns` of rows, and x: the features of text, for each set of learned words in turn."""

    sets = [by_length(x) for x in learned]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [[v for stems in sets for v in features(t.as_py() or b"", stems)] for t in batch.column("_text").cast(pa.binary())]
            yield pa.record_batch([*[batch.column(c) for c in columns], pa.array(x, pa.list_(pa.float64()))], [*columns, "x"])

    return mapped(rows.select(*columns, F.col("text").alias("_text")), run, rows.select(*columns).withColumn("x", F.array().cast("array<double>")).schema)


class Trees:
    """Gradient-boosted trees for the logistic loss; features are binned by quantiles."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
        b = self.binned(x)
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        f = np.full(len(y), self.base)
        self.trees: list[tuple[list[tuple[int, int]], np.ndarray]] = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            splits, leaf = self.grow(b, y - p, p * (1 - p))
            g, h = np.bincount(leaf, y - p, 2**DEPTH), np.bincount(leaf, p * (1 - p), 2**DEPTH)
            value = RATE * g / (h + RIDGE)
            self.trees.append((splits, value))
            f += value[leaf]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    @staticmethod
    def grow(b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
        """The splits of a full tree in level order (feature, bin; rows of a greater bin go right), and each row's leaf."""
        node = np.zeros(len(b), np.int64)
        splits: list[tuple[int, int]] = []
        for level in range(DEPTH):
            width = 2**level
            best = np.full(width, 1e-6)
            chosen = [(0, BINS)] * width  # none goes right
            for k in range(b.shape[1]):
                at = node * BINS + b[:, k]
                sums = [np.bincount(at, w, width * BINS).reshape(width, BINS).cumsum(1) for w in (g, h, np.ones(len(b)))]
                (gl, hl, nl), (gt, ht, nt) = sums, [s[:, -1:] for s in sums]
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(nl < LEAST_LEAF) | (nt - nl < LEAST_LEAF)] = 0
                top = gain.argmax(1)
                for i in range(width):
                    if gain[i, top[i]] > best[i]:
                        best[i], chosen[i] = gain[i, top[i]], (k, int(top[i]))
            feature, cut = np.array(chosen).T
            node = 2 * node + (b[np.arange(len(b)), feature[node]] > cut[node])
            splits += chosen
        return splits, node

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.binned(x), np.arange(len(x))
        f = np.full(len(x), self.base)
        for splits, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                feature, cut = np.array(splits[2**level - 1 : 2 ** (level + 1) - 1]).T
                node = 2 * node + (b[rows, feature[node]] > cut[node])
            f += value[node]
        return f


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing map from score to the share of label 1 (pool adjacent violators)."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, least and greatest score
    for s, label in zip(score[order], y[order], strict=True):
        if blocks and blocks[-1][3] == s:
            blocks[-1][0] += label
            blocks[-1][1] += 1
        else:
            blocks.append([label, 1, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1][:2] = blocks[-1][0] + last[0], blocks[-1][1] + last[1]
            blocks[-1][3] = last[3]
    share = [(b[0] + 0.01) / (b[1] + 0.02) for b in blocks]
    return np.array([s for b in blocks for s in b[2:]]), np.maximum.accumulate(np.repeat(share, 2))


class Model:
    """Learned words, trees and the isotonic map. x has the features over all learned words, others[k] those over words that
    were learned without fold k."""

    def __init__(self, learned: frozenset[bytes], x: np.ndarray, y: np.ndarray, fold: np.ndarray, others: list[np.ndarray]):
        self.learned, self.share = learned, float(y.mean()) if len(y) else 0.0
        self.trees = None
        if 0 < y.sum() < len(y):
            out = np.empty(len(y))
            for k, own in enumerate(others):
                here = fold == k
                both = 0 < y[~here].sum() < (~here).sum()
                out[here] = Trees(own[~here], y[~here]).raw(own[here]) if both and here.any() else np.log(self.share)
            self.knots = isotonic(out, y)
            self.trees = Trees(x, y)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.raw(x), *self.knots) if self.trees else np.full(len(x), self.share)


def count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, and toxic ones, that hold each word or stem, by fold."""
    names = ["t0", "n0", "t1", "n1"]

    def flush(held: dict[bytes, list[int]]) -> pa.RecordBatch:
        out = pa.record_batch([pa.array(held, pa.binary()), *[pa.array([v[i] for v in held.values()], pa.int64()) for i in range(4)]], ["unit", *names])
        held.clear()
        return out

    held: dict[bytes, list[int]] = {}
    for batch in batches:
        for text, toxic, fold in zip(batch.column("text").cast(pa.binary()), batch.column("toxic").to_pylist(), batch.column("fold").to_pylist(), strict=True):
            for u in {u for w in {*text.as_py().translate(PLAIN).split()} for u in units(w)}:
                v = held.setdefault(u, [0, 0, 0, 0])
                v[2 * fold] += toxic
                v[2 * fold + 1] += 1
            if len(held) > UNITS_HELD:
                yield flush(held)
    yield flush(held)


def learn_words(rows: DataFrame) -> list[frozenset[bytes]]:
    """Words and stems of rows (text, toxic, fold) that are frequent in toxic texts and rare in the others: of all rows,
    without those of fold 0, without those of fold 1."""
    totals = [{"t": 0, "n": 0}, {"t": 0, "n": 0}]
    for r in rows.groupBy("fold").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).collect():
        totals[r["fold"]] = r.asDict()
    sums = ", ".join(f"sum({c}) AS {c}" for c in ("t0", "n0", "t1", "n1")).split(", ")
    counts = mapped(rows.select("text", "toxic", "fold"), count_units, "unit binary, t0 long, n0 long, t1 long, n1 long").groupBy("unit").agg(*map(F.expr, sums))
    counts = materialize(counts.filter(F.col("t0") + F.col("t1") >= LEAST_TEXTS), "units")
    out = []
    for folds in ((0, 1), (1,), (0,)):
        toxic, texts = (sum(totals[k][c] for k in folds) for c in ("t", "n"))
        if not 0 < toxic < texts:
            out.append(frozenset())
            continue
        t, n = (sum((F.col(f"{c}{k}") for k in folds), F.lit(0)) for c in ("t", "n"))
        odds = ((t + 0.5) / (toxic + 1)) / ((n - t + 0.5) / (texts - toxic + 1))
        found = counts.filter((t >= max(LEAST_TEXTS, LEAST_SHARE * toxic)) & (odds >= LEAST_ODDS)).orderBy(t.desc(), "unit").limit(LEARNED)
        out.append(frozenset(bytes(r["unit"]) for r in found.select("unit").collect()))
    drop(counts)
    return out


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    fold = crc_fold(F.col("doc_id"), 3)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    rows = docs.join(F.broadcast(known), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("fold"))
    rows = materialize(rows.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("fold").alias("fold")), "labelled")  # a copy tells nothing new
    learned = learn_words(rows)
    held = featured(rows, ["toxic", "fold"], learned).toArrow()
    drop(rows)
    x = np.array(held["x"].to_pylist(), np.float64).reshape(-1, 3 * FEATURES)
    order = np.lexsort((*x.T, held["toxic"].to_numpy(), held["fold"].to_numpy()))  # the same model however the rows come
    all_, *others = (x[order, k * FEATURES : (k + 1) * FEATURES] for k in range(3))
    return Model(learned[0], all_, held["toxic"].to_numpy().astype(np.float64)[order], held["fold"].to_numpy()[order], others)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        stems = by_length(own.learned)
        for batch in batches:
            x = [features(t.as_py() or b"", stems) for t in batch.column("text").cast(pa.binary())]
            out = own.scores(np.array(x, np.float64).reshape(-1, FEATURES))
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    out = mapped(docs.select("doc_id", "text"), run, docs.select("doc_id").schema.add("score", "double"))
    return out.select("doc_id", (crc_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
