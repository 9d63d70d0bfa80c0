"""Personal data: exact base patterns, and a skip-chain conditional random field that adds what they miss.

Base patterns (leftmost, not overlapping, per kind): e-mail, IP (parts at most 255), card (12 to 19 digits that pass
Luhn) and phone (from a plus sign, 9 to 15 digits). They stay whatever the field says.

The field's tokens are the candidates of a document: base matches, and, in the text between these, runs of digits and
their separators (brackets, dots, hyphens, blanks, a plus) with LEAST_DIGITS digits or more, and runs of SECRET or more
letters, digits and signs that hold both letters and digits; number runs of over LONGEST digits fall into the phone forms,
card forms and plain numbers that stand side by side in them. Labels: other, email, ip, card, phone, secret. A token's
potentials come from its shape and the word beside it, which is looked for in CONTEXT characters; neighbours in the text
are linked; and so are distant tokens with the same digits, the same last 7, or the same letters and digits (skip links):
linked tokens share potentials through loopy message passing, so that a number that is evidently a phone in one place is
one everywhere in the document. Base matches are clamped. Equal keys form a chain in text order, not all pairs, so links
grow with the tokens.

Weights are trained on the driver on seeded documents, whose numbers follow each other in kinds as they do in lists of
contacts or orders and come back in other forms, by the pseudo-likelihood of each open token given its true neighbours in
the chain and along skip links. Card and phone forms and secrets can be added; spans labelled otherwise are dropped.
Secrets (keys, access tokens) are no personal data: they have columns of their own.

Cases: a null text counts as empty: no spans. Offsets are code points, ends exclusive. Null doc_ids and repeated rows
are returned a row each; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import mapped, table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS, "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE = re.compile(r"[+(]{0,2}[0-9](?:[\x20().-]{0,2}[0-9])++")
#: What a run of numbers that stand side by side falls into: phone forms, card forms, plain numbers.
PARTS = re.compile(r"(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])|[0-9]{4}(?:[\x20.-]?[0-9]{4}){3}(?![0-9])|[0-9]{7,}+")
LONGEST = 15
WORD_BEFORE = re.compile(r"([^\W\d_]+)[^\w]*$")
ROUNDS = 6
LEAST_DIGITS, SECRET, CONTEXT = 7, 16, 30
RUN = re.compile(r"[A-Za-z0-9_+/-]{16,}+")
HEX = frozenset("0123456789abcdefABCDEF")


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the e-mail pattern, found from the @ signs, so that long runs of letters cost nothing."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def small(part: str) -> bool:
    """Whether a number is at most 255, however long it is written."""
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, in order of start, then of KINDS."""
    out = [(s, 0, e) for s, e in emails(text)]
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return [(s, KINDS[k], e) for s, k, e in sorted(out)]


#: Words that name a kind, by kind (fixed values).
CUES = {
    "card": frozenset("card visa mastercard amex credit debit karte kreditkarte carte tarjeta".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax telefon handy anruf téléphone appeler teléfono llamar móvil".split()),
    "secret": frozenset("token key secret password passwd bearer credential auth api apikey clave schlüssel jeton".split()),
    "other": frozenset("order invoice ref number no id page isbn total figure year bestellung commande pedido".split()),
}


def shape(span: str, before: str) -> np.ndarray:
    """Features of a candidate: its digits, how they are grouped and set off, its letters, and the word before it."""
    d = digits_of(span)
    n = len(d)
    groups = [len(g) for g in re.findall("[0-9]+", span)]
    word = WORD_BEFORE.search(before)
    cue = word[1].lower() if word else ""
    letters = sum(c.isalpha() for c in span)
    mixed = letters > 0 and "@" not in span
    bare = HEX.issuperset(span)
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:], strict=False)) / max(1, len(span) - 1)
    return np.array(
        [
            1, "@" in span, span.startswith("+"), "(" in span, len(groups) == 1, n in (7, 8), n in (9, 10, 11), n == 10 and len(groups) == 3, 12 <= n <= 19,
            n == 16, n > 19, 12 <= n <= 19 and luhn(d), groups[:3] == [4, 4, 4], groups[-1:] == [4] and len(groups) > 1, "." in span, len(groups) == 4 and all(g < 4 for g in groups) and "." in span,
            "-" in span or " " in span, len(set(d)) < 3, cue in CUES["card"], cue in CUES["phone"], cue in CUES["other"],
            mixed, mixed and bare, mixed and len(span) >= 24, mixed and n >= 4 and letters >= 4, mixed and changes > 0.25, mixed and before.rstrip(" ")[-1:] in ("=", ":", '"', "'"), cue in CUES["secret"],
        ],
        float,
    )


def candidates(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, int, int]]:
    """(start, end, label or -1 if open): base matches, and between them loose numbers and runs of letters and digits, in
    order of start."""
    out = [(s, e, LABELS.index(k)) for s, k, e in base]
    taken = sorted((s, e) for s, e, _ in out)
    at = 0
    for start, after in [*taken, (len(text), len(text))]:
        runs = [m.span() for m in RUN.finditer(text, at, start) if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])]
        out += [(s, e, -1) for s, e in runs]
        runs.append((len(text), len(text)))
        k = 0
        for m in LOOSE.finditer(text, at, start):
            s, e = m.span()
            while runs[k][1] <= s:
                k += 1
            if runs[k][0] < e or (n := len(digits_of(m[0]))) < LEAST_DIGITS:  # digits of a run are no number
                continue
            parts = [(s + x.start(), s + x.end(), -1) for x in PARTS.finditer(m[0])] if n > LONGEST else []
            out += parts or [(s, e, -1)]
        at = max(at, after)
    return sorted(out)


def key_of(span: str) -> str:
    """What skip links compare: the digits of a number, all of what holds letters."""
    return span if any(c.isalpha() for c in span) else digits_of(span)


def skip_links(keys: list[str]) -> list[tuple[int, int]]:
    """Places of tokens with the same key, or of numbers with the same last 7 digits, each with the one before it."""
    last: dict[str, int] = {}
    out = set()
    for i, d in enumerate(keys):
        for key in ({d, d[-7:]} if d.isdigit() else {d}) if len(d) >= LEAST_DIGITS else ():
            if key in last:
                out.add((last[key], i))
            last[key] = i
    return sorted(out)


FILL = "the of and that was with from und der nicht auch que les dans pour el una por at it said there were".split()


def entity(rng: np.random.Generator) -> tuple[str, list[str]]:
    """A kind, and the forms one number or string of it may have; | stands between two that are side by side."""
    num = lambda *sizes: ["".join(map(str, rng.integers(0, 10, n))) for n in sizes]
    pick = lambda options: options[rng.integers(len(options))]
    kind = pick(["phone", "phone", "card", "secret", "other", "other", "other"])
    if kind == "phone":
        a, b, c = num(3, 3, 4)
        return kind, [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"({a}) {b} {c}", f"({a}){b}-{c}", f"1-{a}-{b}-{c}", f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", a + b + c, f"{a} {b}{c}"]
    if kind == "card":
        d = num(15)[0]
        d += str(next(c for c in range(10) if luhn(d + str(c))))
        return kind, [d, f"{d[:4]} {d[4:8]} {d[8:12]} {d[12:]}", ".".join((d[:4], d[4:8], d[8:12], d[12:])), f"{d}|{d}"]
    if kind == "secret":
        signs = pick(["0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"])
        return kind, ["".join(signs[i] for i in rng.integers(0, len(signs), pick([20, 32, 40, 48, 64])))]
    y = num(4, 2, 2)
    words_ = [pick(FILL) for _ in range(5)]
    plain = ["-".join(words_[:4]) + "-" + num(2)[0], "/".join(words_) + num(1)[0], "_".join(words_[:4]) + "2", "version-" + "-".join(num(1, 2, 4)) + "-release"]
    return kind, [pick([num(8)[0], num(16)[0], "-".join(y), num(12)[0], num(7)[0], num(22)[0], num(10)[0], " ".join(num(3, 7)), " ".join(num(1, 2, 1, 2, 3)), ".".join(num(2, 3, 1, 2)), *plain])]


def document(rng: np.random.Generator) -> tuple[str, dict[tuple[int, int], str]]:
    """A text with entities, each mentioned up to three times, and the kind of each mention's span. The next mention is of the
    same kind more often than not; a first mention of a kind that has cues stands behind one half of the time, a later one seldom."""
    pick = lambda options: options[rng.integers(len(options))]
    left = [[*entity(rng), int(rng.integers(1, 4)), True] for _ in range(rng.integers(1, 7))]
    text, spans, last = "", {}, None
    while left:
        same = [e for e in left if e[0] == last]
        one = pick(same if same and rng.random() < 0.6 else left)
        kind, forms, times, first = one
        one[2:] = times - 1, False
        if times == 1:
            left.remove(one)
        text += " ".join(pick(FILL) for _ in range(rng.integers(0, 7))) if last != kind or rng.random() < 0.5 else pick([",", " /", "\n", ""])
        if rng.random() < (0.5 if first else 0.1):
            text += " " + pick(sorted(CUES[kind])) + pick([" ", ": ", ' = "' if kind == "secret" else " "])
        elif text and text[-1] != "\n":
            text += " "
        for form in pick(forms).split("|"):
            spans[len(text), len(text) + len(form)] = kind
            text += form + " "
        text = text[:-1] + pick([" ", ". ", '" ' if kind == "secret" else ", "])
        last = kind
    return text, spans


def links_of(text: str, tokens: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain links and skip links of tokens."""
    return [(i, i + 1) for i in range(len(tokens) - 1)], skip_links([key_of(text[s:e]) for s, e, _ in tokens])


DOCUMENTS = 1_500


@cache
def weights() -> tuple[np.ndarray, float, float]:
    """(labels x features) of a token, the weight of equal labels along the chain and along skip links."""
    rng = np.random.default_rng(7)
    x, y, near, same = [], [], [], []
    for _ in range(DOCUMENTS):
        text, gold = document(rng)
        tokens = candidates(text, base_spans(text))
        truth = np.array([known if known >= 0 else LABELS.index(gold.get((s, e), "other")) for s, e, known in tokens])
        held = []
        for links in links_of(text, tokens):
            counts = np.zeros((len(tokens), len(LABELS)))
            for i, j in links:
                counts[i, truth[j]] += 1
                counts[j, truth[i]] += 1
            held.append(counts)
        for i, (s, e, known) in enumerate(tokens):
            if known < 0:
                x.append(shape(text[s:e], text[max(0, s - CONTEXT) : s]))
                y.append(truth[i])
                near.append(held[0][i])
                same.append(held[1][i])
    x, y, near, same = np.stack(x), np.array(y), np.stack(near), np.stack(same)
    # One row of weights for each label over features, and beside it the two links', scaled step by step (Adagrad).
    w, link = np.zeros((len(LABELS), x.shape[1])), np.zeros(2)
    square_w, square_link = np.full_like(w, 1e-8), np.full_like(link, 1e-8)
    truth = np.eye(len(LABELS))[y]
    for _ in range(400):
        score = x @ w.T + link[0] * near + link[1] * same
        p = np.exp(score - score.max(1, keepdims=True))
        g = truth - p / p.sum(1, keepdims=True)
        step_w = g.T @ x / len(x) - 0.0002 * w
        step_link = np.array([(g * near).sum(), (g * same).sum()]) / len(x) - 0.0002 * link
        square_w += step_w**2
        square_link += step_link**2
        w += 0.3 * step_w / np.sqrt(square_w)
        link += 0.3 * step_link / np.sqrt(square_link)
    return w, float(link[0]), float(link[1])


def label(text: str, tokens: list[tuple[int, int, int]], model: tuple[np.ndarray, float, float]) -> list[int]:
    """The label of each token: beliefs of the skip-chain field after loopy message passing."""
    w, chain, skip = model
    unary = np.stack([w @ shape(text[s:e], text[max(0, s - CONTEXT) : s]) for s, e, _ in tokens])
    for i, (_, _, known) in enumerate(tokens):
        if known >= 0:
            unary[i] = -50.0
            unary[i, known] = 0.0
    edges = [(i, j, weight) for links, weight in zip(links_of(text, tokens), (chain, skip), strict=True) for i, j in links]
    if edges:
        a, b, strength = np.array([x[0] for x in edges]), np.array([x[1] for x in edges]), np.exp(np.array([x[2] for x in edges]))[:, None]
        out, into, strength = np.append(a, b), np.append(b, a), np.vstack([strength, strength])
        back = np.append(np.arange(len(edges)) + len(edges), np.arange(len(edges)))
        message = np.zeros((len(out), len(LABELS)))
        for _ in range(ROUNDS):
            belief = unary.copy()
            np.add.at(belief, into, message)
            cavity = belief[out] - message[back]
            p = np.exp(cavity - cavity.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            # sum over the sender's labels of p * potential, 1 unless labels are equal
            message = np.log(1 + p * (strength - 1))
            message -= message.max(1, keepdims=True)
        np.add.at(unary, into, message)
    return unary.argmax(1).tolist()


Spans = list[tuple[int, str, int]]


def found(text: str | None, model: tuple[np.ndarray, float, float] | None = None) -> tuple[Spans, Spans, Spans]:
    """Base spans, spans of personal data that the field adds, and secrets: (start, kind, end), each in order of start."""
    text = text or ""
    base = base_spans(text)
    tokens = candidates(text, base)
    if all(known >= 0 for _, _, known in tokens):
        return base, [], []
    labels = [LABELS[k] for k in label(text, tokens, model or weights())]
    new = [(s, k, e) for (s, e, known), k in zip(tokens, labels, strict=True) if known < 0]
    return base, [x for x in new if x[1] in ("card", "phone")], [x for x in new if x[1] == "secret"]


def find(text: str | None, model: tuple[np.ndarray, float, float] | None = None) -> tuple[Spans, Spans]:
    """Base spans and all spans of personal data in a text: (start, kind, end)."""
    base, added, _ = found(text, model)
    return base, sorted(base + added, key=lambda x: (x[0], KINDS.index(x[1])))


def written(spans: Spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (kind:start:end, all of personal
    data), secrets (likewise) and n_spans, how many of both."""

    held = docs.sparkSession.sparkContext.broadcast(weights())  # trained once, on the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                base, added, secrets = found(text.as_py(), model)
                kinds = [k for _, k, _ in base]
                spans = sorted(base + added, key=lambda x: (x[0], KINDS.index(x[1])))
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(spans), written(secrets), len(spans) + len(secrets)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(c, pa.int64() if name.startswith("n_") else pa.string()) for c, name in zip(columns, names[1:], strict=True)]], names)

    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "secrets", "n_spans"]
    schema = docs.select("doc_id").schema
    for name in names[1:]:
        schema = schema.add(name, "long" if name.startswith("n_") else "string")
    return mapped(docs.select("doc_id", "text"), run, schema)


def redact(text: str | None) -> str | None:
    """The text with each span replaced by its kind in angle brackets."""
    if not text:
        return text
    out, done = [], 0
    for s, k, e in sorted(sum(found(text), [])):
        if s >= done:
            out += [text[done:s], f"<{k}>"]
        done = max(done, e)
    return "".join(out) + text[done:]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
