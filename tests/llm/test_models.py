import itertools
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lang_id, license_scan, pii, toxicity


# --- languages ---


def test_products_are_those_of_the_vectors():
    letters = lang_id.letter_vectors(64)
    codes = lang_id.codes_of("Hello, wörld! 99 abc")
    vector = sum(np.roll(letters[c >> 12], 2) * np.roll(letters[c >> 6 & 63], 1) * letters[c & 63] for c in codes.tolist())
    counts = np.bincount(codes, minlength=lang_id.CODES)
    assert np.allclose(lang_id.bundle(counts, 64), vector)
    prototypes = np.random.default_rng(0).normal(size=(3, 64)).astype(np.float32)
    assert np.allclose(lang_id.code_products(prototypes)[codes].sum(0), prototypes @ vector, atol=1e-2)


def test_held_out_languages(documents):
    got = lang_id.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 20 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)


def test_language_odd_rows(odd, none, documents):
    model = lang_id.learn(documents)
    got = lang_id.predict(odd, model, ["doc_id"]).collect()
    assert len(got) == odd.count()
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {3, 4, 8}
    assert all(0 <= r["score"] <= 1 for r in got) and all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert lang_id.identify(none).count() == 0
    assert {r["lang_pred"] for r in lang_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = lang_id.keep_identified(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3


def test_texts_stay_if_no_language_can_be_learned(odd):
    unknown = odd.withColumn("lang", F.lit(None).cast("string"))
    kept = lang_id.keep_identified(unknown)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 5, 5, 7]


def test_texts_without_evidence_of_a_language_go(spark, documents):
    texts = ["qzxwv kjhgf zzxq vbnmq wqxz jjkq xzqw pqvz kkxz wvqj", "aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQ=" * 3, "\u4e2d\u6587" * 30, "zq", None, "42"]
    own = [r["text"] for r in documents.limit(20).collect()]
    rows = documents.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(10_000 + i, t, None) for i, t in enumerate([*texts, *own])], "doc_id long, text string, lang string"))
    clash = rows.withColumns({c: F.lit("x") for c in ("_language", "_text", "_certainty", "identified", "lang_pred")})
    kept = lang_id.keep_identified(clash)
    assert kept.columns == clash.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {i for i in range(10_000, 10_000 + len(texts)) if i in ids} == {10_003}
    assert len(ids) == rows.count() - 5


def test_the_query_by_brute_force(spark, sf_dir, documents):
    """Vectors added up n-gram by n-gram and compared with prototypes made the same way."""
    rows = documents.collect()
    letters, codes = lang_id.letter_vectors(), np.arange(lang_id.CODES)
    vectors = lambda c: np.roll(letters, 2, 1)[c >> 12] * np.roll(letters, 1, 1)[c >> 6 & 63] * letters[c & 63]
    bundled = lambda n: sum(n[part] @ vectors(part) for part in np.array_split(codes[n > 0], 20) if len(part))
    count = lambda texts: np.bincount(np.concatenate([lang_id.codes_of(t or "") for t in texts]), minlength=lang_id.CODES).astype(np.float64)
    learned = {}
    for r in rows:
        if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            learned.setdefault(r["lang"], []).append(r["text"])
    prototypes = {k: (v := bundled(count(t))) / np.linalg.norm(v) for k, t in learned.items()}
    got = {r["doc_id"]: r for r in lang_id.query(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r in rows:
        own = got[r["doc_id"]]
        n = count([r["text"]])
        assert own["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if not n.any():
            assert (own["lang_pred"], own["score"]) == ("und", 0.0)
            continue
        v = bundled(n) / np.sqrt(lang_id.DIM * (n**2).sum())
        cosines = {k: float(v @ p) for k, p in prototypes.items()}
        best = max(cosines.values())
        assert cosines[own["lang_pred"]] > best - 1e-4
        assert abs(own["score"] - 1 / sum(np.exp(lang_id.SHARP * (c - best)) for c in cosines.values())) < 1e-2


# --- toxicity ---


def test_isotonic_is_monotone_and_calibrated():
    rng = np.random.default_rng(1)
    score = rng.normal(size=3000)
    y = (rng.random(3000) < 1 / (1 + np.exp(-2 * score))).astype(float)
    knots, share = toxicity.isotonic(score, y)
    assert (np.diff(share) >= 0).all() and (np.diff(knots) >= 0).all()
    fitted = np.interp(score, knots, share)
    assert abs(fitted.mean() - y.mean()) < 0.01


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    raw = toxicity.Trees(x[:3000], y[:3000]).raw(x[3000:])
    assert ((raw > 0) == y[3000:]).mean() > 0.9


def test_obfuscated_words_count():
    plain, leet = toxicity.features(b"you are an idiot", []), toxicity.features(b"you are an id1ot", [])
    assert plain[1] == 1 and plain[8] > 0 and plain[15] == 0
    assert leet[1] == 0 and leet[15] > 0 and leet[16] > 0


def test_held_out_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.score(docs, toxicity.learn(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    low, high = [np.array([r["score"] for r in got if r["toxic"] == t]) for t in (0, 1)]
    assert (high[:, None] > low).mean() + 0.5 * (high[:, None] == low).mean() > 0.85


def brute_features(text, learned):
    """Word by word, with regular expressions."""
    text = (text or "").encode()
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in text)
    words = re.findall(rb"[0-9a-z\x80-\xff]+", lower)
    n = max(1, len(words))
    letters = max(1, len(re.findall(rb"[A-Za-z\x80-\xff]", text)))
    known = lambda w: any((w if u.startswith(b"0:") else w[: int(u[:1])]) == u[2:] for u in learned)
    fixed = [i for i, w in enumerate(words) if w in toxicity.INSULTS]
    own = [i for i, w in enumerate(words) if known(w)]
    either = sorted({*fixed, *own})
    near = sum(any(abs(i - j) <= toxicity.NEAR and w in toxicity.SECOND for j, w in enumerate(words)) for i in either)
    obfuscated, undone = 0, 0
    for w in re.split(rb"[\x20\x09-\x0d]+", text):
        hits = re.findall(rb"(?<=[A-Za-z])[0-9@$!*#]+[A-Za-z]", w)
        obfuscated += len(hits)
        if hits:
            plain = re.sub(rb"[^0-9a-z\x80-\xff]", b" ", w.translate(toxicity.LEET).lower() if w.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in w.translate(toxicity.LEET))).strip()
            undone += plain in toxicity.INSULTS or known(plain)
    return [
        np.log1p(n), len(fixed), len(fixed) / n, len(own), len(own) / n, len(either), len(either) / n, len({words[i] for i in either}), near / n, near,
        len(re.findall(rb"[A-Z]", text)) / letters, len(re.findall(rb"[A-Z]{3,}", text)) / n, text.count(b"!") / n,
        len(re.findall(rb"[!-/:-@\[-`{-~]", text)) / letters, len(re.findall(rb"([A-Za-z])\1\1", text)) / n, obfuscated / n, undone / n,
    ]


def test_the_toxicity_query_by_brute_force(spark, documents):
    """Features, trees and the isotonic map, row by row, for whole documents."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)
    assert model.learned
    rows = documents.collect()
    got = {r["doc_id"]: r for r in toxicity.score(documents, model).collect()}
    for r in rows[:60]:
        x = brute_features(r["text"], model.learned)
        f = model.trees.base
        for splits, value in model.trees.trees:
            node = 0
            for level in range(toxicity.DEPTH):
                k, cut = splits[2**level - 1 + node]
                node = 2 * node + (sum(e < x[k] for e in model.trees.edges[k]) > cut)
            f += value[node]
        own = got[r["doc_id"]]
        want = float(np.interp(f, *model.knots))
        assert abs(own["score"] - want) < 1e-9 and own["predicted"] == (own["score"] >= 0.7) and own["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_scores_are_calibrated_between_the_ends():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12_000, 4))
    y = (rng.random(len(x)) < 1 / (1 + np.exp(-1.5 * x[:, 0] - x[:, 1]))).astype(float)
    fold = rng.integers(0, 2, len(x))
    model = toxicity.Model(frozenset(), x[:6000], y[:6000], fold[:6000], [x[:6000]] * 2)
    score = model.scores(x[6000:])
    for low in np.arange(0, 1, 0.2):
        here = (score >= low) & (score < low + 0.2)
        assert here.sum() > 300 and abs(y[6000:][here].mean() - score[here].mean()) < 0.05


def test_words_of_a_fold_are_learned_from_the_other(spark):
    rows = [(f"common blorgish{k} you", 1, k) for k in (0, 1) for _ in range(40)] + [("common nice", 0, k) for k in (0, 1) for _ in range(40)]
    every, without0, without1 = toxicity.learn_words(spark.createDataFrame(rows, "text string, toxic int, fold int"))
    assert {b"0:blorgish0", b"0:blorgish1"} <= every and b"0:common" not in every
    assert b"0:blorgish1" in without0 and b"0:blorgish0" not in without0 and b"0:blorgish0" in without1 and b"0:blorgish1" not in without1


def test_toxicity_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (7, 0), (None, 1), (99, 1)], "doc_id long, toxic int")
    got = toxicity.score(odd, toxicity.learn(odd, labels)).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert toxicity.score(none, toxicity.learn(none, labels)).count() == 0
    assert {r["score"] for r in toxicity.score(odd, toxicity.learn(odd, labels.limit(0))).collect()} == {0.0}


# --- personal data ---

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(x) > 255 for x in m[0].split("."))) or (kind == "card" and not (12 <= len(d) <= 19 and pii.luhn(d))) or (kind == "phone" and not 9 <= len(d) <= 15):
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[1])))


def test_base_spans_by_brute_force(texts):
    rng = random.Random(4)
    odd = ["".join(rng.choice("a@@..--+ ()1122334 05%_é") for _ in range(rng.randint(0, 60))) for _ in range(5000)]
    for text in [*texts.values(), *odd, "4111111111111111 " * 3, "a" * 50_000 + "@", "1" * 50_000]:
        assert pii.base_spans(text) == brute(text)


def test_the_field_adds_what_stands_side_by_side_or_repeats():
    text = "+1 (269) 555-3296 4111111111111111 and x"
    base, spans = pii.find(text)
    assert base == [] and spans == [(0, "phone", 17), (18, "card", 34)]
    text = "+49 170 1234567 then 170 1234567 and 2024-01-02"
    base, spans = pii.find(text)
    assert base == [(0, "phone", 15)] and spans == [(0, "phone", 15), (21, "phone", 32)]
    assert pii.find("the 170 1234567 of it")[1] == []  # alone it stays unmarked
    assert pii.redact("mail a@b.cd now") == "mail <email> now"


def quality(model, seed=99, times=600):
    """Recall and precision of added spans by kind, on documents that the weights were not trained on."""
    rng = np.random.default_rng(seed)
    hit, missed, wrong = Counter(), Counter(), Counter()
    for _ in range(times):
        text, gold = pii.document(rng)
        base, added, secrets = pii.found(text, model)
        got = {(s, e): k for s, k, e in added + secrets}
        for (s, e), k in gold.items():
            if k != "other" and not any(x < e and s < y for x, _, y in base):
                (hit if got.get((s, e)) == k else missed)[k] += 1
        for (s, e), k in got.items():
            wrong[k] += gold.get((s, e)) != k
    return {k: (hit[k] / (hit[k] + missed[k]), hit[k] / (hit[k] + wrong[k])) for k in hit}


def test_added_spans_of_held_out_documents():
    w, chain, skip = pii.weights()
    assert chain > 0 and skip > chain
    linked, alone = quality((w, chain, skip)), quality((w, 0.0, 0.0))
    assert all(r > 0.9 and p > 0.9 for r, p in linked.values()) and set(linked) == {"phone", "card", "secret"}
    assert linked["phone"][0] > alone["phone"][0] + 0.05  # what repeats and neighbours tell


def test_beliefs_are_exact_where_links_form_no_loop():
    """Sums over all labellings, on texts whose tokens form a chain."""
    rng = np.random.default_rng(5)
    w, chain, _ = model = pii.weights()
    seen = 0
    while seen < 40:
        text, _ = pii.document(rng)
        tokens = pii.candidates(text, pii.base_spans(text))
        chained, skips = pii.links_of(text, tokens)
        if skips or not 1 < len(tokens) < 6 or len(tokens) > pii.ROUNDS:
            continue
        seen += 1
        unary = [np.where(np.arange(len(pii.LABELS)) == k, 0.0, -50.0) if k >= 0 else w @ pii.shape(text[s:e], text[max(0, s - pii.CONTEXT) : s]) for s, e, k in tokens]
        total = np.zeros((len(tokens), len(pii.LABELS)))
        for labels in itertools.product(range(len(pii.LABELS)), repeat=len(tokens)):
            p = np.exp(sum(u[k] for u, k in zip(unary, labels, strict=True)) + chain * sum(labels[i] == labels[j] for i, j in chained))
            for i, k in enumerate(labels):
                total[i, k] += p
        assert pii.label(text, tokens, model) == total.argmax(1).tolist()


def test_secrets_have_columns_of_their_own(spark):
    text = 'api token = "40d78a45c418324758e099eb7cb89bc0f5fa9f62" and 40d78a45c418324758e099eb7cb89bc0f5fa9f62, call me@x.org'
    (row,) = pii.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    at = text.index("40d"), text.rindex("40d")
    assert row["spans"] == f"email:{text.index('me@')}:{len(text)}" and row["secrets"] == ",".join(f"secret:{i}:{i + 40}" for i in at) and row["n_spans"] == 3
    assert pii.redact(text) == 'api token = "<secret>" and <secret>, call <email>'
    assert pii.found("see the-long-path/of-some-words/chapter2 of it")[2] == []


@pytest.mark.parametrize("base", ["card 4111 1111 1111 1111", "10.0.0.1", "+49 170 1234567,", "me@example.com"])
def test_numbers_beside_base_matches_stay_candidates(base):
    for text in (f"{base} (555) 123-4567", f"(555) 123-4567 {base}"):
        at = text.index("(555)")
        known, spans = pii.find(text)
        assert len(known) == 1 and spans == sorted([*known, (at, "phone", at + 14)])


def test_pii_odd_rows(odd, none):
    got = pii.scan(odd).collect()
    assert len(got) == odd.count() and all(r["spans"] == "" and r["n_card"] == 0 for r in got)
    assert pii.scan(none).count() == 0 and pii.find(None) == ([], [])


# --- licences ---


@pytest.fixture(scope="module")
def licences(documents):
    return license_scan.learn(documents)


def test_every_template_is_confirmed(licences):
    for family, own in license_scan.TEMPLATES.items():
        for text in own:
            k, p, sure = licences.paragraph(license_scan.words(text.encode()))
            assert (licences.families[k], sure) == (family, True) and p >= license_scan.THRESHOLD, text


#: Wordings that no template has.
UNSEEN = {
    "mit": ["This project is distributed under the terms of the MIT license; see LICENSE for details.", "MIT License"],
    "apache": ["The code is made available under version 2.0 of the Apache License.", "Apache License 2.0"],
    "gpl": ["You may copy it under the terms of the GNU General Public License, version 3 or later.", "Published under the GNU General Public License v2"],
    "lgpl": ["Covered by the GNU Lesser General Public License, see COPYING.LESSER"], "agpl": ["GNU Affero General Public License applies to this server"],
    "bsd": ["Available under a BSD license, see COPYING", "BSD 2-Clause License"], "mpl": ["Subject to the Mozilla Public License 2.0"],
    "cc-by-sa": ["Text is available under the Creative Commons Attribution-ShareAlike License"], "cc-by-nc": ["Shared under Creative Commons Attribution-NonCommercial 4.0"],
    "cc0": ["Dedicated to the public domain with CC0"], "isc": ["ISC License applies"], "epl": ["Eclipse Public License v2.0 applies here"], "boost": ["Boost Software License 1.0"],
    "proprietary": ["Copyright 2020 the company, all rights reserved worldwide"],
}


def test_unseen_wordings_are_right_or_unknown(licences):
    got = [(f, licences.families[k], sure) for f, own in UNSEEN.items() for t in own for k, _, sure in [licences.paragraph(license_scan.words(t.encode()))]]
    assert all(k in (f, license_scan.UNKNOWN) for f, k, _ in got) and sum(k == f for f, k, _ in got) >= 0.4 * len(got)
    assert not any(sure for f, k, sure in got if f not in ("mit", "apache", "gpl", "proprietary", "agpl", "lgpl"))


@pytest.mark.parametrize("family", ["mit", "bsd", "apache", "gpl", "lgpl", "agpl", "isc", "unlicense", "zlib"])
def test_whole_licence_texts(spark, licences, family):
    """All paragraphs of a family as one file, wrapped, with a title, and with numbers before clauses."""
    body = "\n\n".join("\n".join(textwrap.wrap(f"{i}. {t}", 72)) for i, t in enumerate(license_scan.TEMPLATES[family], 1) if len(t) > 80)
    text = f"A licence\n\nCopyright (c) 2020 Somebody\n\n{body}\n\nthe end"
    (row,) = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), licences).collect()
    assert row["families"] == family and row["n_confirmed"] >= body.count("\n\n") + 1


def test_families_by_brute_force(spark, sf_dir, texts):
    """Each line against each template, by counting shingles."""
    templates = [(f, license_scan.words(t.encode())) for f, own in license_scan.TEMPLATES.items() for t in own]

    def holds(line, own):
        n = min(5, len(own))
        need = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
        there = {tuple(line[i : i + n]) for i in range(len(line) - n + 1)}
        return len(need & there) >= 0.8 * len(need)

    got = {r["doc_id"]: r["families"] for r in license_scan.query(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        lines = [license_scan.words(x.encode()) for x in (text or "").split("\n")]
        assert got[i] == ",".join(sorted({f for line in lines if line for f, own in templates if holds(line, own)}))


def test_ordinary_paragraphs_are_unknown(licences, texts):
    lines = [x for t in texts.values() for x in t.split("\n") if not re.search("icense|rights", x)]
    assert sum(licences.paragraph(license_scan.words(x.encode()))[2] for x in lines[:2000]) == 0
    assert licences.paragraph(license_scan.words(b"a driving license is not for everyone"))[0] == 0


def test_licences_of_documents(documents, texts, licences):
    got = {r["doc_id"]: r["families"] for r in license_scan.scan(documents, licences).collect()}
    for word, family in (("Apache License", "apache"), ("GNU General", "gpl"), ("MIT License", "mit"), ("CC BY-NC", "cc-by-nc")):
        assert {i for i, t in texts.items() if word in t} == {i for i, f in got.items() if family in f.split(",")}


@pytest.mark.parametrize("sign", ["", " * ", "# "])
@pytest.mark.parametrize("family", ["mit", "gpl", "agpl", "lgpl", "bsd", "isc", "cc0", "apache"])
def test_wrapped_notices(spark, licences, family, sign):
    rest = ", either version 3 of the License, or (at your option) any later version." if "gpl" in family else ""
    notice = license_scan.TEMPLATES[family][-1] + rest
    texts = ["\n".join(["import it", *textwrap.wrap(notice, width, initial_indent=sign, subsequent_indent=sign), "int main() {}", "", "behind"]) for width in (40, 72, 78)]
    got = license_scan.scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), licences).collect()
    for r in got:
        assert r["families"] == family and r["n_confirmed"] == 1 and r["paragraphs"][0]["place"] == 1
        assert r["n_paragraphs"] == len([x for x in texts[r["doc_id"]].split("\n") if x])


def test_wrapped_notices_lie_in_consecutive_lines(licences):
    notice = license_scan.words(license_scan.TEMPLATES["mit"][-1].encode())
    assert licences.notices([b"x", *notice, b"x"], [0] * 10 + [1] * (len(notice) - 8)) == [(1, len(notice) + 1)]
    assert licences.notices(notice, [0] * len(notice)) == [] and licences.notices(notice[:15], [0] * 7 + [1] * 8) == []


def test_licence_odd_rows(odd, none, licences):
    got = license_scan.scan(odd, licences).collect()
    assert len(got) == odd.count() and {r["n_paragraphs"] for r in got if r["doc_id"] in (3, 4)} == {0}
    assert license_scan.scan(none, license_scan.learn(none)).count() == 0
