import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, simhash, substring_dedup


# --- exact ---


def test_exact_agrees_with_sql(documents, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({exact_dedup.SQL})").fetchall())
    for hashed in (F.xxhash64, lambda x: F.xxhash64(x) % 7, lambda x: F.lit(-5).cast("long")):  # the last two collide
        got = exact_dedup.groups(documents, 10, 8, hashed)
        assert sorted(tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == want


@pytest.mark.parametrize("hot", [2_000, 3])
def test_index_chains_what_collides(spark, documents, texts, monkeypatch, hot):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", hot)
    hashed = lambda x: F.xxhash64(x) % 7 * (1 << 58)
    index, held, depth = exact_dedup.build_index(documents, exact_dedup.keyed(documents, hashed), 1, 4, hashed)
    rows, slots = index.collect(), held.collect()
    distinct = {re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts.values()}
    assert 0 < depth <= 4 and len(slots) == 1 << depth and len({r["digest"] for r in rows}) == len(rows) == len(distinct)
    chains = defaultdict(list)
    for r in rows:
        chains[r["hash"]].append(r["chain"])
        assert next(s["bucket"] for s in slots if s["slot"] == r["hash"] % (1 << 64) >> (64 - depth)) == r["bucket"]
    assert len(chains) > 7 and all(sorted(c) == list(range(len(c))) for c in chains.values()) and max(map(len, chains.values())) > 5


def test_a_registered_run_doubles_the_directory(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    _, held, depth = exact_dedup.build_index(docs, exact_dedup.keyed(docs))
    assert depth > 0 and held.count() == 1 << depth


def test_owners_hold_ranges_of_buckets():
    rows = {i: 10 + i % 3 for i in range(256)}
    held = exact_dedup.owners_of(exact_dedup.directory(rows, 50, 8), rows, 7, 8)
    owners = [o for *_, o in held]
    assert owners == sorted(owners) and set(owners) == set(range(7))
    assert exact_dedup.owners_of([(0, 0, 0)], {}, 4, 8) == [(0, 0, 0, 0)]


def test_directory_doubles_only_where_it_must():
    slots = exact_dedup.directory({0: 5, 1: 5, 2: 1, 7: 1}, capacity=6, max_depth=3)
    assert len(slots) == 8 and [s[0] for s in slots] == list(range(8))
    assert [(b, d) for _, b, d in slots] == [(0, 3), (1, 3), (2, 2), (2, 2), (3, 1), (3, 1), (3, 1), (3, 1)]
    assert exact_dedup.directory({}, 6, 3) == [(0, 0, 0)]
    assert max(d for _, _, d in exact_dedup.directory({3: 100}, 6, 3)) == 3  # one value cannot be split: it chains


def test_exact_odd_rows(odd, none):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.groups(odd).collect()}
    assert got == {(1, 1, 4, True), (2, 1, 4, False), (5, 1, 4, False), (3, 3, 2, True), (4, 3, 2, False), (None, None, 1, True), (7, 7, 1, True), (8, 8, 1, True)}
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 3, None, 7, 8])
    assert exact_dedup.groups(none).count() == 0 and exact_dedup.deduplicate(none).count() == 0


def test_only_the_rows_judged_go(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in ("alpha", "beta", "gamma"))
    rows = [(1, a), (3, a), (3, b), (None, a), (None, c), (None, c), (4, f"{b} "), (5, b)]
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, place int")
    exact = exact_dedup.deduplicate(frame)
    assert exact.columns == frame.columns and sorted(r["place"] for r in exact.collect()) == [0, 2, 4, 5, 6]
    near = simhash.keep_one(frame)
    assert near.columns == frame.columns and sorted(r["place"] for r in near.collect()) == [0, 2, 4, 5]


# --- near ---


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(codes):
    label = list(range(len(codes)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i] ^ codes) <= 2):
            a, b = top(i), top(int(j))
            label[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(codes))]


def test_fingerprints(texts):
    for text in [*list(texts.values())[:30], "ÀB  cd\x85e", "one two", "", None, "A b C d\n"]:
        assert simhash.fingerprint((text or "").encode()) % (1 << 64) == brute_fingerprint(text)


def clusters(seed, n, size, flips):
    rng = random.Random(seed)
    out = set()
    for _ in range(n):
        base = rng.getrandbits(64)
        for _ in range(size):
            x = base
            for _ in range(rng.randint(0, flips)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("group", [16_384, 10])
def test_components_are_those_of_all_pairs(spark, group):
    codes = clusters(1, 20, 25, 4)
    frame = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fp long")
    root = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame, group)).collect()}
    got = defaultdict(set)
    for x in codes.view(np.int64).tolist():
        got[root.get(x, x)].add(x)
    want = defaultdict(set)
    for x, k in zip(codes.view(np.int64).tolist(), brute_components(codes), strict=True):
        want[k].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_forest_of_dense_groups():
    for seed in range(3):
        codes = clusters(seed, 3, 120, 3)
        codes = codes[np.argsort(simhash.gray_rank(codes))]
        assert simhash.forest(np.zeros(len(codes), np.int64), codes).tolist() == brute_components(codes)


def test_gray_rank():
    codes = np.array([i ^ (i >> 1) for i in range(64)], np.uint64)
    assert simhash.gray_rank(codes).tolist() == list(range(64))


def test_near_duplicates_whole_table(documents, texts):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(documents).collect()}
    ids = sorted(texts)
    codes = np.array([brute_fingerprint(texts[i]) for i in ids], np.uint64)
    want = {i: (f"{int(c):016x}", ids[k]) for i, c, k in zip(ids, codes, brute_components(codes), strict=True)}
    assert got == want


def test_near_odd_rows(odd, none):
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()}
    assert got == {(1, 1), (2, 1), (5, 1), (3, 3), (4, 3), (None, None), (7, 7), (8, 8)}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 3, None, 7, 8])
    assert simhash.near_duplicates(none).count() == 0


# --- substrings ---


def test_gear_hash_by_definition():
    data = np.frombuffer(random.Random(2).randbytes(100), np.uint8)
    h = substring_dedup.gear(data)
    for i in (0, 5, 15, 16, 99):
        x = 0
        for b in data[max(0, i - 15) : i + 1]:
            x = (2 * x + int(substring_dedup.TABLE[b])) % (1 << 32)
        assert x == h[i]


def test_chunks_cover_all_words(texts):
    for text in [*texts.values(), "", "one", "a " * 500, None]:
        data = (text or "").encode()
        parts = list(zip(*substring_dedup.chunks(data), strict=True))
        assert b" ".join(data[s:e] for s, e, _ in parts).split() == data.split()
        assert sum(n for _, _, n in parts) == len(data.split())
        assert all(n <= substring_dedup.LONG for _, _, n in parts)


def passages(texts, n, seed=3, times=300):
    rng = random.Random(seed)
    words = [w for t in texts.values() if t and len(set(w := t.split())) > 120]
    for _ in range(times):
        own = rng.choice(words)
        at = rng.randrange(max(1, len(own) - n))
        passage = " ".join(own[at : at + n])

        def host(passage=passage):
            other = rng.choice(words)
            cut = rng.randrange(len(other))
            return " ".join([*other[:cut], passage, *other[cut:]]).encode()

        yield host(), host()


def test_passages_of_over_fifty_words_share_chunks(texts):
    caught = 0
    for a, b in passages(texts, 51):
        there = {b[s:e] for s, e, _ in zip(*substring_dedup.chunks(b), strict=True)}
        caught += sum(int(n) for s, e, n in zip(*substring_dedup.chunks(a), strict=True) if a[s:e] in there) >= substring_dedup.LEAST
    assert caught >= 0.99 * 300


def brute_chunks(text):
    """By definition, word by word."""
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x00-\x20]+", text)]
    h = []
    for _, e in words:
        x = 0
        for b in text[max(0, e - 16) : e]:
            x = (2 * x + int(substring_dedup.TABLE[b])) % (1 << 32)
        h.append(x)
    n, r = len(h), substring_dedup.REACH
    out, first = [], 0
    for i in range(n):
        least = r <= i < n - r and all(h[i] < h[i - k] and h[i] <= h[i + k] for k in range(1, r + 1))
        if least or i == n - 1:
            out.append((words[first][0], words[i][1], i - first + 1))
            first = i + 1
    return out


def test_chunks_by_definition(texts):
    for text in [t.encode() for t in texts.values() if t and len(t) < 5000]:
        assert [tuple(map(int, c)) for c in zip(*substring_dedup.chunks(text), strict=True)] == brute_chunks(text) or max(n for *_, n in brute_chunks(text)) > substring_dedup.LONG


def test_the_query_by_brute_force(spark, sf_dir, texts):
    each = {i: [(int(s), int(e), int(n), t.encode()[s:e]) for s, e, n in zip(*substring_dedup.chunks(t.encode()), strict=True)] for i, t in texts.items()}
    where = defaultdict(list)
    for i in sorted(each):
        for c in each[i]:
            where[c[3]].append(i)
    want = []
    for i, own in each.items():
        met, run = set(), []
        for part in [*own, None]:
            if part and len(where[part[3]]) > 1:
                run.append(part)
                continue
            if sum(p[2] for p in run) >= substring_dedup.LEAST:
                removed = 0
                for p in run:
                    if where[p[3]][0] == i and p[3] not in met:
                        met.add(p[3])
                    else:
                        removed += p[2]
                want.append((i, run[0][0], run[-1][1], sum(p[2] for p in run), min(where[p[3]][0] for p in run), removed))
            run = []
    assert sorted(tuple(r) for r in substring_dedup.query(spark, sf_dir).collect()) == sorted(want)


def test_spans_by_brute_force(documents, texts):
    got = {(r["doc_id"], r["start"], r["after"]) for r in substring_dedup.spans(documents).collect()}
    each = {i: [(s, e, n, t.encode()[s:e]) for s, e, n in zip(*(x.tolist() for x in substring_dedup.chunks(t.encode())), strict=True)] for i, t in texts.items()}
    holders = defaultdict(set)
    for i, own in each.items():
        for *_, data in own:
            holders[data].add(i)
    want = set()
    for i, own in each.items():
        run = []
        for part in [*own, None]:
            if part and len(holders[part[3]]) > 1:
                run.append(part)
            else:
                if sum(p[2] for p in run) >= substring_dedup.LEAST:
                    want.add((i, run[0][0], run[-1][1]))
                run = []
    assert got == want


def test_substring_odd_rows(odd, none, spark):
    assert substring_dedup.spans(none).count() == 0 and substring_dedup.deduplicate(none).count() == 0
    cleaned = substring_dedup.deduplicate(odd)
    assert cleaned.columns == [*[c for c in odd.columns if c != "n_cut"], "n_cut"] and cleaned.count() == odd.count()
    text = " ".join(f"word{i}" for i in range(80))
    frame = spark.createDataFrame([(2, f"before it {text} behind"), (1, text), (3, "something else")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in substring_dedup.spans(frame).collect()}
    assert set(rows) == {1, 2} and rows[1]["n_removed"] == 0 and rows[2]["n_removed"] >= 50 and rows[2]["keep_doc_id"] == 1
    out = {r["doc_id"]: r["text"] for r in substring_dedup.deduplicate(frame).collect()}
    assert out[1] == text and out[2].startswith("before it") and len(out[2]) < 200 and out[3] == "something else"
    assert hashlib.sha256(out[1].encode()).hexdigest() == hashlib.sha256(text.encode()).hexdigest()


def test_rows_that_share_an_id_are_cut_by_their_own_spans(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text), (2, f"before {text}"), (2, f"\u00e9\u00e9\u00e9 {text} b\u00e9hind"), (None, f"before {text}"), (None, "another"), (2, None), (None, text)]
    frame = spark.createDataFrame([(*r, i, -1, "x") for i, r in enumerate(rows)], "doc_id long, text string, place int, n_cut int, _cuts string")
    out = substring_dedup.deduplicate(frame)
    assert out.columns == ["doc_id", "text", "place", "_cuts", "n_cut"]
    got = {r["place"]: r for r in out.collect()}
    assert got[0]["text"] == text and got[4]["text"] == "another" and got[5]["text"] is None and got[5]["n_cut"] == got[0]["n_cut"] == 0
    for i in (1, 2, 3, 6):
        assert got[i]["n_cut"] > 0 and 0 <= len(got[i]["text"].split()) < 30 and (got[i]["doc_id"], i) == (rows[i][0], i)
    assert got[1]["text"].startswith("before") and got[2]["text"].startswith("\u00e9\u00e9\u00e9") and got[2]["text"].rstrip().endswith("b\u00e9hind")


@pytest.mark.parametrize("words", [["a"], ["a", "b"], ["one", "two", "three"], ["p", "q", "r", "s"]])
def test_an_insertion_into_repeated_words_shifts_nothing(words):
    run = (words * 100)[:300]
    data = " ".join(run).encode()
    both = [{d[s:e] for s, e, _ in zip(*substring_dedup.chunks(d), strict=True)} for d in (data, " ".join([*run[:101], "put in", *run[101:]]).encode())]
    sizes = [n for _, _, n in zip(*substring_dedup.chunks(data), strict=True)]
    assert max(sizes) <= substring_dedup.LONG and len(both[0] & both[1]) >= len(both[0]) - 3


def test_passages_repeated_inside_one_document(spark, monkeypatch):
    block = " ".join(f"word{i}" for i in range(200))
    text = f"before it {' '.join([block] * 50)} behind"
    frame = spark.createDataFrame([(1, text), (2, "something else")], "doc_id long, text string")
    assert substring_dedup.spans(frame).count() == 0
    monkeypatch.setattr(substring_dedup, "table", lambda *_: frame)
    (row,) = substring_dedup.query(spark, "").collect()
    assert row["doc_id"] == row["keep_doc_id"] == 1 and row["n_removed"] >= 48 * 200
    out = {r["doc_id"]: r["text"] for r in substring_dedup.deduplicate(frame).collect()}
    assert out[1].startswith(f"before it {block}") and len(out[1].split()) <= 2 * 200 + 3 and out[2] == "something else"
