"""Code compression, lexical search and fingerprints against brute force."""

from __future__ import annotations

import glob
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from hindcast.llm import bitsliced, codebooks, fingerprints, terms
from tests.llm.cases import EN, awkward_docs, empty_docs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return TERM.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def docs(spark):
    return awkward_docs(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [r.asDict() for r in docs.collect()]


# -- terms -------------------------------------------------------------------


def test_terms_equal_the_pattern():
    texts = ["", None, "Ab-c_1 Éa\x00b", "日本 語", "a", "b", "\x7f~", "x" * 5000, "ÀB c"]
    t = terms.split_terms(pa.array(texts))
    got = [[] for _ in texts]
    for code, doc in zip(t.codes, t.doc):
        got[doc].append(t.dictionary[int(code)].as_py().decode())
    assert got == [words_of(x) for x in texts]
    part = terms.split_terms(pa.array(texts).slice(2, 3))
    assert [t_.as_py().decode() for t_ in part.dictionary][:1] == ["ab"] and part.n_docs == 3
    assert len(set(terms.term_hashes(t.dictionary).tolist())) == len(t.dictionary)


# -- op11 --------------------------------------------------------------------


def plain_codebooks(vectors, labels, parts=8, entries=16, rounds=6, scale=4096):
    """``vectors`` in the order of ids."""
    from fractions import Fraction

    dim = -(-max(max(map(len, vectors)), 1) // parts) * parts
    ints = [[math.floor(Fraction(x) * scale) for x in v] + [0] * (dim - len(v)) for v in vectors]
    w = dim // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for v in ints]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(books[p]))

    for _ in range(rounds):
        moved = []
        for p in range(parts):
            of = [nearest(p, c[p])[1] for c in cut]
            new = []
            for n, e in enumerate(books[p]):
                mine = [c[p] for c, k in zip(cut, of) if k == n]
                new.append([sum(x) // len(mine) for x in zip(*mine)] if mine else e)
            moved.append(new)
        books = moved
    out = []
    for c in cut:
        best = [nearest(p, c[p]) for p in range(parts)]
        out.append((bytes(n for _, n in best), sum(d for d, _ in best)))
    flat = ",".join(str(x) for b in books for e in b for x in e)
    return out, hashlib.sha256(flat.encode()).hexdigest()


@pytest.mark.parametrize("size,dim,spread", [(5, 8, 1.0), (300, 16, 1.0), (60, 12, 1.0), (60, 16, 1e9), (40, 16, 1e200)])
def test_codebooks_equal_plain_integers(spark, size, dim, spread):
    rng = np.random.default_rng(size)
    vectors = (rng.normal(size=(size, dim)) * spread).tolist()
    vectors[1] = list(vectors[0])  # ties
    df = spark.createDataFrame([(k, v, k % 3) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int").repartition(5)
    made = codebooks.compress(df, keep=["vec_id"])
    want, digest = plain_codebooks(vectors, None)
    got = {r["vec_id"]: (bytes(r["code"]), r["error"]) for r in made.rows.collect()}
    assert got == {k: (c, min(e, 2**63 - 1)) for k, (c, e) in enumerate(want)}
    assert made.codebooks.sha256() == digest
    if spread == 1.0 and dim % 8 == 0:
        back = made.codebooks.decode(got[0][0])
        assert np.abs(back - np.array(vectors[0])).max() < 10


def test_codebooks_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(codebooks, "BLOCK_ROWS", 7)
    vectors = np.random.default_rng(2).normal(size=(100, 8)).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(3)
    want, digest = plain_codebooks(vectors, None)
    made = codebooks.compress(df)
    assert {r["vec_id"]: (bytes(r["code"]), r["error"]) for r in made.rows.collect()} == dict(enumerate(want)) and made.codebooks.sha256() == digest


def test_codebooks_awkward_rows(spark):
    schema = "vec_id long, embedding array<float>, label string, code string, error long, kept string"
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a"), (2, None, "a"), (3, [1.0, nan], "a"), (4, [inf, 0.0], None), (5, [None, 1.0], "b"), (None, [0.5, -0.5], None), (6, [], None)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in data], schema)
    made = codebooks.compress(df, keep=["vec_id", "code", "label"], parts=2, entries=4)
    got = made.rows.collect()
    assert sorted((r[0] is None, r[0] or 0, r[1]) for r in got) == [(False, 1, "x"), (False, 1, "x"), (False, 6, "x"), (True, 0, "x")]
    assert all(r["error"] == 0 for r in got)
    none = codebooks.compress(df.limit(0), keep=["vec_id"])
    assert none.rows.collect() == [] and none.codebooks is None and none.rows.columns == ["vec_id", "code", "error"]


@pytest.mark.parametrize("bound", [0, 1 << 20])
def test_sums_over_equal_values(spark, monkeypatch, bound):
    monkeypatch.setattr(codebooks, "SUMS_BYTES", bound)
    data = [("a", 2**62), ("a", 2**62), ("a", 2**62), (None, 1), (None, 2), ("b", 5), ("b", 5)]
    got = codebooks.sum_over_equal(spark.createDataFrame(data, "g string, v long"), "g", "v", "s").collect()
    assert sorted(((r["g"] or "", r["v"], r["s"]) for r in got)) == sorted([("a", 2**62, 2**63 - 1)] * 3 + [("", 1, 3), ("", 2, 3)] + [("b", 5, 10)] * 2)


# -- op12 --------------------------------------------------------------------


def plain_ranking(docs, items, k):
    held = [(i, Counter(words_of(t))) for i, t in docs]
    with_terms = [c for _, c in held if c]
    n_docs, length = len(with_terms), sum(sum(c.values()) for c in with_terms)
    df = Counter(w for c in with_terms for w in c)
    out = []
    for item, text in items:
        asked = Counter(words_of(text))
        found = []
        for i, c in held:
            n = sum(c.values())
            m = 75 + (25 * n * n_docs) // length if n else 0
            score = sum(t * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w, t in asked.items() if c[w])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return out


def _key(r):
    return tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("block_bytes,k", [(4 << 20, 20), (300, 3), (3000, 1)])
def test_search_equals_full_scoring(spark, docs, rows, monkeypatch, block_bytes, k):
    monkeypatch.setattr(bitsliced, "ITEM_ROWS", 4)
    items = [(1, EN), (2, "the OLD town town town 36"), (3, None), (4, ""), (5, "nothing-like-it"), (None, "number 25 625"), (2, "katze stadt"), (7, "日本語 ünïcode x'll"), (8, EN * 40)]
    found = bitsliced.search(bitsliced.build_index(docs, block_bytes=block_bytes), spark.createDataFrame(items, "item_id int, text string"), k)
    assert dict(found.dtypes) == {"item_id": "int", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    want = plain_ranking([(r["doc_id"], r["text"]) for r in rows], items, k)
    assert sorted(map(_key, (tuple(r) for r in found.collect()))) == sorted(map(_key, want))


def test_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert bitsliced.search(bitsliced.build_index(empty_docs(spark)), items).collect() == []
    index = bitsliced.build_index(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"))
    assert bitsliced.search(index, items.limit(0)).collect() == []
    assert [tuple(r)[:3] for r in bitsliced.search(index, items).collect()] == [(1, 1, 1)]


def test_bounds_hold_and_exclude():
    """No score is above its bound, and most documents are left out unscored."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(4000)]
    share = 1 / np.arange(1, 4001)
    share /= share.sum()
    texts = [" ".join(rng.choice(vocabulary, int(n), p=share)) for n in rng.integers(20, 400, 1500)]
    block = bitsliced.index_block(pa.array(range(1500)), pa.array(texts, pa.large_string()))
    asked = bitsliced.Asked.of([" ".join(t.split()[:30]) for t in texts[:20]])
    df = Counter(w for t in texts for w in set(t.split()))
    asked.documents, asked.length = 1500, sum(block["n"])
    asked.weight = np.array([bitsliced.term_weight(1500, df[w.as_py().decode()]) for w in asked.vocabulary])
    known = np.arange(len(asked.vocabulary))
    m = bitsliced._length_norm(np.array(block["n"]), asked)
    words = [w.as_py().decode() for w in asked.vocabulary]
    counts = [Counter(t.split()) for t in texts]
    for g in block["groups"]:
        at = np.frombuffer(g["docs"], "<i4")
        limit = bitsliced.bounds(g, asked, known, m[at])
        for p in range(0, len(at), 7):
            c, d = counts[at[p]], int(m[at[p]])
            for item in range(20):
                pairs = np.flatnonzero(asked.item == item)
                score = sum(int(asked.weight[t] * n) * ((10**9 * c[words[t]]) // (1000 * c[words[t]] + 12 * d)) for t, n in zip(asked.term[pairs], asked.times[pairs]) if c[words[t]])
                assert score <= limit[item, p]
    pairs, rescored = bitsliced.search_block(block, asked, bitsliced.Best(20, 10))
    assert pairs == 30000 and rescored < 0.2 * pairs


def test_search_memory_does_not_grow(spark, docs, monkeypatch):
    """A block of the index is a row group of its own, and one batch for the
    tasks that read it; documents of a block are searched in bounded pieces."""
    index = bitsliced.build_index(docs.coalesce(1), block_bytes=600)
    files = glob.glob(f"{index.blocks._scratch_path.removeprefix('file:')}/*.parquet")
    groups = [pq.ParquetFile(f).metadata.row_group(g).num_rows for f in files for g in range(pq.ParquetFile(f).num_row_groups)]
    assert len(groups) == index.blocks.count() > 5 and set(groups) == {1}

    texts = [f"a{k % 7} b{k % 11} " + "c " * (k % 5) for k in range(3000)]
    block = bitsliced.index_block(pa.array(range(3000)), pa.array(texts, pa.large_string()))
    asked = bitsliced.Asked.of([f"a{k % 7} b{k} c" for k in range(40)])
    asked.documents, asked.length = 3000, sum(block["n"])
    asked.weight = np.array([bitsliced.term_weight(3000, 400)] * len(asked.vocabulary))
    seen = []
    plain = bitsliced.bounds
    monkeypatch.setattr(bitsliced, "bounds", lambda *a: seen.append(plain(*a)) or seen[-1])
    found = []
    for cells in (1 << 40, 4000, 1):
        monkeypatch.setattr(bitsliced, "SEARCH_CELLS", cells)
        seen.clear()
        best = bitsliced.Best(40, 10)
        bitsliced.search_block(block, asked, best)
        assert sum(s.shape[1] for s in seen) == 3000 and max(s.size for s in seen) <= max(cells, 40 * 8)
        found.append([(s.tolist(), i.tolist()) for s, i in zip(best.score, best.id)])
    assert found[0] == found[1] == found[2]


# -- op13 --------------------------------------------------------------------


def plain_fingerprint(text):
    """As votes over a text's pairs of words, one text at a time."""
    w = words_of(text)
    pairs = Counter(zip(w, w[1:])) if len(w) > 1 else Counter(zip(w, w))
    if not pairs:
        return (0, 0)
    names = sorted({x.encode() for p in pairs for x in p})
    held = dict(zip(names, terms.term_hashes(pa.array(names, pa.large_binary())).tolist()))
    out = []
    for k in range(2):
        votes = [0] * 64
        for (a, b), tf in pairs.items():
            h = terms.mix64(np.array([(held[a.encode()] * 31 + held[b.encode()]) % 2**64], dtype=np.uint64))
            h = int(terms.mix64(h + np.uint64(k))[0])
            weight = 4 + math.floor(4 * math.log2(tf))
            for i in range(64):
                votes[i] += weight if h >> i & 1 else -weight
        out.append(sum(1 << i for i in range(64) if votes[i] > 0))
    return tuple(out)


def test_fingerprints_equal_votes(rows):
    texts = [r["text"] for r in rows] + ["one", "one one", "one two one two one two"]
    got = fingerprints.fingerprint_texts(pa.array(texts))
    assert [tuple(map(int, f)) for f in got] == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("parts", [1, 4])
def test_edited_documents(spark, docs, rows, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = fingerprints.edited_fingerprints(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r["text"] or "")
    alone = [i for i in sorted((i for i in by_id if i is not None), reverse=True) if len(by_id[i]) == 1]
    found = {r["doc_id"]: r for r in got}
    for i, j in zip(alone, alone[1:]):
        if any(i > k > j for k in by_id if k is not None):
            continue
        text, following = by_id[i][0], by_id[j][0]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = found[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, new, after = (np.array(plain_fingerprint(t), dtype=np.uint64) for t in (text, edited, following))
        assert [r["fp0"] % 2**64, r["fp1"] % 2**64] == own.tolist() and [r["edited0"] % 2**64, r["edited1"] % 2**64] == new.tolist()
        assert r["near_edited"] == pytest.approx(float(fingerprints.likeness(own, new))) and r["near_next"] == pytest.approx(float(fingerprints.likeness(own, after)))
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_edited_wraps_and_empties(spark):
    one = fingerprints.edited_fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert [(r["edited_sha256"], r["near_next"]) for r in one] == [(hashlib.sha256(b"abcabc").hexdigest(), 1.0)]
    two = fingerprints.edited_fingerprints(spark.createDataFrame([(1, "aaaa"), (2, "bbbbbb"), (None, None)], "doc_id long, text string")).collect()
    want = {2: "bbbaaa", 1: "aa", None: ""}
    assert {r["doc_id"]: r["edited_sha256"] for r in two} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}
    assert fingerprints.edited_fingerprints(empty_docs(spark)).collect() == []


@pytest.mark.parametrize("radius,tile", [(3, 1 << 13), (3, 5), (6, 7), (0, 50)])
def test_block_tables_equal_all_pairs(spark, radius, tile):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, size=(6, 2), dtype=np.uint64) * np.uint64(2)
    fps = []
    for k in range(240):
        fp = base[k % 2 if k < 160 else k % 6].copy()
        for bit in rng.choice(128, rng.integers(0, 5), replace=False):
            fp[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        fps.append(fp)
    fps += [fps[0]] * 5
    fps = np.array(fps)
    ids = [None if k % 11 == 3 else 1000 - k for k in range(len(fps))]
    signed = fps.view(np.int64)
    df = spark.createDataFrame([(ids[k], int(signed[k, 0]), int(signed[k, 1])) for k in range(len(fps))], "doc_id long, fp0 long, fp1 long")
    got = {(r["fp0"], r["fp1"]): (r["n_near"], r["near_id"]) for r in fingerprints.near_counts(df, ["fp0", "fp1"], radius, tile).collect()}
    near = np.bitwise_count(fps[:, None] ^ fps[None]).sum(2) <= radius
    want = {}
    for k in range(len(fps)):
        who = np.flatnonzero(near[k])
        want[tuple(signed[k].tolist())] = (len(who), min((ids[j] for j in who if ids[j] is not None), default=None))
    assert got == want
