"""Operators on documents against brute force, on awkward tables."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from hindcast.llm import langid, mixing, packing, simhash, token_files
from hindcast.llm.bpe import encoder, public_tokenizer
from hindcast.llm.common import scratch_path
from tests.llm.cases import EN, DE, WORDS, awkward_docs, empty_docs, n_words


@pytest.fixture(scope="module")
def docs(spark):
    return awkward_docs(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [r.asDict() for r in docs.collect()]


def plain_ids(text):
    return encoder(public_tokenizer()).tok.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_piece_cache_equals_library():
    import pyarrow as pa

    texts = ["", "it's don't 's ''s I'llx\n's", " a  b   c\n\nd \n e", "１２3½x", "日本語 😀 ！？", "a<|endoftext|>b", "\r\n\t x", None]
    got = encoder(public_tokenizer()).encode(pa.array(texts))
    assert [g.tolist() + [2] for g in got] == [plain_ids(t) for t in texts]


def test_token_files_round_trip(spark, docs, rows):
    path = scratch_path(spark, "t")
    token_files.write_token_files(docs, path)
    got = token_files.read_token_files(spark, path, with_ids=True).orderBy("start").collect()
    want = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in want]
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == crc(r["ids"])
        at += r["n_tokens"]
    key = lambda i, ids: (i is None, i or 0, ids)
    assert sorted((key(r["doc_id"], list(r["ids"])) for r in got)) == sorted(key(r["doc_id"], plain_ids(r["text"])) for r in rows)
    shuffled = token_files.read_shuffled(spark, path, seed=3, partitions=2)
    assert sorted((r["doc_id"] or 0, len(r["ids"])) for r in shuffled.collect()) == sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got)


def test_token_files_empty_and_damaged(spark, tmp_path):
    path = scratch_path(spark, "t")
    assert token_files.write_token_files(empty_docs(spark), path) == []
    assert token_files.read_token_files(spark, path).count() == 0
    record = bytearray(token_files.frame(5, np.array([1, 70000])))
    import io

    assert token_files.unframe(io.BytesIO(record))[1].tolist() == [1, 70000]
    record[-6] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        token_files.unframe(io.BytesIO(record))
    with pytest.raises(ValueError, match="ends inside"):
        token_files.unframe(io.BytesIO(record[:-7]))


def check_packing(out, want):
    """``want``: (doc_id, ids) of every document."""
    capacity = 1024
    pieces = defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
    expected = Counter()
    for name, ids in want:
        a, b = 0, (len(ids) - 1) % capacity + 1
        k = 0
        while a < len(ids):
            expected[(name, k, a, b - a, crc(ids[a:b]))] += 1
            a, b, k = b, b + capacity, k + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == expected
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_places_every_piece(spark, docs, rows):
    out = packing.pack_documents(docs).collect()
    want = [(r["doc_id"], plain_ids(r["text"])) for r in rows]
    used = check_packing(out, want)
    least = -(-sum(len(i) for _, i in want) // 1024)
    assert least <= used <= least + 1
    assert packing.pack_documents(empty_docs(spark)).count() == 0


def test_genetic_steps_keep_packings_valid_and_do_not_worsen():
    rng = np.random.default_rng(0)
    sizes = np.sort(rng.integers(100, 700, 600))[::-1].astype(np.int64)
    p = packing.PackParams(generations=20)
    first = packing.best_fit(sizes, np.arange(len(sizes)), p.capacity)
    people = packing.evolve(sizes, [], p, rng)
    for b in people:
        fill = np.bincount(b, weights=sizes)
        assert fill.max() <= p.capacity and fill.min() > 0 and len(b) == len(sizes)
    assert people[0].max() <= first.max()


def test_blocks_and_islands(spark):
    rng = np.random.default_rng(1)
    rows = [(k, 0, 0, int(n), k) for k, n in enumerate(rng.integers(1, 1025, 900))]
    pieces = spark.createDataFrame(rows, packing.PIECE)
    p = packing.PackParams(block_pieces=200, epochs=2, generations=3)
    out = packing.pack(pieces, p).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(900))
    fill = defaultdict(int)
    for r in out:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 1024
    assert len(fill) <= 1.06 * sum(n for _, _, _, n, _ in rows) / 1024


def brute_phrases(text, sample):
    """Greedy longest matches by substring search."""
    n, at = 0, 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in sample:
            end += 1
        at = max(at + 1, end - 1)
        n += 1
    return n


def test_cross_parse_equals_substring_search():
    p = langid.LangIdParams(segment_letters=64)
    parser = langid.CrossParser({"de": [DE * 2], "en": [EN * 2]}, p)
    probe = "the dogs gingen über the cold hügel qx zzz " * 3
    codes = parser.code[langid.normalise(probe)]
    got = parser.phrases([codes])
    for k, sample in enumerate((DE * 2, EN * 2)):
        own = "".join(map(chr, parser.code[langid.normalise(sample)].tolist()))
        text = "".join(map(chr, codes.tolist()))
        assert got[k, 0] == sum(brute_phrases(text[a : a + 64], own) for a in range(0, len(text), 64))


@pytest.mark.parametrize("letters", [0, 3, 60])
def test_cross_parse_with_any_number_of_columns(letters):
    """Letters beyond the dense table's columns, and letters of no sample."""
    rng = np.random.default_rng(letters)
    base = [chr(0x4E00 + k) for k in range(90)]
    samples = {"x": "".join(rng.choice(base[:60], 700)), "y": "".join(rng.choice(base[30:], 700)) + " ab ab"}
    parser = langid.CrossParser({k: [v] for k, v in samples.items()}, langid.LangIdParams(segment_letters=50, letters=letters))
    probe = "".join(rng.choice([*base, "a", "b", "ж", " "], 400)) + samples["x"][100:160] + samples["y"][20:90]
    codes = parser.code[langid.normalise(probe)]
    got = parser.phrases([codes])
    for k, name in enumerate("xy"):
        own = "".join(map(chr, (parser.code[langid.normalise(samples[name])] + 1).tolist()))
        text = "".join(map(chr, (codes + 1).tolist()))
        assert got[k, 0] == sum(brute_phrases(text[a : a + 50], own) for a in range(0, len(text), 50))


def test_languages_of_many_letters(spark):
    """Three scripts and two languages that share most of theirs; letters
    beyond the commonest 60 decide."""
    rng = np.random.default_rng(3)
    common = [chr(0x4E00 + k) for k in range(200)]
    own = {"za": [chr(0x5E00 + k) for k in range(120)], "zb": [chr(0x6E00 + k) for k in range(120)], "ru": list("абвгдежзиклмнопрстуфхцчшщ"), "hi": [chr(0x0905 + k) for k in range(50) if chr(0x0905 + k).isalpha()]}
    shared = {"za": common, "zb": common, "ru": [], "hi": []}

    words = {k: ["".join(rng.choice(shared[k] + own[k], n)) for n in rng.integers(1, 5, 150)] for k in own}

    def text(k):
        return ("" if k[0] == "z" else " ").join(rng.choice(words[k], 60))

    rows = [(n, text(k), k) for n, k in enumerate(list(own) * 40)]
    rows += [(1000 + n, text(k), None) for n, k in enumerate(list(own) * 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, langid.labelled_sample(docs)).collect()}
    assert all(got[1000 + n] == k for n, k in enumerate(list(own) * 25))


def test_sample_is_bounded_and_spread(spark):
    text = "".join(chr(97 + k * 26 // 6000) for k in range(6000))
    docs = spark.createDataFrame([(k, f"{k} {text}", "x") for k in range(300)], "doc_id long, text string, lang string")
    sample = langid.labelled_sample(docs)["x"]
    assert len(sample) == 48 and all(len(t) <= 1003 and "a" in t and "z" in t for t in sample)


def test_language_of_awkward_texts(spark, docs):
    sample = langid.labelled_sample(docs)
    assert set(sample) == {"de", "en"}
    out = langid.identify(docs, sample)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and "a.b" in out.columns
    assert out.count() == docs.count()
    for r in out.collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        assert 0.0 <= r["score"] <= 1.0 and (letters or r["score"] == 0.0)
    got = {r["doc_id"]: r["lang_pred"] for r in out.filter("doc_id IN (1, 3, 7, 8)").collect()}
    assert got == {1: "en", 3: "de", 7: "en", 8: "de"}
    assert langid.identify(empty_docs(spark), sample).count() == 0
    assert langid.labelled_sample(empty_docs(spark)) == {}
    assert {r["lang_pred"] for r in langid.identify(docs, {}).collect()} == {"und"}


def test_held_out_accuracy(spark):
    from hindcast.llm.queries import op6_language_id

    sf = "/root/testdata/sf0.001"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = [r for r in op6_language_id(spark, sf).collect() if r["held_out"]]
    assert out and sum(truth[r["doc_id"]] == r["lang_pred"] for r in out) >= 0.97 * len(out)


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(low)
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, radius=3):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, name in enumerate(ids):
        if name is not None:
            least[find(i)] = min(least.get(find(i), name), name)
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash_components(spark, docs, rows):
    prints = [brute_fingerprint(r["text"]) for r in rows]
    part = brute_components([r["doc_id"] for r in rows], prints)
    key = lambda x: tuple(-1 if v is None else v for v in x)
    want = sorted((key((r["doc_id"], f"{f:016x}", c)) for r, f, c in zip(rows, prints, part)))
    got = simhash.near_duplicates(docs).collect()
    assert sorted(key((r["doc_id"], r["fingerprint"], r["component_id"])) for r in got) == want
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0


def test_keep_one_row_of_each_group(spark, docs, rows):
    part = brute_components([r["doc_id"] for r in rows], [brute_fingerprint(r["text"]) for r in rows])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(part))
    assert simhash.keep_one(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_bit_sliced_links_equal_all_pairs(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, (40, 4)).astype(np.uint64)).sum(1, dtype=np.uint64) for b in base])
    bucket = np.sort(rng.integers(0, 4, len(fps)))
    side = np.zeros(len(fps), dtype=np.int64)
    side[bucket == 3] = rng.integers(0, 2, int((bucket == 3).sum()))
    got = {tuple(sorted(x)) for x in simhash.sliced_links(fps, bucket, side, radius, chunk=50).tolist()}
    want = {
        (i, j)
        for j in range(len(fps))
        for i in range(j)
        if bucket[i] == bucket[j] and bin(int(fps[i] ^ fps[j])).count("1") <= radius and (bucket[i] != 3 or side[i] != side[j])
    }
    assert got == want


def test_large_buckets_are_tiled_without_loss(spark):
    rng = np.random.default_rng(5)
    fps = {0}
    while len(fps) < 300:
        fps.add(int(sum(1 << int(b) for b in rng.choice(62, rng.integers(1, 6), replace=False))))
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = simhash.fingerprint_links(df, 3, tile=32)
    from hindcast.llm.components import components

    root = {r["node"]: r["root"] for r in components(links).collect()}
    want = brute_components(fps, fps)
    assert [root.get(f, f) for f in fps] == want


def test_components_of_long_chains(spark):
    from hindcast.llm.components import components

    links = [(k, k + 1) for k in range(60)] + [(100, 101), (7, 7), (None, 3), (101, 100)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {101: 100}


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, free, fixed = share * sum(sizes.values()), set(names), {}
    while free:
        level = (total - sum(fixed.values())) / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            return fixed | {s: level * w[s] for s in free}
        for s in over:
            free.discard(s)
            fixed[s] = most * sizes[s]
    return fixed


def test_mixture_meets_targets(spark, docs, rows):
    plan = mixing.plan_mixture(docs)
    got = plan.collect()
    assert len(got) == len(rows) and "a.b" in plan.columns
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += n_words(r["text"])
    targets = brute_targets(sizes)
    taken = Counter()
    for r in got:
        assert r["size"] == n_words(r["text"]) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert len(r["places"]) <= 2
        taken[r["source"]] += r["size"] * len(r["places"])
    for s in sizes:
        largest = max(n_words(r["text"]) for r in rows if r["source"] == s)
        assert abs(taken[s] - targets[s]) <= max(largest * 2, 1)
    again = mixing.plan_mixture(docs.repartition(3))
    flat = lambda rs: sorted((str(r["doc_id"]), str(r["text"]), str(r["places"])) for r in rs)
    assert flat(got) == flat(again.collect())
    assert mixing.plan_mixture(empty_docs(spark)).count() == 0


def test_split_tree_is_exact_and_disjoint():
    draws = np.array([1000, 37, 0, 5, 411])
    quotas = np.stack([mixing.shard_quotas(draws, 13, s, 4) for s in range(13)])
    assert (quotas >= 0).all() and (quotas.sum(0) == draws).all()
    total = int(draws.sum())
    assert quotas.sum(1).tolist() == [total * (s + 1) // 13 - total * s // 13 for s in range(13)]


def test_draws_from_urns_of_any_size(monkeypatch):
    draws = np.array([3 * 10**9, 5 * 10**9, 0, 70, 2 * 10**12])
    quotas = np.stack([mixing.shard_quotas(draws, 5, s, 4) for s in range(5)])
    total = int(draws.sum())
    assert (quotas >= 0).all() and (quotas.sum(0) == draws).all()
    assert quotas.sum(1).tolist() == [total * (s + 1) // 5 - total * s // 5 for s in range(5)]
    # shares are those of the urn up to some standard deviations
    for k, n in enumerate(draws.tolist()):
        assert all(abs(q - n / 5) <= 6 * (n * 0.2 * 0.8 + 1) ** 0.5 for q in quotas[:, k].tolist())
    # the own sampler has the law of numpy's: every probability within its sampling error
    monkeypatch.setattr(mixing, "_NUMPY_URN", 0)
    rng = np.random.default_rng(1)
    for good, bad, take in ((30, 50, 20), (50, 30, 60), (7, 200, 100), (200, 7, 150), (40, 40, 40)):
        runs = 20_000
        mine = Counter(mixing.hypergeometric(good, bad, take, rng) for _ in range(runs))
        from math import comb

        for x in range(max(0, take - bad), min(good, take) + 1):
            p = comb(good, x) * comb(bad, take - x) / comb(good + bad, take)
            assert abs(mine[x] / runs - p) <= 5 * (p * (1 - p) / runs) ** 0.5 + 1e-4
        assert min(mine) >= max(0, take - bad) and max(mine) <= min(good, take)


def test_mixture_rows_follow_the_plan(spark, docs):
    p = mixing.MixParams(shard_size=200, blocks=8)
    times = Counter()
    for r in mixing.plan_mixture(docs, p).collect():
        times[(r["doc_id"], r["text"])] += len(r["places"])
    out = mixing.mixture(docs, p).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter({k: n for k, n in times.items() if n})


def test_shards_are_mixed_whatever_the_size(spark):
    """Many shards of sources with very different sizes: every shard holds every source, about as often as asked."""
    from pyspark.sql import functions as F

    names = F.array(*[F.lit(f"s{k}") for k in (0, 0, 0, 0, 1, 2, 3, 4)])
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.element_at(names, (F.col("id") % 8 + 1).cast("int")).alias("source"))
    docs = docs.withColumn("text", F.concat(F.lit("a b c d e f g h i "), F.col("doc_id").cast("string"))).cache()
    p = mixing.MixParams(shard_size=2000, blocks=4)
    got = mixing.plan_mixture(docs, p).collect()
    taken, want = Counter(), {r["source"]: r["target"] for r in got}
    shards = defaultdict(Counter)
    for r in got:
        for place in r["places"]:
            taken[r["source"]] += r["size"]
            shards[place["shard"]][r["source"]] += r["size"]
    assert all(abs(taken[s] - want[s]) <= 10 for s in want)
    assert sorted(shards) == list(range(30)) and sum(want.values()) == pytest.approx(60000)
    for held in shards.values():
        assert set(held) == set(want) and 1500 <= sum(held.values()) <= 2500
        assert all(want[s] / 30 / 4 <= held[s] <= want[s] / 30 * 3 for s in want)
    # larger plans are joined by key
    places = lambda rs: {r["doc_id"]: r["places"] for r in rs}
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        keyed = mixing.plan_mixture(docs, mixing.MixParams(shard_size=2000, blocks=4, broadcast_bytes=-1))
        assert "Broadcast" not in keyed._jdf.queryExecution().sparkPlan().toString()
        assert places(keyed.collect()) == places(got)
    finally:
        spark.conf.set(limit, before)


def test_cut_pieces_skip_the_librarys_own_cutting():
    import os

    import pyarrow as pa

    enc = encoder(public_tokenizer())
    assert enc._lines is not None and os.environ["TOKENIZERS_PARALLELISM"]
    texts = ["Hello there, it's 2 caf\u00e9s \u4e2d\u6587 \x7f\x01x\u00ad\u00a0y\n\n  z", "", " a\tb \u00ff\u0100", "\U0001f600 ok"]
    enc.reset()
    got = [x.tolist() for x in enc.encode(pa.array(texts))]
    assert got == [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]


ODD_TEXTS = [
    "Hello there, it's 2 caf\u00e9s \u4e2d\u6587 \x7f\x01x\u00ad\u00a0y\n\n  z", "", " a\tb \u00ff\u0100", "\U0001f600 ok",
    "x" * 24 + " " + "x" * 25 + " " + "x" * 24 + "yz", "line\n\n\n\n   line\r\n", "x" * 24, "nul\0 nul nul\0\0", "Hello there, again",
]


def test_cut_pieces_go_to_the_model_alone(monkeypatch):
    import pyarrow as pa

    from hindcast.llm import bpe

    enc = bpe.PieceEncoder(public_tokenizer())
    want = [enc.tok.encode(t, add_special_tokens=False).ids for t in ODD_TEXTS]
    texts, ask, asked = pa.array(ODD_TEXTS), enc._ask, []

    def never(*args, **kwargs):
        raise AssertionError("no encoding is needed for a cut piece")

    def counted(pieces):
        asked.extend(pieces)
        return ask(pieces)

    monkeypatch.setattr(enc, "_fast", never)
    monkeypatch.setattr(enc, "_ask", counted)
    assert [x.tolist() for x in enc.encode(texts)] == want
    assert b"x" * 24 in asked and b" there" in asked
    # once more only the pieces that are too long to be remembered
    asked.clear()
    assert [x.tolist() for x in enc.encode(texts)] == want
    assert asked and all(len(p) > 24 for p in asked)
    # a block's ids are there before the next block is looked at
    enc.reset()
    asked.clear()
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 1)
    found = enc.encode(texts)
    assert next(found).tolist() == want[0] and b" ok" not in asked
    assert [x.tolist() for x in found] == want[1:]


@pytest.mark.parametrize("most", [1, 5, 1000])
@pytest.mark.parametrize("hashed", [True, False])
def test_remembered_pieces_are_forgotten_or_share_a_hash(monkeypatch, most, hashed):
    import numpy as np
    import pyarrow as pa

    from hindcast.llm import bpe

    keys = bpe._keys
    if not hashed:
        monkeypatch.setattr(bpe, "_keys", lambda pieces: (keys(pieces)[0], np.zeros(len(pieces), np.uint64)))
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 16)
    monkeypatch.setattr(bpe, "CACHE_PIECES", most)
    enc = bpe.PieceEncoder(public_tokenizer())
    want = [enc.tok.encode(t, add_special_tokens=False).ids for t in ODD_TEXTS]
    for lines in (enc._lines, None):  # a file with other characters for bytes has no call for lines of pieces
        enc._lines = lines
        enc.reset()
        for _ in range(3):
            assert [x.tolist() for x in enc.encode(pa.array(ODD_TEXTS))] == want
        assert most == 1000 or len(enc.known.last) <= 2 * most + 40
