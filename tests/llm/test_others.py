"""Vector searches, WARC, URL filter, rollup and pipeline against brute force."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.llm import one_bit, pivot_search, url_filter, warc
from hindcast.llm.common import scratch_path
from hindcast.llm.rollup import TABLE, WORD_COUNTERS, TokenRollup, bpe_counter, signed_deltas
from tests.llm.cases import awkward_docs, empty_docs, n_words

VEC = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors(spark):
    """500 rows of clusters, a third of them one vector, and what takes no part."""
    rng = np.random.default_rng(7)
    base = rng.standard_normal((6, 24))
    rows = [(k, (base[k % 6] + 0.7 * rng.standard_normal(24)).tolist() if k % 3 else base[0].tolist(), k) for k in range(500)]
    rows += [(500, None, 1), (600, [1.0, None] + [0.0] * 22, 1), (700, [math.nan] * 24, 1), (800, [math.inf] + [0.0] * 23, 1)]
    rows += [(900, [0.0] * 24, 1), (1000, [0.5, 0.25], 1), (None, base[1].tolist(), 1), (100, base[0].tolist(), 2)]
    return spark.createDataFrame([(i, v, x) for i, v, x in rows], VEC).withColumn("dist", F.lit("x")).withColumn("cell", F.lit(1))


def usable(vectors, nonzero=False):
    out = {}
    for r in vectors.collect():
        v = r["embedding"]
        if r["vec_id"] is None or v is None or any(x is None or not math.isfinite(x) for x in v) or nonzero and not any(v):
            continue
        v = list(v)
        out[r["vec_id"]] = min(out.get(r["vec_id"], v), v)
    return {k: np.array(v + [0.0] * (24 - len(v))) for k, v in out.items()}


def test_exact_top_k_equals_brute_force(spark, vectors):
    rows = {k: np.floor(1024 * v).astype(np.int64) for k, v in usable(vectors).items()}
    want = []
    for q in rows:
        if q % 100 == 0:
            best = sorted(((-int(rows[q] @ v), k) for k, v in rows.items() if k != q))[:10]
            want += [(q, n + 1, k, -s) for n, (s, k) in enumerate(best)]
    got = pivot_search.exact_top_k(vectors, F.col("vec_id") % 100 == 0).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert pivot_search.exact_top_k(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    few = vectors.filter("vec_id IN (100, 101)")
    assert [(r["query_id"], r["vec_id"]) for r in pivot_search.exact_top_k(few, F.col("vec_id") % 100 == 0).collect()] == [(100, 101)]


@pytest.mark.parametrize("size", [4e4, 3e6, 1e10])
def test_exact_top_k_of_large_scores(spark, size):
    """Scores beyond 2^53, as 64-bit and as Python integers, with ties that
    doubles would not tell apart."""
    rng = np.random.default_rng(11)
    vectors = (rng.standard_normal((300, 64)) * size).astype(np.float64)
    for k in range(200, 230):
        vectors[k] = vectors[17]
        vectors[k, 3] += (k % 3) / 1024
    ints = [[math.floor(float(x) * 1024) for x in v] for v in vectors]
    far = 2**63 - 1
    want = []
    for q in range(0, 300, 10):
        best = sorted((-max(-far, min(far, sum(a * b for a, b in zip(ints[q], v)))), k) for k, v in enumerate(ints) if k != q)[:10]
        want += [(q, n + 1, k, -s) for n, (s, k) in enumerate(best)]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = pivot_search.exact_top_k(df, F.col("vec_id") % 10 == 0).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_one_bit_recall(spark, vectors):
    rows = usable(vectors, nonzero=True)
    got = one_bit.nearest(vectors, F.col("vec_id") % 50 == 0).collect()
    hits = total = 0
    for q in rows:
        if q % 50:
            continue
        cos = {k: float(rows[q] @ v) / math.sqrt(float(rows[q] @ rows[q]) * float(v @ v)) for k, v in rows.items() if k != q}
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(r["score"] == pytest.approx(cos[r["vec_id"]], abs=1e-12) for r in mine)
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        fifth = sorted(cos.values())[-5]
        hits += sum(r["score"] >= fifth - 1e-12 for r in mine)
        total += 5
    assert total and hits >= 0.9 * total
    assert one_bit.nearest(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_one_bit_recall_on_unclustered_rows(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    data = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in rows.collect()}
    got = one_bit.nearest(rows, F.col("vec_id") % 50 == 0).collect()
    want = set()
    for q in data:
        if q % 50 == 0:
            cos = sorted(((-float(data[q] @ v) / math.sqrt(float(data[q] @ data[q]) * float(v @ v)), k) for k, v in data.items() if k != q))
            want |= {(q, k) for _, k in cos[:5]}
    assert len(want & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.9 * len(want)


def pages(spark):
    big = "<p>" + "same payload " * 20 + "</p>"
    rows = [(3, "http://a.example.com/x", big), (1, "http://b.example.com/x\r\nWARC-Type: fake", big), (2, None, big), (4, "u", "short"), (5, "u", "short")]
    rows += [(6, "http://a.example.com/", None), (7, "http://a.example.com/", ""), (8, "h", "é😀\r\n\r\nWARC/1.1\r\n" * 9000), (9, "h", "x" * 100), (9, "h", "x" * 100)]
    rows += [(None, "h", big)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_round_trip(spark, compression):
    path = scratch_path(spark, "warc")
    table = pages(spark)
    warc.write_warc(warc.to_records(table), path, compression=compression)
    got = Counter(tuple(r) for r in warc.archived_pages(spark, path).collect())
    rows = [r.asDict() for r in table.collect()]
    first = {}
    for r in rows:
        body = (r["html"] or "").encode()
        if r["page_id"] is not None and len(body) >= 100:
            first[body] = min(first.get(body, r["page_id"]), r["page_id"])
    want = Counter()
    for r in rows:
        body = (r["html"] or "").encode()
        again = body in first and r["page_id"] != first[body]
        want[(r["page_id"], len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[body] if again else None)] += 1
    assert got == want
    # predicates on headers are pushed; payloads need not be read
    plain = warc.read_warc(spark, path, payload="false")
    assert {r["payload"] for r in plain.collect()} == {None}
    some = warc.read_warc(spark, path).filter("record_type = 'revisit' AND target_uri LIKE 'http://a.%'")
    assert [r["record_id"] for r in some.collect()] == ["urn:page:3"]
    assert "PushedFilters" in some._jdf.queryExecution().toString() or some.count() == 1


def test_warc_reader_passes_over_unwanted_payloads():
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    reader = warc.WarcReader(warc.T.StructType(), {"path": "x"})
    kept = GreaterThan(("offset",), 3)
    assert list(reader.pushFilters([EqualTo(("record_type",), "response"), kept, StringStartsWith(("target_uri",), "http://a")])) == [kept]
    assert reader.wanted({"record_type": "response", "target_uri": "http://a/b"})
    assert not reader.wanted({"record_type": "revisit", "target_uri": "http://a/b"})
    assert not reader.wanted({"record_type": "response", "target_uri": None})


@pytest.mark.parametrize("zipped", [False, True])
def test_warc_long_http_headers(tmp_path, zipped):
    import gzip

    blocks = []
    # the blank line also falls across the ends of the steps in which headers are read
    for pad in (10, *range(8120, 8130), *range(16310, 16320), 300_000):
        blocks.append(b"HTTP/1.1 200 OK\r\nSet-Cookie: " + b"x" * pad + b"\r\nContent-Length: %d\r\n\r\n" % pad)
    records = b"".join(
        b"WARC/1.1\r\nWARC-Type: %s\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % (kind, len(block + body)) + block + body + b"\r\n\r\n"
        for block in blocks
        for kind, body in ((b"revisit", b""), (b"response", b"y" * 20_000))
    )
    name = tmp_path / ("a.warc.gz" if zipped else "a.warc")
    name.write_bytes(gzip.compress(records) if zipped else records)
    fields = warc.T.StructType([warc.T.StructField(c, warc.T.StringType()) for c in ("record_type", "http_length")])
    reader = warc.WarcReader(fields, {"path": str(tmp_path), "payload": "false"})
    got = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    pads = [int(b.rpartition(b": ")[2]) for b in blocks]
    assert [r["http_length"] for r in got] == [n for n in pads for _ in range(2)]
    assert [r["record_type"] for r in got] == ["revisit", "response"] * len(pads)


def test_warc_empty(spark):
    path = scratch_path(spark, "warc")
    warc.write_warc(warc.to_records(pages(spark).limit(0)), path)
    assert warc.archived_pages(spark, path).count() == 0


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_url_filter_as_of_fetch_time(spark):
    entries = [
        ("l", "host", "a.example.com", day(10), True),
        ("l", "host", "a.example.com", day(20), False),
        ("l", "host", "a.example.com", day(20), False),
        ("l", "host", "a.example.com", day(30), True),
        ("l", "domain", "example.com", day(15), True),
        ("l", "prefix", "b.example.org/en/", day(0), True),
        ("m", "url", "http://c.example.net/p?q=1", day(5), True),
        ("m", "host", None, day(5), True),
        ("m", "host", "x", None, True),
        ("m", "host", "gone", day(3), False),
    ]
    entries = spark.createDataFrame(entries, "list_id string, kind string, key string, at date, listed boolean")
    captures = [
        (1, "http://A.example.com/z", day(9)),
        (2, "http://a.example.com/z", day(10)),
        (3, "http://a.example.com:80/z", day(20)),
        (4, "http://a.example.com/z", day(30)),
        (5, "https://u@b.example.org/en/x/y", day(1)),
        (6, "http://b.example.org/english", day(1)),
        (7, "http://c.example.net/p?q=1#top", day(5)),
        (8, "not a url", day(5)),
        (9, None, day(5)),
        (10, "http://a.example.com/z", None),
        (2, "http://a.example.com/z", day(10)),
        (11, "http://notexample.com/", day(40)),
    ]
    captures = spark.createDataFrame(captures, "id long, url string, fetched date").withColumn("entry", F.lit(1)).withColumn("since", F.lit("x"))
    out = url_filter.filter_urls(captures, entries)
    got = Counter((r["id"], r["blocked"], r["n_active"], r["entry"] and r["entry"]["kind"]) for r in out.collect())
    want = {(1, False, 0, None): 1, (2, True, 1, "host"): 2, (3, True, 1, "domain"): 1, (4, True, 2, "host"): 1, (5, True, 1, "prefix"): 1}
    want |= {(6, False, 0, None): 1, (7, True, 1, "url"): 1, (8, False, 0, None): 1, (9, False, 0, None): 1, (10, False, 0, None): 1, (11, False, 0, None): 1}
    assert got == Counter(want)
    assert url_filter.filter_urls(captures, entries.limit(0)).filter("blocked").count() == 0
    assert url_filter.filter_urls(captures.limit(0), entries).count() == 0


def test_url_filter_of_very_long_urls(spark):
    """A path of a megabyte and a host of 10,000 labels."""
    deep = "http://deep.example.com/" + "a/" * 250_000 + "ü" * 250_000 + "/end"
    wide = "http://" + "x." * 10_000 + "example.org/p"
    entries = [("l", "prefix", "deep.example.com/" + "a/" * k, day(0), True) for k in (0, 3, 100)]
    entries += [("l", "prefix", "deep.example.com/a/b/", day(0), True), ("l", "prefix", "deep.example.com/a", day(0), True), ("l", "url", deep, day(0), True)]
    entries += [("l", "domain", "x." * k + "example.org", day(0), True) for k in (0, 2, 5_000, 10_000, 10_001)] + [("l", "domain", "mple.org", day(0), True)]
    entries = spark.createDataFrame(entries, "list_id string, kind string, key string, at date, listed boolean")
    captures = spark.createDataFrame([(1, deep, day(1)), (2, wide, day(1)), (2, wide, day(1)), (3, "http://a..example.org./x", day(1))], "id long, url string, fetched date")
    captures = captures.withColumn("blocked", F.lit(1)).withColumn("n_active", F.lit("x"))
    got = sorted((r["id"], r["blocked"], r["n_active"], r["entry"] and r["entry"]["kind"], r["entry"] and len(r["entry"]["key"])) for r in url_filter.filter_urls(captures, entries).collect())
    longest = 2 * 10_000 + len("example.org")
    assert got == [(1, True, 4, "url", len(deep)), (2, True, 4, "domain", longest), (2, True, 4, "domain", longest), (3, False, 0, None, None)]


def test_url_key_digests_are_those_of_the_keys():
    import xxhash

    digest = lambda s: xxhash.xxh64_intdigest(s.encode(), 42)
    got = set(url_filter.key_digests("http://a..bé.c/x//y/z?q", "a..bé.c", "/x//y/z"))
    keys = [(0, "http://a..bé.c/x//y/z?q"), (1, "a..bé.c/"), (1, "a..bé.c/x/"), (1, "a..bé.c/x//"), (1, "a..bé.c/x//y/"), (2, "a..bé.c")]
    keys += [(3, k[::-1]) for k in ("c", "bé.c", ".bé.c", "a..bé.c")]
    assert got == {(k, digest(s)) for k, s in keys}


def totals(rollup):
    return {(r["source"], r["lang"], r["tokenizer_version"]): (r["documents"], r["tokens"]) for r in rollup.totals().collect()}


def test_rollup_is_additive_and_idempotent(spark):
    rollup = TokenRollup(spark, scratch_path(spark, "rollup"))
    assert rollup.totals().count() == 0
    doc = "struct<source:string,lang:string,text:string>"
    docs = awkward_docs(spark).select(F.struct("source", "lang", "text").alias("new")).withColumn("old", F.lit(None).cast(doc))
    assert rollup.commit("load", signed_deltas(docs))
    rows = awkward_docs(spark).collect()
    want = Counter()
    for r in rows:
        want[(r["source"], r["lang"])] += n_words(r["text"])
    got = totals(rollup)
    assert {k[:2]: v[1] for k, v in got.items() if k[2] == "words-1"} == want
    before = got
    change = spark.createDataFrame([(("web", "en", "one two"), ("web", "de", "one")), (None, ("web", "en", "x y z")), (("s1", "de", None), None), (None, None)], f"old {doc}, new {doc}")
    assert rollup.commit("edit", signed_deltas(change))
    assert not rollup.commit("edit", signed_deltas(change))
    assert not TokenRollup(spark, rollup.path).commit("load", signed_deltas(docs))
    got = totals(rollup)
    k = ("web", "en", "words-1")
    assert got[k] == (before[k][0], before[k][1] + 1)
    assert got[("web", "de", "words-1")] == (1, 1)
    undo = change.select(F.col("new").alias("old"), F.col("old").alias("new"))
    assert rollup.commit("undo", signed_deltas(undo))
    assert totals(rollup) == before
    assert rollup.commit("nothing", signed_deltas(change.limit(0))) and totals(rollup) == before


def test_compaction_keeps_totals_and_idempotence(spark):
    doc = "struct<source:string,lang:string,text:string>"
    rollup = TokenRollup(spark, scratch_path(spark, "rollup"))
    assert not rollup.compact() and rollup.totals().count() == 0
    feed = [("a", "en", "one two"), ("b", None, "x"), (None, "de", None), ("a", "en", "three")]
    batch = lambda rows, sign: signed_deltas(spark.createDataFrame([(None, r) if sign > 0 else (r, None) for r in rows], f"old {doc}, new {doc}"))
    for k, row in enumerate(feed):
        assert rollup.commit(f"in-{k}", batch([row], 1))
        if k in (1, 3):
            before = totals(rollup)
            assert rollup.compact() and totals(rollup) == before and rollup.batches() == {}
            assert not rollup.compact()
    # sent again after compaction, by another driver as well: nothing changes
    again = TokenRollup(spark, rollup.path)
    assert not any(again.commit(f"in-{k}", batch([row], 1)) for k, row in enumerate(feed)) and totals(again) == before
    assert again.commit("out", batch(feed[:3], -1)) and totals(again) == {("a", "en", "words-1"): (1, 1), ("a", "en", "words-2"): (1, 1)}
    # a driver that died after publishing: markers of folded batches are still there
    snapshot = again._snapshot()
    again._fs.rename(again._path(again._marker("in-3", "_folded")), again._path(again._marker("in-3")))
    assert "in-3" in snapshot["folded"] and totals(again) == {("a", "en", "words-1"): (1, 1), ("a", "en", "words-2"): (1, 1)}
    assert again.compact() and totals(again) == {("a", "en", "words-1"): (1, 1), ("a", "en", "words-2"): (1, 1)}
    assert again.committed("in-3") and not again.commit("out", batch(feed[:3], -1))


def test_rollup_counts_ids_as_the_token_files_do(spark):
    from hindcast.llm import token_files
    from hindcast.llm.queries import token_rollup_bpe

    sf = "/root/testdata/sf0.001"
    got = {(r["source"], r["lang"]): (r["documents"], r["tokens"]) for r in token_rollup_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = scratch_path(spark, "t")
    token_files.write_token_files(docs, path)
    lengths = token_files.read_token_files(spark, path).join(docs.select("doc_id", "source", "lang"), "doc_id")
    want = lengths.groupBy(F.coalesce("source", F.lit("moved")).alias("source"), "lang").agg(F.count("*").alias("n"), F.sum(F.col("n_tokens") - 1).alias("t"))
    assert got == {(r["source"], r["lang"]): (r["n"], r["t"]) for r in want.collect()}


def test_bpe_counts(spark):
    from hindcast.llm.bpe import encoder, public_tokenizer

    docs = awkward_docs(spark).filter("doc_id < 20")
    got = docs.select("text", bpe_counter()(F.col("text")).alias("n")).collect()
    tok = encoder(public_tokenizer()).tok
    assert all(r["n"] == len(tok.encode(r["text"] or "", add_special_tokens=False).ids) for r in got)
    assert set(WORD_COUNTERS) == {"words-1", "words-2"} and TABLE.count(",") == 4


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline as cp
    from tests.llm.test_documents import brute_components, brute_fingerprint, check_packing, plain_ids

    base = awkward_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    sf = scratch_path(spark, "sf")
    base.write.parquet(f"{sf}/documents.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        path = scratch_path(spark, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append([r.asDict() for r in docs.collect()])
    told, single, mixed = seen
    assert Counter(str(r) for r in told) == Counter(str(r.asDict()) for r in base.collect() if any(c.isalpha() for c in r["text"] or ""))
    part = brute_components([r["doc_id"] for r in told], [brute_fingerprint(r["text"]) for r in told])
    assert sorted(r["doc_id"] for r in single) == sorted(set(part))
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in single}
    assert max(Counter(r["doc_id"] for r in mixed).values()) <= 2
    packed = cp.run(spark, sf).collect()
    check_packing(packed, [(r["doc_id"], plain_ids(r["text"])) for r in mixed])
    empty_docs(spark).write.parquet(f"{sf}/none/documents.parquet")
    assert cp.run(spark, f"{sf}/none").count() == 0


def test_pipeline_keeps_unlabelled_documents(spark):
    import corpus_pipeline as cp

    docs = awkward_docs(spark).select("doc_id", "text", F.lit(None).cast("string").alias("lang"), "source", "n_chars")
    got = cp.language_id(spark, docs, "")
    assert got.columns == docs.columns
    want = [r.asDict() for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")]
    assert want and Counter(str(r.asDict()) for r in got.collect()) == Counter(map(str, want))
