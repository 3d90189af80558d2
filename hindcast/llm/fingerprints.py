"""Document fingerprints: SimHash over weighted terms, and the fingerprints
within a Hamming radius by permuted block tables.

A text's terms are its pairs of adjacent words (a lone word stands for
itself). A term that occurs ``tf`` times votes with weight ``floor(4 + 4 *
log2(tf))`` on every bit, for 1 where its hash has a 1 and against it
elsewhere; a bit of the fingerprint is 1 if more than half of the weight is for
it. Votes are integers, so equal texts have equal fingerprints wherever they
are computed. With ``h`` differing bits out of ``b``, ``cos(pi * h / b)``
estimates the cosine of the two term vectors; the likeness is that, or 0 where
it is negative.

Fingerprints at ``radius`` bits or less agree on one at least of ``radius + 1``
blocks of bits. Table ``t`` permutes block ``t`` to the front and keys each
distinct fingerprint by it, so that all within the radius share a key in some
table. A pair counts in the first table where it agrees only. Keys with many
fingerprints are cut into tiles whose pairs go to different tasks, and tasks
hand on counts per fingerprint, not pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import materialize
from hindcast.llm.terms import chunks, mix64, split_terms, term_hashes

BITS = 128
RADIUS = 3
#: bytes of text (compressed: half of it) that are worked on at once
CHUNK_BYTES = 1 << 20

#: byte -> its low and its high four bits, each in a lane of 16 bits
_LANES = [np.array([sum((v >> (i + s) & 1) << (16 * i) for i in range(4)) for v in range(256)], dtype=np.uint64) for s in (0, 4)]
#: terms whose weights are added in one lane; a weight is at most 4 + 4 * 31
_LANE_TERMS = 500


def fingerprint_texts(texts: pa.Array, bits: int = BITS) -> np.ndarray:
    """Fingerprints (rows x ``bits / 64`` words) of a string column. A text
    that is null or has no words has fingerprint zero."""
    if bits % 64 or bits < 64:
        raise ValueError("bits must be a multiple of 64")
    terms = split_terms(texts)
    out = np.zeros((terms.n_docs, bits // 64), dtype=np.uint64)
    code, doc = terms.codes.astype(np.int64), terms.doc
    if not len(code):
        return out
    size = len(terms.dictionary)
    # pairs as numbers that ascend by text: (text, word, next word)
    pair = (doc * size + code) * size
    pair[:-1] += code[1:]
    goes_on = np.append(doc[1:] == doc[:-1], False)
    lone = ~goes_on & np.append(True, ~goes_on[:-1])
    pair[lone] = (doc * size + code)[lone] * size + code[lone]
    pair = np.sort(pair[goes_on | lone])
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    tf = np.diff(np.append(first, len(pair)))
    pair = pair[first]
    weight = (4 + np.floor(4 * np.log2(tf))).astype(np.uint64)
    of_word = term_hashes(terms.dictionary)
    second = of_word[pair % size]
    pair //= size
    term = mix64(of_word[pair % size] * np.uint64(31) + second)
    doc = pair // size
    begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    place = np.arange(len(doc)) - np.repeat(begin, np.diff(np.append(begin, len(doc))))
    runs = np.flatnonzero(place % _LANE_TERMS == 0)
    run_doc = doc[runs]
    run_begin = np.flatnonzero(np.append(True, run_doc[1:] != run_doc[:-1]))
    whole = np.add.reduceat(weight.astype(np.int64), begin)
    for word in range(out.shape[1]):
        octets = mix64(term + np.uint64(word)).view(np.uint8).reshape(-1, 8)
        lanes = np.empty((len(runs), 16), dtype=np.uint64)
        for j in range(8):
            for half in (0, 1):
                lanes[:, 2 * j + half] = np.add.reduceat(_LANES[half][octets[:, j]] * weight, runs)
        ones = np.add.reduceat(lanes.view(np.uint16).reshape(len(runs), 64).astype(np.int64), run_begin, axis=0)
        out[doc[begin], word] = np.packbits(2 * ones > whole[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def differing_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1; 1 where the fingerprints are equal."""
    return np.maximum(np.cos(np.pi * differing_bits(a, b) / (64 * a.shape[-1])), 0.0)


def hex_of(words: list[str]) -> Column:
    """Fingerprint columns as one string, 16 lower-case digits a word."""
    return F.concat(*[F.lower(F.lpad(F.hex(F.col(w)), 16, "0")) for w in words])


def word_names(prefix: str, bits: int) -> list[str]:
    return [f"{prefix}{k}" for k in range(bits // 64)]


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """``doc_id`` and the fingerprint's words ``fp0``, ``fp1``, ... as signed
    longs, one row per row of ``docs``. Texts are not shuffled."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1, CHUNK_BYTES):
                fps = fingerprint_texts(part.column(1), bits)
                cols = {n: pa.array(fps[:, k].view(np.int64)) for k, n in enumerate(word_names("fp", bits))}
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0)} | cols)

    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in word_names("fp", bits)))


# -- each document with the next one in descending order of ids --------------

_ENDS = ", part int, at_end string, held binary"


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, so that half as much is shuffled."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [press.compress((t.as_buffer() if t.is_valid else b"") or b"") for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(packed, pa.binary())], names=["i", "h", "z"])


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _judged(ids: list, texts: list[str], following: list[str], fps: np.ndarray, next_fps: np.ndarray, bits: int) -> dict:
    edited = [_edited(a, b) for a, b in zip(texts, following)]
    edited_fps = fingerprint_texts(pa.array(edited, pa.large_string()), bits)
    out = {
        "doc_id": pa.array(ids, pa.int64()),
        "n_chars": pa.array(list(map(len, texts)), pa.int64()),
        "edited_sha256": [hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited],
        "near_edited": likeness(fps, edited_fps),
        "near_next": likeness(fps, next_fps),
    }
    for prefix, words in (("fp", fps), ("edited", edited_fps)):
        out |= {n: pa.array(np.ascontiguousarray(words[:, k]).view(np.int64)) for k, n in enumerate(word_names(prefix, bits))}
    return out


def _expand(packed: pa.Array) -> list[str]:
    grow = zstandard.ZstdDecompressor()
    return [grow.decompress(z).decode("utf-8") for z in packed.to_pylist()]


def _end(part: int, which: str, doc_id, text: str, names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    row = dict.fromkeys(names) | {"doc_id": doc_id, "part": part, "at_end": which, "held": zstandard.compress(text.encode("utf-8"), 1)}
    return pa.RecordBatch.from_pylist([row], schema=schema)


def _walk(batches: Iterator[pa.RecordBatch], bits: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A partition in order: every row but the last is judged against the row
    after it; the first and the last row are handed on with their texts."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = schema.names
    ids: list = []
    texts: list[str] = []
    fps = np.empty((0, bits // 64), dtype=np.uint64)
    for batch in batches:
        for piece in chunks(batch, 1, CHUNK_BYTES // 2):
            new = _expand(piece.column(1))
            if not texts and new:
                yield _end(part, "head", piece.column(0)[0].as_py(), new[0], names, schema)
            texts += new
            ids += piece.column(0).to_pylist()
            fps = np.concatenate((fps, fingerprint_texts(pa.array(new, pa.large_string()), bits)))
            if len(texts) > 1:
                done = _judged(ids[:-1], texts[:-1], texts[1:], fps[:-1], fps[1:], bits)
                n = len(ids) - 1
                done |= {"part": pa.nulls(n, pa.int32()), "at_end": pa.nulls(n, pa.string()), "held": pa.nulls(n, pa.binary())}
                yield pa.RecordBatch.from_pydict({k: done[k] for k in names}, schema=schema)
            ids, texts, fps = ids[-1:], texts[-1:], fps[-1:]
    if texts:
        yield _end(part, "tail", ids[0], texts[0], names, schema)


def _meet(batches: Iterator[pa.RecordBatch], bits: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Last rows of partitions with the first rows of the partitions after them."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            mine, following = _expand(row.column(1)), _expand(row.column(2))
            both = fingerprint_texts(pa.array(mine + following, pa.large_string()), bits)
            done = _judged(row.column(0).to_pylist(), mine, following, both[:1], both[1:], bits)
            yield pa.RecordBatch.from_pydict({k: done[k] for k in names})


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """Every document beside its edited text, whose last ``floor(n / 2)`` of
    ``n`` code points are replaced by the first as many of the next document
    in descending order of ids; the last is followed by the first. Columns:
    ``doc_id``, ``n_chars``, ``edited_sha256``, the words of the fingerprints
    ``fp0``.. and ``edited0``.., ``near_edited`` and ``near_next``.

    Null texts are empty; null ids come last; of rows with one id the order
    follows a hash of the text, then the text, so reruns agree and repeated
    rows stay. A lone row is its own next. Other columns are ignored. An empty
    table gives an empty result. Texts are shuffled once, compressed."""
    words = ", ".join(f"{n} long" for p in ("fp", "edited") for n in word_names(p, bits))
    result = f"doc_id long, n_chars long, edited_sha256 string, near_edited double, near_next double, {words}"
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).cast("binary").alias("t"))
    packed = rows.mapInArrow(_squeeze, "i long, h long, z binary")
    down = F.col("i").desc_nulls_last()
    dealt = packed.repartitionByRange(down, "h").sortWithinPartitions(down, "h", "z").select("i", "z")
    fields = [pa.field(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t]) for n, t in (c.split() for c in result.split(", "))]
    schema = pa.schema([*fields, pa.field("part", pa.int32()), pa.field("at_end", pa.string()), pa.field("held", pa.binary())])
    # one row per partition and end carries a text; the others carry none
    walked = materialize(dealt.mapInArrow(partial(_walk, bits=bits, schema=schema), result + _ENDS), "walked")
    tails = walked.filter("at_end = 'tail'").select("part", F.col("doc_id").alias("id"), F.col("held").alias("mine"))
    heads = walked.filter("at_end = 'head'").select(F.col("part").alias("of"), F.col("held").alias("following"))
    # numbers of the partitions that have rows
    parts = sorted(r["part"] for r in tails.select("part").collect())
    turns = walked.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "p int, following_part int")
    met = tails.join(turns, F.col("part") == F.col("p")).join(heads, F.col("following_part") == F.col("of"))
    names = [f.name for f in fields]
    closed = met.select("id", "mine", "following").mapInArrow(partial(_meet, bits=bits, names=names), result)
    return walked.filter("at_end IS NULL").select(*names).unionByName(closed.select(*names))


# -- permuted block tables ----------------------------------------------------


def block_edges(bits: int, radius: int) -> list[int]:
    return [bits * k // (radius + 1) for k in range(radius + 2)]


def _slice_of(words: list[str], lo: int, hi: int) -> Column:
    """Bits ``lo`` to ``hi`` (exclusive) of a fingerprint: the block that a
    table permutes to the front, as an array of one long per word it touches."""
    cut = []
    for k, w in enumerate(words):
        a, b = max(lo, 64 * k), min(hi, 64 * k + 64)
        if a < b:
            mask = ((1 << (b - a)) - 1) << (a - 64 * k)
            cut.append(F.col(w).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
    return F.xxhash64(*cut) if len(cut) > 1 else cut[0]


def near_counts(fps: DataFrame, words: list[str], radius: int = RADIUS, tile: int = 1 << 13, id_col: str = "doc_id") -> DataFrame:
    """Per distinct fingerprint of ``fps[words]``: the words, ``n_near``, how
    many rows have a fingerprint within ``radius`` bits (their own included),
    and ``near_id``, the smallest id among those rows (null if all are)."""
    bits = 64 * len(words)
    if not 0 <= radius < bits:
        raise ValueError("radius must be from 0 to the number of bits less one")
    node = materialize(fps.groupBy(*words).agg(F.count("*").alias("own"), F.min(id_col).alias("least")), "fingerprints")
    edges = block_edges(bits, radius)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), _slice_of(words, a, b).alias("k")) for t, (a, b) in enumerate(zip(edges, edges[1:]))])
    rows = node.withColumn("key", F.explode(tables)).select("key.t", "key.k", *words, "own", "least")
    shared = rows.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(shared, ["t", "k"])
    mine = F.pmod(F.xxhash64(*words), F.col("tiles")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1),
        lambda j: F.struct(F.least("mine", j).alias("i"), F.greatest("mine", j).alias("j"), (F.col("mine") > j).cast("int").alias("side")),
    )
    rows = rows.withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")).withColumn("mine", mine).withColumn("pair", F.explode(others))
    rows = rows.select("t", "k", "pair.i", "pair.j", "pair.side", "own", "least", *words)
    rows = rows.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")
    found = rows.mapInArrow(partial(_count_near, radius=radius, edges=edges), "n long, least long, " + ", ".join(f"{w} long" for w in words))
    own = node.select(F.col("own").alias("n"), "least", *words)
    return own.unionByName(found).groupBy(*words).agg(F.sum("n").alias("n_near"), F.min("least").alias("near_id"))


def _first_agreeing(differ: np.ndarray, edges: list[int]) -> np.ndarray:
    """The first block in which pairs agree, from their differing bits."""
    out = np.full(len(differ), len(edges), dtype=np.int64)
    for t in reversed(range(len(edges) - 1)):
        same = np.ones(len(differ), dtype=bool)
        for k in range(differ.shape[1]):
            a, b = max(edges[t], 64 * k), min(edges[t + 1], 64 * k + 64)
            if a < b:
                same &= (differ[:, k] & np.uint64(((1 << (b - a)) - 1) << (a - 64 * k))) == 0
        out[same] = t
    return out


def _count_near(batches: Iterator[pa.RecordBatch], radius: int, edges: list[int]) -> Iterator[pa.RecordBatch]:
    none = np.iinfo(np.int64).max
    for t, i, j, group, side, own, least, empty, fp, names in _whole_groups(batches):
        n, low = np.zeros(len(fp), dtype=np.int64), np.full(len(fp), none)
        ids = np.where(empty, none, least)
        size = np.bincount(group)
        last = np.cumsum(size)[group]
        # row a meets the row `step` places later while that is in its group
        at = np.arange(len(fp))
        step = 1
        while len(at := at[at + step < last[at]]):
            # tiles of different numbers: pairs on one side are met elsewhere
            a = at[(i[at] == j[at]) | (side[at] != side[at + step])]
            b = a + step
            differ = fp[a] ^ fp[b]
            near = np.bitwise_count(differ).sum(axis=1) <= radius
            a, b, differ = a[near], b[near], differ[near]
            if len(a):
                counts = _first_agreeing(differ, edges) == t[a]
                a, b = a[counts], b[counts]
                np.add.at(n, a, own[b])
                np.add.at(n, b, own[a])
                np.minimum.at(low, a, ids[b])
                np.minimum.at(low, b, ids[a])
            step += 1
        hit = np.flatnonzero(n)
        if len(hit):
            cols = {"n": pa.array(n[hit]), "least": pa.array(low[hit], mask=low[hit] == none)}
            cols |= {w: pa.array(np.ascontiguousarray(fp[hit, k]).view(np.int64)) for k, w in enumerate(names)}
            yield pa.RecordBatch.from_pydict(cols)


def _whole_groups(batches: Iterator[pa.RecordBatch], least_rows: int = 50_000):
    """Whole groups of (table, key, tile pair), many at a time."""
    held: pa.Table | None = None

    def deliver(x: pa.Table):
        x = x.combine_chunks()
        key = [x.column(c).to_numpy() for c in range(4)]
        new = np.zeros(len(x), dtype=bool)
        for c in key:
            new[1:] |= c[1:] != c[:-1]
        names = x.schema.names[7:]
        fp = np.stack([x.column(w).to_numpy() for w in names], axis=1).view(np.uint64)
        empty = x.column(6).is_null().to_numpy()
        return key[0], key[2], key[3], np.cumsum(new), x.column(4).to_numpy(), x.column(5).to_numpy(), x.column(6).fill_null(0).to_numpy(), empty, fp, names

    for batch in batches:
        if not batch.num_rows:
            continue
        more = pa.Table.from_batches([batch])
        held = more if held is None else pa.concat_tables([held, more])
        if len(held) < least_rows:
            continue
        same = np.ones(len(held), dtype=bool)
        for c in range(4):
            x = held.column(c).to_numpy()
            same &= x == x[-1]
        cut = 0 if same.all() else len(held) - int(same[::-1].argmin())
        if cut:
            yield deliver(held.slice(0, cut))
            held = held.slice(cut).combine_chunks()
    if held is not None and len(held):
        yield deliver(held)
