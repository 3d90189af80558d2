"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds documents in blocks. A document's signature is a Bloom filter
over its terms and, for terms that occur often, over (term, level) for the
levels ``tf >= 2, 4, 8, 16``. Documents whose signatures have one length are
stored as slices: row ``b`` of a group's matrix holds bit ``b`` of all its
documents. The documents that may hold a term are the AND of its slices, which
is never too small. The weights of an item's terms, added up over those
bitmaps level by level and multiplied by the most that a frequency of that
level can give in a document of its length, bound the score from above. A task
keeps the ``k`` best of every item among its blocks, rescoring exactly, from
the block's term counts, each document whose bound reaches the k-th score so
far; the tasks' finds are ranked once more.

Score of a document of ``n`` terms for an item, all in integers: the sum over
the item's terms, repeats included, of ``w * ((10^9 * tf) div (1000 * tf + 12 *
m))`` with ``m = 75 + (25 * n * N) div L`` and ``w = floor(1000 * ln((2N + 2) /
(2 df + 1)))``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hindcast.llm.common import LARGE_ROWS, arrow_rows, columns_of, materialize
from hindcast.llm.terms import Terms, chunks, mix64, split_terms, term_hashes

#: text of one block of the index, and hash functions per term
BLOCK_BYTES = 4 << 20
HASHES = 3
#: signature bits per (term, level) at a full signature
BITS_PER_TERM = 8
#: frequencies from which a term enters the levels of a signature
LEVELS = (1, 2, 4, 8, 16)
#: bits x documents of one group at most
GROUP_CELLS = 1 << 24
#: (item or term) x documents that a search has bounds or gains of at a time, at most
SEARCH_CELLS = 1 << 22
#: items that are searched for in one pass over the index
ITEM_ROWS, ITEM_BYTES = 4096, 8 << 20

_BLOCK = (
    "doc_id array<long>, n array<long>, terms array<binary>, df array<int>, ends binary, term binary, tf binary, "
    "groups array<struct<docs: binary, bits: int, slices: binary>>"
)


# -- the index ---------------------------------------------------------------


def term_counts(t: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(doc, term, tf)``, ascending."""
    size = max(1, len(t.dictionary))
    key = np.sort(t.doc * size + t.codes)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    tf = np.diff(np.append(first, len(key)))
    return key[first] // size, key[first] % size, tf


def bit_places(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Bits (terms x hash functions) of the terms in signatures of ``bits``,
    a power of two."""
    h = mix64(hashes + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
    step = (h >> np.uint64(32)) | np.uint64(1)
    places = h[:, None] + np.arange(HASHES, dtype=np.uint64)[None, :] * step[:, None]
    return (places & np.uint64(bits - 1)).astype(np.int64)


def _groups(doc: np.ndarray, term: np.ndarray, tf: np.ndarray, hashes: np.ndarray, n_docs: int) -> list[dict]:
    entries = np.zeros(n_docs, dtype=np.int64)
    for least in LEVELS:
        entries += np.bincount(doc[tf >= least], minlength=n_docs)
    held = np.flatnonzero(entries)
    # signatures of all documents of a class have 8 bits per entry at least
    grade = np.ceil(np.log2(np.maximum(entries, 8))).astype(np.int64)
    out = []
    for c in np.unique(grade[held]):
        bits = BITS_PER_TERM << int(c)
        of_class = held[grade[held] == c]
        width = max(8, GROUP_CELLS // bits)
        for lo in range(0, len(of_class), width):
            docs = of_class[lo : lo + width]
            lane = np.full(n_docs, -1)
            lane[docs] = np.arange(len(docs))
            matrix = np.zeros((bits, len(docs)), dtype=bool)
            mine = lane[doc] >= 0
            for level, least in enumerate(LEVELS):
                pick = np.flatnonzero(mine & (tf >= least))
                matrix[bit_places(hashes[term[pick]], level, bits).ravel(), np.repeat(lane[doc[pick]], HASHES)] = True
            out.append({"docs": docs.astype("<i4").tobytes(), "bits": bits, "slices": np.packbits(matrix, axis=1).tobytes()})
    return out


def index_block(ids: pa.Array, texts: pa.Array) -> dict:
    t = split_terms(texts)
    doc, term, tf = term_counts(t)
    n = np.bincount(t.doc, minlength=t.n_docs)
    return {
        "doc_id": ids.to_pylist(),
        "n": n.tolist(),
        "terms": t.dictionary.to_pylist(),
        "df": np.bincount(term, minlength=len(t.dictionary)).tolist(),
        "ends": np.cumsum(np.bincount(doc, minlength=t.n_docs)).astype("<i8").tobytes(),
        "term": term.astype("<i4").tobytes(),
        "tf": tf.astype("<i4").tobytes(),
        "groups": _groups(doc, term, tf, term_hashes(t.dictionary), t.n_docs),
    }


@dataclass
class LexicalIndex:
    """``blocks``: one row per block of documents, written in the shared
    folder. ``documents`` counts those with a term, ``length`` their terms."""

    blocks: DataFrame
    documents: int
    length: int


_ARROW = pa.schema(
    [
        ("doc_id", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("df", pa.list_(pa.int32())),
        ("ends", pa.binary()), ("term", pa.binary()), ("tf", pa.binary()),
        ("groups", pa.list_(pa.struct([("docs", pa.binary()), ("bits", pa.int32()), ("slices", pa.binary())]))),
    ]
)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> LexicalIndex:
    """Index every row of ``docs`` by its whole text; texts are not shuffled.
    Null texts hold no term; rows with equal or null ids are documents of
    their own. Other columns are ignored."""
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def block():
            x = pa.Table.from_batches(held).combine_chunks()
            made = index_block(x.column(0).combine_chunks(), x.column(1).cast(pa.large_string()).combine_chunks())
            return pa.RecordBatch.from_pylist([made], schema=_ARROW)

        for batch in batches:
            for part in chunks(batch, 1, block_bytes):
                held.append(part)
                size += part.column(1).nbytes
                if size >= block_bytes:
                    yield block()
                    held, size = [], 0
        if held and any(b.num_rows for b in held):
            yield block()

    blocks = materialize(rows.mapInArrow(run, _BLOCK), "signatures", **LARGE_ROWS)
    sums = blocks.select(F.explode("n").alias("n")).agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    return LexicalIndex(blocks, sums[0], sums[1] or 0)


# -- a search ----------------------------------------------------------------


@dataclass
class Asked:
    """A block of items. Pair ``p`` says that item ``item[p]`` holds the term
    ``vocabulary[term[p]]`` ``times[p]`` times; pairs ascend by item."""

    vocabulary: pa.Array
    hashes: np.ndarray
    item: np.ndarray
    term: np.ndarray
    times: np.ndarray
    n_items: int
    weight: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    documents: int = 0
    length: int = 0

    @classmethod
    def of(cls, texts: list[str | None]) -> Asked:
        t = split_terms(pa.array(texts, pa.large_string()))
        item, term, times = term_counts(t)
        return cls(t.dictionary.cast(pa.binary()), term_hashes(t.dictionary), item, term, times, len(texts))


def term_weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _length_norm(n: np.ndarray, asked: Asked) -> np.ndarray:
    if 25 * asked.documents * int(n.max(initial=0)) < 2**63:
        return 75 + (25 * n * asked.documents) // asked.length
    return np.array([75 + 25 * int(v) * asked.documents // asked.length for v in n], dtype=np.int64)


class Best:
    """The ``k`` best documents of every item: higher scores first, then
    smaller ids, null ids last."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.score = [np.empty(0, np.int64)] * n_items
        self.id = [np.empty(0, np.int64)] * n_items
        self.empty = [np.empty(0, bool)] * n_items
        self.floor = np.ones(n_items, dtype=np.int64)

    def add(self, item: int, score: np.ndarray, ids: np.ndarray, empty: np.ndarray) -> None:
        hit = score > 0
        score, ids, empty = (np.concatenate((old, new[hit])) for old, new in ((self.score[item], score), (self.id[item], ids), (self.empty[item], empty)))
        order = np.lexsort((ids, empty, -score))[: self.k]
        self.score[item], self.id[item], self.empty[item] = score[order], ids[order], empty[order]
        if len(order) == self.k:
            self.floor[item] = score[order[-1]]


def bounds(group: dict, asked: Asked, known: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Items x documents of a group: what the scores cannot exceed. ``known``
    are the vocabulary's terms that the block holds at all."""
    n = len(m)
    slices = np.frombuffer(group["slices"], dtype=np.uint8).reshape(group["bits"], -1)
    out = np.zeros((asked.n_items, n), dtype=np.int64)
    before = np.zeros(n, dtype=np.int64)
    maybe: np.ndarray | None = None
    where = np.full(len(asked.vocabulary), -1)
    for level, least in enumerate(LEVELS):
        places = bit_places(asked.hashes[known], level, group["bits"])
        rows = slices[places[:, 0]]
        for h in range(1, HASHES):
            rows = rows & slices[places[:, h]]
        if maybe is not None:
            rows &= maybe  # a term of this level is one of the level below
        some = rows.any(axis=1)
        known, maybe = known[some], rows[some]
        if not len(known):
            break
        most = _part(np.full(n, LEVELS[level + 1] - 1), m) if level + 1 < len(LEVELS) else np.full(n, 1_000_000)
        where[:] = -1
        where[known] = np.arange(len(known))
        pairs = np.flatnonzero(where[asked.term] >= 0)
        if not len(pairs):
            break
        present = np.unpackbits(maybe, axis=1, count=n)
        weight = asked.weight[asked.term[pairs]] * asked.times[pairs]
        step = max(1, (1 << 21) // n)
        for lo in range(0, len(pairs), step):
            part = pairs[lo : lo + step]
            first = np.flatnonzero(np.append(True, asked.item[part][1:] != asked.item[part][:-1]))
            sums = np.add.reduceat(present[where[asked.term[part]]] * weight[lo : lo + step, None], first, axis=0)
            out[asked.item[part[first]]] += sums * (most - before)
        before = most
    return out


def _pieces(groups: list[dict], most: int) -> Iterator[dict]:
    """The groups in pieces of at most ``most`` documents, 8 at least: the
    slices are cut between bytes."""
    width = max(1, most // 8) * 8
    for g in groups:
        docs = np.frombuffer(g["docs"], "<i4")
        slices = np.frombuffer(g["slices"], dtype=np.uint8).reshape(g["bits"], -1)
        for lo in range(0, len(docs), width):
            yield {"docs": docs[lo : lo + width], "bits": g["bits"], "slices": np.ascontiguousarray(slices[:, lo // 8 : (lo + width) // 8])}


def search_block(block: dict, asked: Asked, best: Best) -> tuple[int, int]:
    """Brings ``best`` up to date with a block. Returns how many (item,
    document) pairs there were and how many were rescored."""
    known = np.flatnonzero(pc.is_in(asked.vocabulary, pa.array(block["terms"], pa.binary())).to_numpy(zero_copy_only=False))
    n = np.array(block["n"], dtype=np.int64)
    if not len(known):
        return asked.n_items * len(n), 0
    empty = np.array([i is None for i in block["doc_id"]])
    ids = np.array([i or 0 for i in block["doc_id"]], dtype=np.int64)
    m = _length_norm(n, asked)
    of_vocabulary = pc.index_in(pa.array(block["terms"], pa.binary()), asked.vocabulary).fill_null(-1).to_numpy()
    term, tf = np.frombuffer(block["term"], "<i4"), np.frombuffer(block["tf"], "<i4").astype(np.int64)
    doc = np.repeat(np.arange(len(n)), np.diff(np.frombuffer(block["ends"], "<i8"), prepend=0))
    mine = np.flatnonzero(of_vocabulary[term] >= 0)
    doc, tf, term = doc[mine], tf[mine], of_vocabulary[term[mine]]
    gain = _part(tf, m[doc]) * asked.weight[term]
    edge = np.searchsorted(asked.item, np.arange(asked.n_items + 1))
    row = np.full(len(asked.vocabulary), -1)
    row[known] = np.arange(len(known))
    rescored = 0
    for group in _pieces(block["groups"], max(1, SEARCH_CELLS // max(asked.n_items, len(known)))):
        docs = np.frombuffer(group["docs"], "<i4")
        lane = np.full(len(n), -1)
        lane[docs] = np.arange(len(docs))
        inside = np.flatnonzero(lane[doc] >= 0)
        if not len(inside):
            continue
        limit = bounds(group, asked, known, m[docs])
        exact = np.zeros((len(known), len(docs)), dtype=np.int64)
        exact[row[term[inside]], lane[doc[inside]]] = gain[inside]
        for item in np.flatnonzero((limit >= best.floor[:, None]).any(axis=1)).tolist():
            pairs = np.arange(edge[item], edge[item + 1])
            pairs = pairs[row[asked.term[pairs]] >= 0]
            rows, times = row[asked.term[pairs]], asked.times[pairs]
            left = np.flatnonzero(limit[item] >= best.floor[item])
            left = left[np.argsort(-limit[item, left], kind="stable")]
            while len(left):
                now, left = left[: best.k], left[best.k :]
                score = times @ exact[np.ix_(rows, now)]
                best.add(item, score, ids[docs[now]], empty[docs[now]])
                rescored += len(now)
                left = left[limit[item, left] >= best.floor[item]]
    return asked.n_items * len(n), rescored


def search(index: LexicalIndex, items: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of each item's
    ``k`` documents of highest score above 0 (all, if fewer); equal scores go
    by ascending ``doc_id``, null ids last.

    Every row of ``items`` is an item of its own, so repeated rows give their
    ranks again; null or empty texts give none. ``item_id`` keeps its type.
    Items are taken in blocks of bounded size, each one pass over the index;
    an empty index or no items give an empty result."""
    spark = items.sparkSession
    found: list[DataFrame] = []
    for block in _item_blocks(items.select(*(c.alias(n) for c, n in zip(columns_of([id_col, text_col]), ("item_id", "t"))))):
        found.append(_search_items(index, block, items.select(F.col(id_col).alias("item_id")).schema["item_id"].dataType, k))
    if not found:
        kind = items.select(F.col(id_col).alias("item_id")).schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _item_blocks(items: DataFrame) -> Iterator[list]:
    held, size = [], 0
    for r in items.toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1] or "")
        if len(held) >= ITEM_ROWS or size >= ITEM_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _search_items(index: LexicalIndex, block: list, id_type, k: int) -> DataFrame:
    spark = index.blocks.sparkSession
    asked = Asked.of([t for _, t in block])
    asked.documents, asked.length = index.documents, max(1, index.length)
    vocabulary = asked.vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                at = pc.index_in(batch.column(0)[r].values, vocabulary)
                there = at.is_valid().to_numpy(zero_copy_only=False)
                total[at.drop_null().to_numpy()] += batch.column(1)[r].values.to_numpy()[there]
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(hit), "df": pa.array(total[hit])})

    df = np.zeros(len(vocabulary), dtype=np.int64)
    # one row per term of the items
    with arrow_rows(spark, 1):  # a row is a block
        for r in index.blocks.select("terms", "df").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[r["term"]] = r["df"]
    asked.weight = np.array([term_weight(index.documents, int(d)) for d in df], dtype=np.int64)
    held = spark.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(held.value.n_items, k)
        for batch in batches:
            for r in range(batch.num_rows):
                search_block(batch.slice(r, 1).to_pylist()[0], held.value, best)
        sizes = [len(s) for s in best.score]
        if sum(sizes):
            yield pa.RecordBatch.from_pydict(
                {
                    "item": pa.array(np.repeat(np.arange(len(sizes)), sizes)),
                    "doc_id": pa.array(np.concatenate(best.id), mask=np.concatenate(best.empty)),
                    "score": pa.array(np.concatenate(best.score)),
                }
            )

    finds = index.blocks.mapInArrow(run, "item long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    ranked = finds.withColumn("rank", place).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], f"place long, item_id {id_type.simpleString()}")
    out = ranked.join(names, F.col("item") == F.col("place")).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
    return materialize(out, "ranked", rows=1)
