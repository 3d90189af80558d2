"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints of whole texts are compared within buckets that any two
fingerprints at the given distance must share: the 64 bits are cut into
``radius + 2`` bands, of which at least two agree, and every pair of bands is
a bucket key. Inside a bucket fingerprints are stored as bit planes: plane
``i`` of a block holds bit ``i`` of 64 fingerprints in one word. A fingerprint
is compared with a block 64 distances at a time: each plane's difference is
added to a carry-save counter of ``bit_length(radius + 1)`` words whose
overflow sticks, and a block is abandoned once all its distances exceed the
radius. A bucket yields a spanning forest of its links, not all pairs.
Buckets of more than ``tile`` fingerprints are cut into tiles whose pairs are
compared by different tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from hindcast.llm.common import columns_of, free_name, materialize
from hindcast.llm.components import components

SEED = 42
#: A-Z to a-z, every other byte as it is
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the text's word shingles (repeats count): a bit is
    set if it is set in over half of the shingles' XXH64. Fewer words than a
    shingle make one shingle; no words give 0."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= shingle:
        grams = [join(words)]
    else:
        grams = map(join, zip(*(words[k:] for k in range(shingle))))
    h = np.array([digest(g, SEED) for g in grams], dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(h), 65536):
        bits = np.unpackbits(h[lo : lo + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text_col: str, name: str, shingle: int = 3, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all) and the fingerprint as
    a signed long. A null text has fingerprint 0."""
    kept = docs.columns if keep is None else keep
    rows = docs.select(*kept, F.col(text_col).alias(name))
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(len(kept))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], names=batch.schema.names)

    return rows.mapInArrow(run, schema)


def band_masks(radius: int) -> list[int]:
    """Bit masks of the bucket keys: all pairs of ``radius + 2`` bands."""
    n = radius + 2
    edge = [64 * k // n for k in range(n + 1)]
    band = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:])]
    return [band[i] | band[j] for i in range(n) for j in range(i + 1, n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sliced_links(fps: np.ndarray, bucket: np.ndarray, side: np.ndarray, radius: int, chunk: int = 1 << 17) -> np.ndarray:
    """Pairs of positions whose fingerprints differ in at most ``radius``
    bits, as an array ``(n, 2)``. ``bucket`` ascends; only rows of one bucket
    are compared. In a bucket with both sides 0 and 1, side 0 meets side 1;
    otherwise all meet all."""
    n = len(fps)
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    size = np.diff(np.append(first, n))
    words = -(-size // 64)
    word_base = np.cumsum(words) - words
    place = np.arange(n) - np.repeat(first, size)
    word_of = np.repeat(word_base, size) + place // 64
    lane = (place % 64).astype(np.uint64)
    total = int(words.sum())
    # planes[i, w]: bit i of the fingerprints in word w, one lane each
    planes = np.zeros((64, total), dtype=np.uint64)
    starts = np.flatnonzero(place % 64 == 0)
    for i in range(64):
        planes[i] = np.bitwise_or.reduceat(((fps >> np.uint64(i)) & np.uint64(1)) << lane, starts)
    one = np.uint64(1)
    filled = np.bitwise_or.reduceat(one << lane, starts)
    right = np.bitwise_or.reduceat(side.astype(np.uint64) << lane, starts)
    two_sided = np.add.reduceat(side, first) > 0
    two_sided &= np.add.reduceat(1 - side, first) > 0
    two = np.repeat(two_sided, size)
    # each fingerprint meets its own word and those after it (two-sided: all words, left rows only)
    asks = np.flatnonzero(~two | (side == 0))
    begin = np.where(two[asks], np.repeat(word_base, size)[asks], word_of[asks])
    end = np.repeat(word_base + words, size)[asks]
    reach = end - begin
    found: list[np.ndarray] = []
    done = np.cumsum(reach)
    lo = 0
    width = radius.bit_length()
    while lo < len(asks):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + chunk, side="right")))
        count = reach[lo:hi]
        who = np.repeat(asks[lo:hi], count)
        word = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[lo:hi], count)
        valid = filled[word]
        own = word == word_of[who]
        # in its own word a row meets only later lanes, so each pair is seen once
        later = ~((one << lane[who]) | ((one << lane[who]) - one))
        valid = np.where(two[who], valid & right[word], np.where(own, valid & later, valid))
        counter = [np.zeros(len(who), dtype=np.uint64) for _ in range(width)]
        over = ~valid
        asked = fps[who]
        for i in range(64):
            carry = planes[i, word] ^ (np.uint64(0) - ((asked >> np.uint64(i)) & one))
            for c in counter:
                out = c & carry
                c ^= carry
                carry = out
            over |= carry  # what leaves the top word is above any distance it can hold
            if i % 8 == 7:
                if radius + 1 < 1 << width:
                    over |= _exceeds(counter, radius)
                alive = over != np.uint64(0xFFFFFFFFFFFFFFFF)
                if not alive.all():
                    who, word, over, asked = who[alive], word[alive], over[alive], asked[alive]
                    counter = [c[alive] for c in counter]
                    if not len(who):
                        break
        near = ~over
        hit = np.flatnonzero(near)
        if len(hit):
            bits = np.unpackbits(near[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, l = np.nonzero(bits)
            w = word[hit][r]
            found.append(np.stack((who[hit][r], starts[w] + l), axis=1))
        lo = hi
    return np.concatenate(found) if found else np.empty((0, 2), dtype=np.int64)


def _exceeds(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter (low word first) is above ``radius``."""
    above = np.zeros_like(counter[0])
    equal = np.full_like(above, 0xFFFFFFFFFFFFFFFF)
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            equal = equal & counter[k]
        else:
            above = above | (equal & counter[k])
            equal = equal & ~counter[k]
    return above


def fingerprint_links(fps: DataFrame, radius: int = 3, tile: int = 1 << 16, col: str = "fp") -> DataFrame:
    """Links ``(a, b)`` that connect the distinct fingerprints of ``fps[col]``
    as all pairs at distance ``radius`` or less would."""
    keys = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for k, m in enumerate(band_masks(radius))])
    rows = fps.select(F.col(col).alias("fp")).distinct().withColumn("key", F.explode(keys)).select("fp", "key.t", "key.k")
    rows = materialize(rows, "buckets")
    sizes = rows.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(sizes, ["t", "k"])
    tiles = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("tiles")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1),
        lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j"), (F.col("own") > j).cast("int").alias("side")),
    )
    rows = rows.withColumn("tiles", tiles).withColumn("own", own).withColumn("pair", F.explode(pairs))
    rows = rows.select("t", "k", "pair.i", "pair.j", "pair.side", "fp")
    rows = rows.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keyed, side, fp in _whole_buckets(batches):
            links = sliced_links(fp, keyed, side, radius)
            if len(links):
                a, b = _forest(links, len(fp))
                yield pa.RecordBatch.from_pydict({"a": fp[a].view(np.int64), "b": fp[b].view(np.int64)})

    return rows.mapInArrow(run, "a long, b long")


def _forest(links: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes with the smallest position linked to them, by repeated hooking
    and pointer jumping on arrays."""
    root = np.arange(n)
    a, b = links[:, 0], links[:, 1]
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        hi, lo = np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_]
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    node = np.flatnonzero(root != np.arange(n))
    return node, root[node]


def _whole_buckets(batches: Iterator[pa.RecordBatch], least: int = 60_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bucket numbers, sides and fingerprints of whole buckets, many at a time."""
    held: list[list[np.ndarray]] = []
    rows = 0

    def cols(batch):
        return [batch.column(k).to_numpy() for k in range(6)]

    def deliver(x):
        t, k, i, j, side, fp = x
        new = np.zeros(len(fp), dtype=bool)
        for c in (t, k, i, j):
            new[1:] |= c[1:] != c[:-1]
        return np.cumsum(new), side.astype(np.int64), fp.astype(np.int64).view(np.uint64)

    for batch in batches:
        if batch.num_rows:
            held.append(cols(batch))
            rows += batch.num_rows
        if rows < least:
            continue
        x = [np.concatenate(c) for c in zip(*held)]
        # the last bucket may go on in the next batch
        same = np.ones(rows, dtype=bool)
        for c in x[:4]:
            same &= c == c[-1]
        cut = rows - int(same[::-1].argmin()) if not same.all() else 0
        if cut:
            yield deliver([c[:cut] for c in x])
        held = [[c[cut:] for c in x]]
        rows -= cut
    if rows:
        yield deliver([np.concatenate(c) for c in zip(*held)])


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id reachable over links between
    fingerprints that differ in at most ``radius`` bits. Empty and null texts
    have fingerprint zero and link like any other; rows with a null id take
    part but never name a component unless all its ids are null (then it is
    null). Repeated rows stay. An empty table gives an empty result."""
    rows = materialize(with_fingerprint(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")), "t", "fp", shingle, ["doc_id"]), "fingerprints")
    node = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    part = components(fingerprint_links(node, radius))
    rooted = node.join(part, node["fp"] == part["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "roots")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row of every group of near duplicates: that with the smallest id;
    of several rows with that id, the one whose text comes first. A group
    whose ids are all null keeps one row as well. Columns are kept as they
    are."""
    h = F.xxhash64(F.col(text_col).cast("string"))
    names = docs.select(F.col(id_col).cast("long").alias("i"), h.alias("h"), F.col(text_col).alias("t"))
    rows = materialize(with_fingerprint(names, "t", "fp", shingle, ["i", "h"]), "fingerprints")
    node = rows.groupBy("fp").agg(F.min(F.struct(F.col("i").isNull().alias("none"), "i", "h")).alias("least"))
    part = components(fingerprint_links(node, radius))
    rooted = node.join(part, node["fp"] == part["node"], "left").select("least", F.coalesce("root", "fp").alias("root"))
    stays = rooted.groupBy("root").agg(F.min("least").alias("least")).select("least.i", "least.h").distinct()
    stays = materialize(stays, "stays")
    key, text_key, pick = (free_name(docs, n) for n in ("stay_id", "stay_hash", "pick"))
    stays = stays.withColumnsRenamed({"i": key, "h": text_key})
    same = F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (h == F.col(text_key))
    first = Window.partitionBy(key, text_key).orderBy(F.col(text_col), *[c.cast("string") for c in columns_of(docs.columns)])
    kept = docs.join(stays, same).withColumn(pick, F.row_number().over(first)).filter(F.col(pick) == 1)
    return kept.select(*columns_of(docs.columns))
