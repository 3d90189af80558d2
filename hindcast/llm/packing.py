"""Best-fit packing by a grouping genetic algorithm on islands.

Documents are cut into pieces of at most ``capacity`` ids and the pieces that
do not fill a sequence alone are dealt at random into blocks of bounded size.
Every block is packed by several islands. An island keeps a few packings; a
child takes whole well-filled bins of one parent, gives up the other parent's
bins that hold the same pieces, and places the displaced pieces best-fit, the
longest first. After each epoch the best packing of an island moves to the
next one in a ring. A block stops as soon as its packing has as many bins as
its total length needs at least. Between epochs the islands are a table in the
shared folder, so a lost executor costs one island's epoch at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.bpe import encode_with_end, public_tokenizer
from hindcast.llm.common import discard, materialize


@dataclass(frozen=True)
class PackParams:
    capacity: int = 1024
    block_pieces: int = 8192  # pieces that are packed together
    islands: int = 3
    population: int = 4
    epochs: int = 3
    generations: int = 6  # children an island makes in an epoch
    seed: int = 17


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def document_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, tokenizer: str | None = None, end_id: int = 2
) -> DataFrame:
    """Pieces of every document: its ids and ``end_id``, cut only when longer
    than ``capacity``; then all pieces but the first are full. A null text is
    an empty one (the end id alone). Every row is a document: rows with equal or
    null ids each give their pieces. Other columns are ignored; an empty table
    gives no pieces."""
    vocabulary = tokenizer or public_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), encode_with_end(batch.column(1), vocabulary, end_id)):
                a, n = 0, len(ids)
                b = (n - 1) % capacity + 1
                ids = ids.astype("<u4")
                for k in range((n + capacity - 1) // capacity):
                    rows.append((name, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                    a, b = b, b + capacity
                if len(rows) >= 10_000:
                    yield _piece_batch(rows)
                    rows = []
        if rows:
            yield _piece_batch(rows)

    return docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(cut, PIECE)


def _piece_batch(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
    )


class _Bins:
    """Best fit over open bins: stacks of bins by free space, and one integer
    whose bit ``r`` says that a bin with ``r`` free places exists."""

    def __init__(self, capacity: int, free: np.ndarray):
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0
        self.count = len(free)
        self.capacity = capacity
        for b, r in enumerate(free.tolist()):
            self.stacks[r].append(b)
        for r in np.unique(free).tolist():
            self.bits |= 1 << r

    def place(self, sizes: list[int]) -> list[int]:
        stacks, bits, count, out = self.stacks, self.bits, self.count, []
        for size in sizes:
            above = bits >> size
            if above:
                r = size + (above & -above).bit_length() - 1
                stack = stacks[r]
                b = stack.pop()
                if not stack:
                    bits ^= 1 << r
            else:
                r, b = self.capacity, count
                count += 1
            left = r - size
            if left:
                if not stacks[left]:
                    bits |= 1 << left
                stacks[left].append(b)
            out.append(b)
        self.bits, self.count = bits, count
        return out


def best_fit(sizes: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of every piece, placed best-fit in the given order."""
    bins = np.empty(len(sizes), dtype=np.int32)
    bins[order] = _Bins(capacity, np.empty(0, np.int64)).place(sizes[order].tolist())
    return bins


def fitness(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the mean squared fill (higher is better), as a
    key whose smaller value is fitter."""
    fill = np.bincount(bins, weights=sizes) / capacity
    return len(fill), -float(np.mean(fill * fill)) if len(fill) else 0.0


def cross(taker: np.ndarray, giver: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child: well-filled bins of ``giver`` enter whole, bins of ``taker``
    that share a piece with them are dissolved, as are a few of its emptiest,
    and the displaced pieces are placed best-fit from the longest on (``sizes``
    descend)."""
    given = np.bincount(giver, weights=sizes).astype(np.int64)
    full = given >= np.quantile(given, rng.uniform(0.3, 0.7))
    inject = full & (rng.random(len(full)) < rng.uniform(0.3, 0.9))
    moved = inject[giver]
    had = np.bincount(taker, weights=sizes).astype(np.int64)
    gone = np.zeros(len(had), dtype=bool)
    gone[taker[moved]] = True
    worst = np.argsort(had, kind="stable")[: max(1, len(had) // 20)]
    gone[worst] = True
    stays = ~moved & ~gone[taker]
    child = np.empty(len(sizes), dtype=np.int64)
    child[moved] = (np.cumsum(inject) - 1)[giver[moved]]
    offset = int(inject.sum())
    kept = np.flatnonzero(~gone)
    child[stays] = offset + (np.cumsum(~gone) - 1)[taker[stays]]
    free = capacity - np.concatenate((given[inject], had[kept]))
    rest = np.flatnonzero(~moved & ~stays)
    child[rest] = _Bins(capacity, free).place(sizes[rest].tolist())
    # a kept bin may have lost nothing, so every number is in use
    return child.astype(np.int32)


def evolve(sizes: np.ndarray, people: list[np.ndarray], p: PackParams, rng: np.random.Generator) -> list[np.ndarray]:
    """One epoch of one island. ``sizes`` descend; an empty population is
    founded by best fit: from the longest, and from slightly disturbed orders."""
    least = -(-int(sizes.sum()) // p.capacity)
    while len(people) < p.population:
        key = sizes * (1 + (0.0 if not people else 0.08) * rng.random(len(sizes)))
        people.append(best_fit(sizes, np.argsort(-key, kind="stable"), p.capacity))
        if int(people[-1].max()) + 1 <= least:
            return [people[-1]]
    scored = sorted(((fitness(b, sizes, p.capacity), k) for k, b in enumerate(people)))
    ranked = [(f, people[k]) for f, k in scored][: p.population]
    for _ in range(p.generations):
        if ranked[0][0][0] <= least:
            break
        a, b = rng.choice(len(ranked), 2, replace=False) if len(ranked) > 1 else (0, 0)
        child = cross(ranked[a][1], ranked[b][1], sizes, p.capacity, rng)
        ranked.append((fitness(child, sizes, p.capacity), child))
        ranked.sort(key=lambda x: x[0])
        del ranked[p.population :]
    return [b for _, b in ranked]


_STATE = "block int, island int, sizes binary, people array<binary>, bins int, score double, done boolean"


def _epoch(state: DataFrame, p: PackParams, epoch: int, partitions: int) -> DataFrame:
    def run(frames):
        for frame in frames:
            for k in range(len(frame)):
                row = frame.iloc[k : k + 1].copy()
                if not row["done"].iat[0]:
                    sizes = np.frombuffer(row["sizes"].iat[0], dtype="<i4").astype(np.int64)
                    rng = np.random.default_rng([p.seed, int(row["block"].iat[0]), int(row["island"].iat[0]), epoch])
                    people = evolve(sizes, [np.frombuffer(b, dtype="<i4") for b in row["people"].iat[0]], p, rng)
                    bins, score = fitness(people[0], sizes, p.capacity)
                    row["people"] = [[b.astype("<i4").tobytes() for b in people]]
                    row["bins"], row["score"] = bins, score
                    row["done"] = bins <= -(-int(sizes.sum()) // p.capacity)
                yield row

    return state.repartition(partitions, "block", "island").mapInPandas(run, _STATE)


def _migrate(state: DataFrame, p: PackParams) -> DataFrame:
    """Each island's best packing joins the next island of its block; a block
    that one island has solved is done for all."""
    elite = state.select(
        "block",
        F.pmod(F.col("island") + 1, F.lit(p.islands)).alias("island"),
        F.slice("people", 1, 1).alias("elite"),
    )
    solved = state.groupBy("block").agg(F.max("done").alias("solved"))
    out = state.join(elite, ["block", "island"]).join(solved, "block")
    return out.select(
        "block", "island", "sizes", F.concat("people", "elite").alias("people"), "bins", "score", (F.col("done") | F.col("solved")).alias("done")
    )


def _ordered(table: pa.Table) -> pa.Table:
    """The order in which packings number a block's pieces."""
    keys = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
    return table.take(pc.sort_indices(table, sort_keys=keys))


def pack(pieces: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """``pieces`` (columns of :data:`PIECE`; lengths from 1 to the capacity)
    with ``sequence_id`` and ``offset``: sequences have at most ``capacity``
    ids and no gaps. Repeated rows are packed once each; an empty table gives
    an empty result. Extra columns are dropped."""
    p = params
    names = [f.split()[0] for f in PIECE.split(", ")]
    spread = F.xxhash64(*names, F.monotonically_increasing_id())
    held = materialize(pieces.select(*names).withColumn("spread", spread), "pieces")
    short = F.col("length") < p.capacity
    n = held.filter(short).count()
    blocks = max(1, -(-n // p.block_pieces))
    held = held.withColumn("block", F.pmod("spread", F.lit(blocks)).cast("int")).drop("spread")
    spark = pieces.sparkSession
    partitions = blocks * p.islands

    def found(key, table):
        sizes = _ordered(table).column("length").to_numpy().astype("<i4").tobytes()
        k = p.islands
        return pa.table(
            {
                "block": pa.array([key[0].as_py()] * k, pa.int32()),
                "island": pa.array(range(k), pa.int32()),
                "sizes": pa.array([sizes] * k, pa.binary()),
                "people": pa.array([[]] * k, pa.list_(pa.binary())),
                "bins": pa.array([0] * k, pa.int32()),
                "score": pa.array([0.0] * k),
                "done": pa.array([False] * k),
            }
        )

    state = held.filter(short).groupBy("block").applyInArrow(found, _STATE)
    for epoch in range(p.epochs):
        if epoch:
            state = _migrate(state, p)
        new = materialize(_epoch(state, p, epoch, partitions), "islands")
        if epoch:
            discard(last)  # noqa: F821
        state = last = new  # noqa: F841
    best = state.groupBy("block").agg(F.min_by("people", F.struct("bins", "score", "island")).alias("people"))
    best = best.select("block", F.col("people")[0].alias("bins"))

    def place(key, rows, answer):
        block = (key[0] if isinstance(key, tuple) else key).as_py()
        rows = _ordered(rows.drop_columns(["block"]))
        length = rows.column("length").to_numpy()
        whole = int((length >= p.capacity).sum())  # they come first
        bins = np.arange(len(length), dtype=np.int64)
        if answer.num_rows:
            bins[whole:] = whole + np.frombuffer(answer.column("bins")[0].as_py(), dtype="<i4")
        order = np.argsort(bins, kind="stable")
        before = np.concatenate(([0], np.cumsum(length[order])[:-1])) if len(order) else np.empty(0, np.int64)
        first = np.concatenate(([True], bins[order][1:] != bins[order][:-1])) if len(order) else np.empty(0, bool)
        base = np.maximum.accumulate(np.where(first, before, 0)) if len(order) else before
        offset = np.empty(len(length), dtype=np.int64)
        offset[order] = before - base
        return rows.append_column("sequence_id", pa.array((np.int64(block) << 32) + bins)).append_column("offset", pa.array(offset))

    # full pieces of a block grow with its documents' lengths and need no search: they stay out of the grouped step
    full = held.filter(~short).select(
        *names, (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    grouped = held.filter(short).repartition(max(blocks, 1), "block").groupBy("block").cogroup(best.groupBy("block"))
    placed = grouped.applyInArrow(place, PIECE + ", sequence_id long, offset long")
    return placed.unionByName(full)


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: PackParams = PackParams(), tokenizer: str | None = None, end_id: int = 2
) -> DataFrame:
    """Pack all documents: one row per piece with its place. See
    :func:`document_pieces` and :func:`pack` for nulls, repeats and ties."""
    return pack(document_pieces(docs, id_col, text_col, params.capacity, tokenizer, end_id), params)
