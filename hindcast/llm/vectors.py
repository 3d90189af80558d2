"""Shared parts of the two vector searches: usable vectors, a pivot-distance
index of bounded cells, and rounds in which blocks of queries meet the cells
that may still improve them.

Every vector belongs to its nearest centre; a centre's vectors are cut by
their distance to it into annuli, and an annulus with too many rows is dealt
out into several cells of equal bounds. By the triangle inequality a query at
distance ``d`` from the centre is at least ``max(d - hi, lo - d, 0)`` away
from all rows of a cell with distances ``lo`` to ``hi``. Rounds visit each
query's cells in the order of that bound and leave out those that cannot hold
anything better than what the query has found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hindcast.llm.common import discard, materialize

#: rows that fit the centres; the smallest hashes of the ids
SAMPLE_ROWS = 2048
#: queries of one block
QUERY_BLOCK = 4096
#: cells a query visits in the rounds before the last one, which visits all the rest
ROUNDS = (1, 8)


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, vec)``, one row per id, vectors as arrays of double. Null
    ids, null vectors and vectors with a null, NaN or infinite component are
    left out. Of several rows with one id the smallest vector, in array
    order, counts."""
    out = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    out = out.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).filter(finite)
    return out.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to ``dim``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lens = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lens) and (lens == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lens), dim))
    out[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (points * points).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2.0 * points @ centres.T
    return np.sqrt(np.maximum(square, 0.0))


def spread_centres(sample: np.ndarray, count: int) -> np.ndarray:
    """Distinct sample rows, each the farthest from those before it."""
    if not len(sample):
        return sample
    chosen = [int(np.argmin(((sample - sample.mean(0)) ** 2).sum(1)))]
    near = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < count and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def mean_centres(sample: np.ndarray, count: int, steps: int = 8) -> np.ndarray:
    """Lloyd's means of the sample, begun from spread rows."""
    centres = spread_centres(sample, count)
    for _ in range(steps if len(centres) else 0):
        near = distances(sample, centres).argmin(1)
        centres = np.stack([sample[near == k].mean(0) if (near == k).any() else centres[k] for k in range(len(centres))])
    return centres


@dataclass
class Index:
    """``rows``: the index table with its ``cell``; the arrays describe the
    cells (about ``rows / cell_rows``, which grows as the root of the rows)."""

    rows: DataFrame
    dim: int
    centres: np.ndarray
    centre: np.ndarray  # of each cell
    lo: np.ndarray
    hi: np.ndarray


def sample_points(rows: DataFrame, to_points: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("vec").toArrow()
    return to_points(picked.column("vec"))


def centres_for(total: int) -> int:
    """Centres of a table of so many rows: an eighth of the root, from 16 to
    256 (the sample has eight rows for each at least)."""
    return int(min(max(16, np.sqrt(total) / 8), 256))


def build(rows: DataFrame, dim: int, centres: np.ndarray, to_points: Callable, extra: Callable, extra_schema: str, total: int) -> Index:
    """Assign every row its centre, distance and cell. ``extra(points, centre,
    distance)`` gives more columns of the index, named in ``extra_schema``."""
    cell_rows = max(2048, int(8 * np.sqrt(total)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 8192):
                part = batch.slice(lo, 8192)
                points = to_points(part.column(1))
                dist = distances(points, centres)
                near = dist.argmin(1)
                d = dist[np.arange(len(near)), near]
                cols = {"vec_id": part.column(0), "vec": part.column(1), "centre": pa.array(near.astype(np.int32)), "dist": pa.array(d)}
                yield pa.RecordBatch.from_pydict(cols | extra(points, near, d))

    schema = "vec_id long, vec array<double>, centre int, dist double" + extra_schema
    placed = materialize(rows.select("vec_id", "vec").mapInArrow(assign, schema), "vectors")
    spans = {r["centre"]: r for r in placed.groupBy("centre").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.count("*").alias("n")).collect()}
    width = {c: (r["hi"] - r["lo"]) / max(1, -(-r["n"] // cell_rows)) or 1.0 for c, r in spans.items()}
    steps = placed.sparkSession.createDataFrame([(c, r["lo"], width[c]) for c, r in spans.items()], "c int, start double, width double")
    # a row per centre
    ringed = placed.join(F.broadcast(steps), F.col("centre") == F.col("c")).withColumn("ring", F.floor((F.col("dist") - F.col("start")) / F.col("width")).cast("int"))
    rings = ringed.groupBy("centre", "ring").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.count("*").alias("n")).orderBy("centre", "ring").collect()
    table, centre, lows, highs = [], [], [], []
    for r in rings:
        salts = -(-r["n"] // cell_rows)
        table.append((r["centre"], r["ring"], len(centre), salts))
        centre += [r["centre"]] * salts
        lows += [r["lo"]] * salts
        highs += [r["hi"]] * salts
    cells = placed.sparkSession.createDataFrame(table, "c int, g int, base int, salts int")
    salt = F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int")
    out = ringed.drop("c").join(F.broadcast(cells), (F.col("centre") == F.col("c")) & (F.col("ring") == F.col("g")))
    out = out.withColumn("cell", F.col("base") + salt).drop("c", "g", "base", "salts", "ring", "start", "width")
    return Index(materialize(out, "cells"), dim, centres, np.array(centre, dtype=np.int64), np.array(lows), np.array(highs))


def routed(index: Index, asked: DataFrame, to_points: Callable, best_score: Callable, begin: int, end: int, score_type: str) -> DataFrame:
    """Of every query (``query_id``, ``vec``, ``floor``) the cells from its
    ``begin``-th to its ``end``-th best that may hold what reaches its floor."""
    centres, centre, lows, highs, cells = index.centres, index.centre, index.lo, index.hi, len(index.centre)

    def route(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                points = to_points(part.column(1))
                d = distances(points, centres)[:, centre]
                slack = 1e-9 * (1.0 + d)
                gap = np.maximum(np.maximum(d - highs, lows - d) - slack, 0.0)
                top = best_score(points, gap)
                order = np.lexsort((np.broadcast_to(np.arange(cells), top.shape), d, -top), axis=1)[:, begin:end]
                # a rounded floor is within the slack of the bounds
                floor = part.column(2).cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy()
                go = np.take_along_axis(top, order, 1) >= floor[:, None]
                who, nth = np.nonzero(go)
                if len(who):
                    take = pa.array(who)
                    yield pa.RecordBatch.from_pydict(
                        {"cell": pa.array(order[who, nth].astype(np.int32)), "query_id": part.column(0).take(take), "vec": part.column(1).take(take), "floor": part.column(2).take(take)}
                    )

    return asked.select("query_id", "vec", "floor").mapInArrow(route, f"cell int, query_id long, vec array<double>, floor {score_type}")


def search(
    index: Index,
    queries: DataFrame,
    k: int,
    to_points: Callable[[pa.Array], np.ndarray],
    best_score: Callable[[np.ndarray, np.ndarray], np.ndarray],
    compare: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]],
    score_type: str = "double",
) -> DataFrame:
    """The ``k`` best ``(vec_id, score)`` per query: larger scores first, then
    smaller ids.

    ``to_points`` gives query points in the space of the centres;
    ``best_score(points, gap)`` the highest score possible at a distance of at
    least ``gap`` (queries x cells); ``compare(rows, query ids, query vectors,
    floors)`` the query number, row number and exact score of a cell's rows
    that may belong to a query's best, a floor being the score of the query's
    k-th find so far (-inf: none). Scores of type ``long`` are compared and kept
    as integers; floors are Python integers then."""
    spark = queries.sparkSession
    queries = materialize(queries, "queries")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    cells = len(index.centre)
    found: DataFrame | None = None
    stops = sorted({min(r, cells) for r in ROUNDS} | {cells})
    dim = index.dim

    for begin, end in zip([0, *stops], stops):
        if found is None:
            asked = queries.withColumn("floor", F.lit(None).cast(score_type))
        else:
            floors = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
            asked = queries.join(floors, "query_id", "left")

        routes = routed(index, asked, to_points, best_score, begin, end, score_type)
        routes = routes.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        routes = materialize(routes, "routes")
        wanted = routes.select(F.col("cell"), F.col("block").alias("for_block")).distinct()
        rows = index.rows.join(wanted, "cell")

        def meet(key, mine, theirs):
            ids = theirs.column("query_id").to_numpy()
            floor = theirs.column("floor")
            whole = pa.types.is_integer(floor.type)
            floors = np.array([-np.inf if f is None else f for f in floor.to_pylist()], dtype=object if whole else np.float64)
            q, r, score = compare(mine, ids, matrix(theirs.column("vec"), dim), floors)
            q, r, score = _best(q, mine.column("vec_id").to_numpy()[r], score, k)
            return pa.table({"query_id": pa.array(ids[q]), "vec_id": pa.array(r), "score": pa.array(score)})

        new = rows.groupBy("cell", "for_block").cogroup(routes.groupBy("cell", "block")).applyInArrow(meet, f"query_id long, vec_id long, score {score_type}")
        both = new if found is None else found.unionByName(new)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
        merged = materialize(both.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "vec_id", "score"), "found")
        discard(routes)
        if found is not None:
            discard(found)
        found = merged
    if found is None:
        return spark.createDataFrame([], f"query_id long, rank int, vec_id long, score {score_type}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).select("query_id", "rank", "vec_id", "score")


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each query: larger scores, then smaller ids."""
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    if not len(q):
        return q, ids, score
    first = np.concatenate(([True], q[1:] != q[:-1]))
    nth = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    keep = nth < k
    return q[keep], ids[keep], score[keep]
