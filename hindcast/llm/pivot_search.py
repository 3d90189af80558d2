"""Exact top-k search by inner product over a pivot-distance index.

With ``M`` the largest norm, a row ``x`` becomes the point ``(x, sqrt(M^2 -
|x|^2))`` and a query ``q`` the point ``(q, 0)``; then ``|p - q|^2 = |q|^2 +
M^2 - 2 <q, x>``, so the nearest points are the rows with the largest inner
product, and distances to pivots bound inner products from above. Rows are
keyed by their nearest pivot and distance. A query expands from the annulus
around its own distance and stops where the bound falls below its k-th score.
Scores are integers and exact; a bound only ever excludes what is strictly
worse.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.llm.vectors import build, centres_for, distances, matrix, sample_points, search, spread_centres, usable

_LONG = 2**63 - 1
SCALE = 1024


def quantised(vec: Column, scale: int = SCALE) -> Column:
    return F.transform(vec, lambda x: F.floor(x * F.lit(float(scale))).cast("double"))


def exact_top_k(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, pivots: int | None = None) -> DataFrame:
    """For every query row (``is_query``, over ``vec_id``) its ``k`` rows of
    largest integer inner product, the query's own left out: ``query_id``,
    ``rank``, ``vec_id``, ``score``; ties go to the smaller id, and fewer rows
    give fewer ranks. Components become ``floor(scale * x)``. The pivots grow
    with the table unless ``pivots`` says how many.

    Null ids, null vectors and vectors with null or non-finite components take
    no part; of rows with one id one counts; shorter vectors are as if padded
    with zeros. Scores are exact; components and scores outside 64 bits count
    as the nearest long. No rows, or none but the query: no result for it."""
    from hindcast.llm.common import materialize

    base = usable(rows, id_col, vec_col).select("vec_id", quantised(F.col("vec"), scale).alias("vec"))
    base = materialize(base, "usable")
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    size, dim, top, most = base.agg(F.count("*"), F.max(F.size("vec")), F.max(square), F.max(F.array_max(F.transform("vec", F.abs)))).first()
    dim, top, most = dim or 1, top or 0.0, most or 0.0
    # sums are exact as doubles, as 64-bit integers, or as Python's
    kind = np.float64 if most * most * dim < 2.0**53 else np.int64 if most * most * dim < 2.0**62 else object

    def row_points(column) -> np.ndarray:
        x = matrix(column, dim)
        return np.column_stack((x, np.sqrt(np.maximum(top - (x * x).sum(1), 0.0))))

    def query_points(column) -> np.ndarray:
        x = matrix(column, dim)
        return np.column_stack((x, np.zeros(len(x))))

    centres = spread_centres(sample_points(base, row_points), pivots or centres_for(size)) if size else np.zeros((0, dim + 1))
    index = build(base, dim, centres, row_points, lambda *_: {}, "", size)
    slack = 1e-9 * (1.0 + top)

    def best_score(points: np.ndarray, gap: np.ndarray) -> np.ndarray:
        return ((points * points).sum(1)[:, None] + top - gap * gap) / 2.0 + slack

    def compare(mine: pa.Table, ids: np.ndarray, asked: np.ndarray, floors: np.ndarray):
        dist = mine.column("dist").to_numpy()
        order = np.argsort(dist, kind="stable")
        dist = dist[order]
        x = matrix(mine.column("vec"), dim)[order]
        names = mine.column("vec_id").to_numpy()[order]
        pivot = centres[mine.column("centre")[0].as_py()][None, :]
        d = distances(np.column_stack((asked, np.zeros(len(asked)))), pivot)[:, 0]
        # rows further than this from a query's own annulus cannot reach its floor
        reach = np.sqrt(np.maximum((asked * asked).sum(1) + top + 2 * slack - 2.0 * floors.astype(np.float64), 0.0)) + 1e-9 * (1.0 + d)
        begin, end = np.searchsorted(dist, d - reach, "left"), np.searchsorted(dist, d + reach, "right")
        qs, rs, ss = [], [], []
        if kind is object:
            x, asked = (np.array([[int(v) for v in row] for row in m], dtype=object).reshape(m.shape) for m in (x, asked))
        else:
            x, asked = x.astype(kind), asked.astype(kind)
        for j, (a, b) in enumerate(zip(begin.tolist(), end.tolist())):
            if a == b:
                continue
            s = x[a:b] @ asked[j]
            if kind is object:
                s = np.array([max(-_LONG, min(v, _LONG)) for v in s])
            s = s.astype(np.int64)
            other = names[a:b] != ids[j]
            floor = floors[j]
            if int(other.sum()) > k:
                t = s[other]
                floor = max(floor, int(np.partition(t, len(t) - k)[len(t) - k]))
            hit = np.flatnonzero(other & (s >= floor))
            qs.append(np.full(len(hit), j))
            rs.append(order[a + hit])
            ss.append(s[hit])
        if not qs:
            none = np.empty(0, np.int64)
            return none, none, none
        return np.concatenate(qs), np.concatenate(rs), np.concatenate(ss)

    queries = base.filter(is_query).select(F.col("vec_id").alias("query_id"), "vec")
    return search(index, queries, k, query_points, best_score, compare, "long")
