"""Approximate nearest neighbours by cosine with randomly rotated one-bit codes.

Rows are unit vectors ``x = c + r u`` around their nearest centre ``c``. The
unit residual ``u`` is rotated by a random orthogonal matrix and kept as its
signs, packed 64 to a word; three scalars correct the estimate: ``r``, the
inner product ``f`` of the rotated residual with its code, and ``<u, c>``. A
rotated query is quantised to a few bit planes, so a code's inner product with
it is a sum of population counts. The estimate ``<code, q> / f`` is unbiased,
and its error is below ``eps sqrt(1 - f^2) / f / sqrt(D - 1)`` times the
query's length with a probability that ``eps`` sets. Only rows whose estimate
plus error reaches the query's k-th exact score are compared on the original
vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import materialize
from hindcast.llm.vectors import build, centres_for, matrix, mean_centres, sample_points, search, usable

PLANES = 6
EPS = 3.0
SEED = 11


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same for a dimension and seed."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def pack_bits(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as little-endian 64-bit words."""
    pad = -bits.shape[1] % 64
    wide = np.pad(bits, ((0, 0), (0, pad)))
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


def planes_of(q: np.ndarray, planes: int = PLANES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Quantised queries: words ``(queries, planes, words)``, offset, step and
    the largest error the quantisation can bring to an inner product with a
    code of entries ``+-1 / sqrt(D)``."""
    low = q.min(1)
    step = (q.max(1) - low) / ((1 << planes) - 1)
    step = np.where(step > 0, step, 1.0)
    level = np.rint((q - low[:, None]) / step[:, None]).astype(np.int64)
    error = np.abs(q - (low[:, None] + step[:, None] * level)).sum(1) / np.sqrt(q.shape[1])
    words = np.stack([pack_bits((level >> b) & 1 == 1) for b in range(planes)], axis=1)
    return words, low, step, error


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that tiny and
    huge vectors neither vanish nor overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision. Equal rows give equal values."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        out = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
    odd = ~np.isfinite(out)
    if odd.any():
        out[odd] = (unit(a[odd]) * unit(b[odd])).sum(1)
    return out


def nearest(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", centres: int | None = None, eps: float = EPS) -> DataFrame:
    """For every query row (``is_query``, over ``vec_id``) its ``k`` nearest
    rows by cosine that the codes let through, its own left out: ``query_id``,
    ``rank``, ``vec_id``, ``score``; ties go to the smaller id. Scores are
    exact cosines of the original vectors; only which rows are compared rests
    on estimates.

    Null ids, null or zero vectors and vectors with null or non-finite
    components take no part; of rows with one id one counts; shorter vectors
    are as if padded with zeros. The centres, more of them for larger tables
    unless ``centres`` says how many, are fitted on a sample of 2,048 rows; every
    row is indexed."""
    base = materialize(usable(rows, id_col, vec_col).filter(F.exists("vec", lambda x: x != 0.0)), "usable")
    size, dim = base.agg(F.count("*"), F.max(F.size("vec"))).first()
    dim = dim or 1

    def points(column) -> np.ndarray:
        return unit(matrix(column, dim))

    middle = mean_centres(sample_points(base, points), centres or centres_for(size)) if size else np.zeros((0, dim))
    turn = rotation(dim)
    root = np.sqrt(dim)

    def codes(x: np.ndarray, near: np.ndarray, dist: np.ndarray) -> dict:
        c = middle[near]
        u = np.where(dist[:, None] > 0, (x - c) / np.where(dist > 0, dist, 1.0)[:, None], 0.0)
        turned = u @ turn.T
        words = pack_bits(turned > 0)
        f = np.abs(turned).sum(1) / root
        width = words.shape[1] * 8
        packed = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(np.arange(0, (len(words) + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(words).tobytes())])
        return {"code": packed, "f": pa.array(np.where(f > 0, f, 1.0)), "shift": pa.array((u * c).sum(1))}

    index = build(base, dim, middle, points, codes, ", code binary, f double, shift double", size)

    def best_score(q: np.ndarray, gap: np.ndarray) -> np.ndarray:
        return 1.0 - gap * gap / 2.0 + 1e-9

    def compare(mine: pa.Table, ids: np.ndarray, asked: np.ndarray, floors: np.ndarray):
        x = matrix(mine.column("vec"), dim)
        names = mine.column("vec_id").to_numpy()
        words = np.frombuffer(b"".join(mine.column("code").to_pylist()), dtype="<u8").reshape(len(x), -1)
        f, shift, r = (mine.column(n).to_numpy() for n in ("f", "shift", "dist"))
        c = middle[mine.column("centre")[0].as_py()]
        ones = np.bitwise_count(words).sum(1).astype(np.float64)
        spread = np.sqrt(np.maximum(1.0 - f * f, 0.0)) / f * (eps / np.sqrt(max(dim - 1, 1)))
        q = unit(asked)
        off = q - c
        length = np.sqrt((off * off).sum(1))
        turned = off @ turn.T
        planes, low, step, error = planes_of(turned)
        total = low * dim + step * (np.bitwise_count(planes).sum(2) * (1 << np.arange(planes.shape[1]))).sum(1)
        along = q @ c
        qs, rs, ss = [], [], []
        for j in range(len(ids)):
            count = np.zeros(len(x), dtype=np.int64)
            for b in range(planes.shape[1]):
                count += np.bitwise_count(words & planes[j, b]).sum(1).astype(np.int64) << b
            product = (2.0 * (low[j] * ones + step[j] * count) - total[j]) / root
            guess = along[j] + r * (product / f + shift)
            top = guess + r * (length[j] * spread + error[j] / f) + 1e-9
            other = names != ids[j]
            floor = floors[j]
            free = np.flatnonzero(other)
            if len(free) > k:
                # the best-looking rows first: their exact scores raise the floor
                first = free[np.argpartition(-guess[free], k)[:k]]
                floor = max(floor, float(cosine(x[first], np.broadcast_to(asked[j], (k, dim))).min()))
            hit = np.flatnonzero(other & (top >= floor))
            score = cosine(x[hit], np.broadcast_to(asked[j], (len(hit), dim)))
            good = score >= floor
            qs.append(np.full(int(good.sum()), j))
            rs.append(hit[good])
            ss.append(score[good])
        return np.concatenate(qs), np.concatenate(rs), np.concatenate(ss)

    queries = base.filter(is_query).select(F.col("vec_id").alias("query_id"), "vec")
    return search(index, queries, k, points, best_score, compare)
