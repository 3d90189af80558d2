"""Vector code compression: product codebooks fitted and applied through
per-dimension dictionaries of values.

Vectors become integers and are stored in blocks: per dimension the block's
distinct integers, and for every vector its place among them in 16 bits. To
compare a block with a codebook, the squared differences of every distinct
integer of a dimension to all entries are tabulated; a part's distances are then
table rows gathered by the dictionary codes and added up. The same codes give
the sums of the parts assigned to an entry: counts per (entry, distinct
integer) times the integers. Tasks hand on counts and sums of entries, added up
in a tree. All of it is integer arithmetic, so the result does not depend on
how rows are dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.llm.common import columns_of, materialize

#: dictionary codes of a block take 16 bits each, and this much memory
BLOCK_ROWS, BLOCK_BYTES = 1 << 16, 16 << 20
_LONG = 2**63 - 1


@dataclass
class Codebooks:
    """``entries``: integers [part, entry, position]; ``dim`` positions in all,
    cut into equal consecutive parts. ``scale`` turns components into integers."""

    entries: np.ndarray
    scale: int

    @property
    def parts(self) -> int:
        return self.entries.shape[0]

    def sha256(self) -> str:
        """Of all entries' decimal components by part, entry and position."""
        return hashlib.sha256(",".join(str(int(v)) for v in self.entries.ravel()).encode()).hexdigest()

    def decode(self, code: bytes) -> np.ndarray:
        """The vector that a code stands for, as components."""
        return np.concatenate([self.entries[p, c] for p, c in enumerate(code)]).astype(np.float64) / self.scale


def scaled(vectors: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(vectors * float(scale))


@dataclass
class Block:
    """``values[d]``: the distinct integers of dimension ``d``, ascending;
    ``codes[d]``: every vector's place among them."""

    values: list[np.ndarray]
    codes: np.ndarray

    @classmethod
    def of(cls, integers: np.ndarray) -> Block:
        folded = [np.unique(integers[:, d], return_inverse=True) for d in range(integers.shape[1])]
        return cls([v for v, _ in folded], np.stack([c.ravel().astype("<u2") for _, c in folded]))

    def store(self) -> dict:
        return {"sizes": [len(v) for v in self.values], "values": np.concatenate(self.values).astype("<f8").tobytes(), "codes": self.codes.astype("<u2").tobytes()}

    @classmethod
    def load(cls, row) -> Block:
        values = np.split(np.frombuffer(row["values"], dtype="<f8"), np.cumsum(row["sizes"])[:-1])
        return cls(values, np.frombuffer(row["codes"], dtype="<u2").reshape(len(values), -1))

    def integers(self, d: int, wide: bool) -> np.ndarray:
        """The dictionary of a dimension: 64-bit integers, or Python's where
        squares may not fit."""
        v = self.values[d]
        return np.array([int(x) for x in v], dtype=object) if wide else v.astype(np.int64)


def assign(block: Block, entries: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """Every part's nearest entry [part, row], ties to the lower one, and the
    squared distances [part, row]."""
    parts, size, width = entries.shape
    rows = block.codes.shape[1]
    kind = object if wide else np.int64
    code = np.empty((parts, rows), dtype=np.int64)
    error = np.empty((parts, rows), dtype=kind)
    for p in range(parts):
        far = np.zeros((rows, size), dtype=kind)
        for j in range(width):
            d = p * width + j
            table = (block.integers(d, wide)[:, None] - entries[p, :, j].astype(kind)[None, :]) ** 2
            far += table[block.codes[d]]
        code[p] = far.argmin(axis=1)
        error[p] = far[np.arange(rows), code[p]]
    return code, error


def tally(block: Block, code: np.ndarray, size: int, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each entry [part, entry] and their sums [part, entry, position],
    as Python integers."""
    parts, width = code.shape[0], len(block.values) // code.shape[0]
    counts = np.stack([np.bincount(c, minlength=size) for c in code]).astype(object)
    sums = np.empty((parts, size, width), dtype=object)
    for p in range(parts):
        for j in range(width):
            d = p * width + j
            n = len(block.values[d])
            met = np.bincount(code[p] * n + block.codes[d], minlength=size * n).reshape(size, n)
            # a block's sums of values below 2^46 fit in 64 bits
            sums[p, :, j] = met.astype(object if wide else np.int64) @ block.integers(d, wide)
    return counts, sums


def _tally_task(rows, entries: np.ndarray, wide: bool):
    total = None
    for row in rows:
        block = Block.load(row)
        more = tally(block, assign(block, entries, wide)[0], entries.shape[1], wide)
        total = more if total is None else _add(total, more)
    if total is not None:
        yield total


def _add(a, b):
    return a[0] + b[0], a[1] + b[1]


def _moved(entries: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    out = entries.copy()
    for p, e in zip(*np.nonzero(counts)):
        out[p, e] = [int(s) // int(counts[p, e]) for s in sums[p, e]]
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lens = np.diff(column.offsets.to_numpy())
    if (lens == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lens), dim))
    out[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


@dataclass
class Compressed:
    """``rows``: the kept columns, ``code`` (a byte per part) and ``error``
    (long; a larger one counts as the largest long)."""

    rows: DataFrame
    codebooks: Codebooks | None


def compress(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", keep: list[str] | None = None, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> Compressed:
    """Fit a codebook of ``entries`` per part position on all rows and encode
    every row. Components become ``floor(scale * x)``. Codebooks begin as the
    parts of the rows with the smallest ids, ascending; a round assigns every
    part to the nearest entry and moves entries to the floor of their parts'
    mean; entries without parts stay.

    Rows whose vector is null or holds a null, NaN or infinite component (also
    after scaling) are left out. Null ids count as the largest; rows with equal
    ids are ordered by their vectors; repeated rows stay and count. Shorter
    vectors, and a length that the parts do not divide, are padded with zeros.
    Fewer rows than entries give as many entries as rows. No rows: no codebooks
    and an empty result. Columns in ``keep`` are handed on whatever they are
    called."""
    spark = rows.sparkSession
    kept = [id_col] if keep is None else keep
    box = F.struct(*[c.alias(f"k{n}") for n, c in enumerate(columns_of(kept))])
    base = rows.select(box.alias("kept"), *(c.alias(n) for c, n in zip(columns_of([id_col, vec_col]), ("i", "v"))))
    base = base.withColumn("v", F.col("v").cast("array<double>"))
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x * F.lit(float(scale))) < F.lit(float("inf")), F.lit(False)))
    base = base.filter(F.col("v").isNotNull()).filter(finite)
    fields = [T.StructField(f"k{n}", f.dataType) for n, f in enumerate(rows.select(*columns_of(kept)).schema.fields)]
    final = T.StructType([*(T.StructField(k, f.dataType) for k, f in zip(kept, fields)), T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])

    size, longest, largest = base.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not size:
        return Compressed(spark.createDataFrame([], final), None)
    dim = max(1, -(-(longest or 0) // parts)) * parts
    top = abs(float(np.floor((largest or 0.0) * scale))) + 1
    # squared distances of a part and sums of a block must fit in 64 bits
    wide = top >= 2**46 or (2 * top) ** 2 * (dim // parts) >= 2**62
    seeds = base.orderBy(F.col("i").asc_nulls_last(), "v").limit(entries).select("v").toArrow().column("v").combine_chunks()
    first = scaled(_matrix(seeds, dim), scale)
    books = np.array([[int(x) for x in row] for row in first], dtype=object).reshape(len(first), parts, -1).swapaxes(0, 1)
    block_rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (2 * dim)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def block(x: pa.Table) -> pa.RecordBatch:
            x = x.combine_chunks()
            out = {"kept": pa.array([x.column(0).to_pylist()], pa.list_(x.schema.field(0).type))}
            made = Block.of(scaled(_matrix(x.column(1).combine_chunks(), dim), scale)).store()
            out |= {"sizes": pa.array([made["sizes"]], pa.list_(pa.int32())), "values": [made["values"]], "codes": [made["codes"]]}
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= block_rows:
                x = pa.Table.from_batches(held)
                yield block(x.slice(0, block_rows))
                held, n = x.slice(block_rows).to_batches(), n - block_rows
        if n:
            yield block(pa.Table.from_batches(held))

    schema = T.StructType(
        [
            T.StructField("kept", T.ArrayType(T.StructType(fields))), T.StructField("sizes", T.ArrayType(T.IntegerType())),
            T.StructField("values", T.BinaryType()), T.StructField("codes", T.BinaryType()),
        ]
    )
    blocks = materialize(base.select("kept", "v").mapInArrow(pack, schema), "coded-blocks")
    stored = blocks.select("sizes", "values", "codes").rdd
    for _ in range(rounds):
        counts, sums = stored.mapPartitions(partial(_tally_task, entries=books, wide=wide)).treeReduce(_add)
        books = _moved(books, counts, sums)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                code, error = assign(Block.load({n: row.column(n)[0].as_py() for n in ("sizes", "values", "codes")}), books, wide)
                errors = [min(int(e), _LONG) for e in error.sum(axis=0)]
                columns = row.column("kept").flatten().flatten()
                codes = [bytes(c) for c in code.T.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(codes, pa.binary()), pa.array(errors, pa.int64())], names=[f"c{n}" for n in range(len(columns) + 2)])

    inner = T.StructType([T.StructField(f"c{n}", f.dataType) for n, f in enumerate(final.fields)])
    out = blocks.mapInArrow(encode, inner).toDF(*final.names)
    return Compressed(out, Codebooks(books, scale))


#: names of groups with their sums that are broadcast, in bytes
SUMS_BYTES = 4 << 20
_SALTS = 64


def sum_over_equal(rows: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """``rows`` with ``out``, the sum of ``value`` over all rows with an equal
    ``group``, nulls together. Sums are formed before the shuffle. The groups'
    table is broadcast while it is small by its bytes; a larger one meets rows
    that are dealt out by the group and a salt, so no task gets a whole large
    group."""
    sums = rows.groupBy(F.col(group).alias("__g")).agg(F.sum(F.col(value).cast("decimal(38,0)")).alias("__s"))
    sums = sums.withColumn("__s", F.least("__s", F.lit(_LONG)).cast("long"))
    sums = materialize(sums, "sums")
    size = sums.agg(F.sum(F.lit(24) + F.coalesce(F.length(F.col("__g").cast("string")), F.lit(0)))).first()[0] or 0
    if size <= SUMS_BYTES:
        met = rows.join(F.broadcast(sums), F.col(group).eqNullSafe(F.col("__g")), "left")
    else:
        salted = sums.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        mine = rows.withColumn("__mine", F.pmod(F.xxhash64(*columns_of(rows.columns)), F.lit(_SALTS)).cast("int"))
        met = mine.join(salted, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__mine") == F.col("__salt")), "left")
    return met.withColumn(out, F.col("__s")).select(*columns_of(rows.columns), out)
