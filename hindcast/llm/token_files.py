"""Token-ID output: length-delimited binary records with a separate index.

Layout of a data file (all integers little-endian), one record per document::

    u64 length | u32 masked crc of the length | payload | u32 masked crc of the payload

The payload is ``u8 flags, i64 document id, ids``; flag 1 says that the id is
null, flag 2 that ids take four bytes each instead of two. The checksum is
zlib's CRC-32 rotated right by 15 bits plus a constant, so that a checksum
stored inside checksummed data does not cancel out. The index file has three
u64 per record: offset of the record, length of its payload, number of ids.
``_manifest.json`` names the committed files in document order; files of
failed or speculative attempts are in no manifest and are never read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.llm.bpe import encode_with_end, public_tokenizer
from hindcast.llm.common import open_store

MASK_DELTA = 0xA282EAD8
HEAD = struct.Struct("<QI")
BODY = struct.Struct("<Bq")
MANIFEST = "_manifest.json"
_COMMITTED = "part int, file string, docs long, tokens long, bytes long"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    flags = (doc_id is None) | wide << 1
    body = BODY.pack(flags, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()
    length = struct.pack("<Q", len(body))
    return length + struct.pack("<I", masked_crc(length)) + body + struct.pack("<I", masked_crc(body))


def unframe(stream) -> tuple[int | None, np.ndarray] | None:
    """The next record of a binary stream, None at its end. A cut or altered
    record raises."""
    head = stream.read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size:
        raise ValueError("token file ends inside a record's length")
    length, check = HEAD.unpack(head)
    if masked_crc(head[:8]) != check:
        raise ValueError("token file: length checksum differs")
    body, tail = stream.read(length), stream.read(4)
    if len(body) < length or len(tail) < 4:
        raise ValueError("token file ends inside a record")
    if masked_crc(body) != struct.unpack("<I", tail)[0]:
        raise ValueError("token file: payload checksum differs")
    flags, doc_id = BODY.unpack_from(body)
    return (None if flags & 1 else doc_id), np.frombuffer(body, dtype="<u4" if flags & 2 else "<u2", offset=BODY.size)


def write_token_files(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 2,
) -> list[dict]:
    """Encode every whole text, append ``end_id`` and write one record per row
    in ascending order of ``id_col`` (null ids first; rows that share an id
    are ordered by their text, so reruns agree). A null text is an empty one:
    its record holds ``end_id`` alone. An empty table gives a manifest without
    files. Other columns are ignored. Returns the manifest's entries."""
    vocabulary = tokenizer or public_tokenizer()
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t"))
    rows = rows.repartitionByRange(F.col("i").asc_nulls_first(), "h").sortWithinPartitions(F.col("i").asc_nulls_first(), "h", "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = open_store(path)
        name = part = data = index = None
        docs = tokens = at = 0
        for batch in batches:
            ids_col = batch.column(0).to_pylist()
            for k, ids in enumerate(encode_with_end(batch.column(1), vocabulary, end_id)):
                if name is None:
                    part = TaskContext.get().partitionId()
                    name = f"part-{part:06d}-{uuid.uuid4().hex}"
                    store.create_dir(base, recursive=True)
                    data = store.open_output_stream(f"{base}/{name}.tokens", buffer_size=1 << 20)
                    index = store.open_output_stream(f"{base}/{name}.index", buffer_size=1 << 16)
                record = frame(ids_col[k], ids)
                data.write(record)
                index.write(struct.pack("<QQQ", at, len(record) - 16, len(ids)))
                at += len(record)
                docs += 1
                tokens += len(ids)
        if name is not None:
            data.close()
            index.close()
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "file": [name], "docs": [docs], "tokens": [tokens], "bytes": [at]}
            )

    # one row per written file
    done = sorted((r.asDict() for r in rows.select("i", "t").mapInArrow(write, _COMMITTED).collect()), key=lambda r: r["part"])
    store, base = open_store(path)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/{MANIFEST}") as out:
        out.write(json.dumps(done).encode())
    return done


def manifest(path: str) -> list[dict]:
    store, base = open_store(path)
    with store.open_input_stream(f"{base}/{MANIFEST}") as f:
        return json.loads(f.read())


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per record: ``doc_id``, ``start`` (ids of all records before
    it), ``n_tokens`` and ``ids_crc32`` (of the ids as unsigned 32-bit
    integers), and with ``with_ids`` the ids themselves. Every file is one
    task; checksums are verified."""
    files = manifest(path)
    base_id, rows = 0, []
    for f in files:
        rows.append((f["file"], base_id))
        base_id += f["tokens"]
    schema = _READ + (", ids array<int>" if with_ids else "")
    todo = spark.createDataFrame(rows, "file string, base long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(path)
        for batch in batches:
            for file, start in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_stream(f"{base}/{file}.tokens", buffer_size=1 << 20) as stream:
                    out: list = []
                    held = 0
                    while (got := unframe(stream)) is not None:
                        doc_id, ids = got
                        out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids if with_ids else None))
                        start += len(ids)
                        held += len(ids)
                        if len(out) >= 10_000 or with_ids and held > 1 << 20:
                            yield _batch(out, with_ids)
                            out, held = [], 0
                    if out:
                        yield _batch(out, with_ids)

    return todo.repartition(max(1, len(rows))).mapInArrow(read, schema)


def _batch(rows: list, with_ids: bool) -> pa.RecordBatch:
    cols = list(zip(*rows))
    out = {n: pa.array(cols[k], pa.int64()) for k, n in enumerate(("doc_id", "start", "n_tokens", "ids_crc32"))}
    if with_ids:
        out["ids"] = pa.array([i.astype(np.int32) for i in cols[4]], pa.list_(pa.int32()))
    return pa.RecordBatch.from_pydict(out)


def read_shuffled(spark: SparkSession, path: str, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """Records in a seeded random order (``position`` counts within a
    partition): the index files are read, their entries are dealt out and
    sorted by a hash, and each task fetches its records by offset."""
    files = [(f["file"],) for f in manifest(path)]
    n = partitions or max(1, len(files))

    def entries(batches):
        store, base = open_store(path)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{file}.index") as f:
                    x = np.frombuffer(f.read(), dtype="<u8").reshape(-1, 3).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"file": pa.array([file] * len(x), pa.string()), "offset": x[:, 0], "length": x[:, 1]})

    def fetch(batches):
        store, base = open_store(path)
        opened: dict = {}
        at = 0
        for batch in batches:
            out: dict = {"position": [], "doc_id": [], "ids": []}
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                f = opened.get(file)
                if f is None:
                    if len(opened) >= 64:
                        opened.pop(next(iter(opened))).close()
                    f = opened[file] = store.open_input_file(f"{base}/{file}.tokens")
                f.seek(offset)
                doc_id, ids = unframe(f)
                out["position"].append(at)
                out["doc_id"].append(doc_id)
                out["ids"].append(ids.astype(np.int32))
                at += 1
            yield pa.RecordBatch.from_pydict(
                {"position": pa.array(out["position"], pa.int64()), "doc_id": pa.array(out["doc_id"], pa.int64()), "ids": pa.array(out["ids"], pa.list_(pa.int32()))}
            )

    index = spark.createDataFrame(files, "file string").repartition(max(1, len(files))).mapInArrow(entries, "file string, offset long, length long")
    key = F.xxhash64(F.lit(seed), "file", "offset")
    dealt = index.withColumn("k", key).repartition(n, "k").sortWithinPartitions("k").select("file", "offset", "length")
    return dealt.mapInArrow(fetch, "position long, doc_id long, ids array<int>")
