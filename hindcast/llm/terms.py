"""Terms of many texts at once, on arrays of UTF-8 bytes.

A term is a maximal run of ASCII letters and digits and of characters beyond
ASCII, with A-Z lower-cased. Every byte of a character beyond ASCII is at least
0x80, so terms are runs of bytes and no text is decoded. Equal terms are folded
by Arrow's dictionary encoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A-Z to a-z, every other byte as it is
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_IN_TERM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


@dataclass
class Terms:
    """``codes[i]`` is token ``i``'s place in ``dictionary``, ``doc[i]`` its
    text; tokens are in text order."""

    dictionary: pa.LargeBinaryArray
    codes: np.ndarray
    doc: np.ndarray
    n_docs: int



def mix64(z: np.ndarray) -> np.ndarray:
    """Scramble 64-bit words: a bijection whose every output bit depends on
    every input bit."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_OF_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def term_hashes(dictionary: pa.LargeBinaryArray) -> np.ndarray:
    """A 64-bit hash of every term: each byte's random word times its place's
    random odd word, added up and scrambled."""
    n = len(dictionary)
    if not n:
        return np.empty(0, np.uint64)
    raw, at = string_bytes(dictionary)
    size = np.diff(at)
    place = np.arange(len(raw)) - np.repeat(at[:-1], size)
    odd = mix64(np.arange(1, int(size.max()) + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    return mix64(np.add.reduceat(_OF_BYTE[raw] * odd[place], at[:-1]) + size.astype(np.uint64))


def string_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column end to end, and where each text begins
    (one more than texts; a null is empty)."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def split_terms(texts: pa.Array) -> Terms:
    raw, bounds = string_bytes(texts)
    inside = _IN_TERM[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = bounds[:-1][bounds[:-1] < len(raw)]
    begins[cut] = inside[cut]  # a term does not go on in the next text
    starts = np.flatnonzero(begins)
    kept = np.cumsum(inside, dtype=np.int64)
    data = _LOWER[raw[inside]]
    offsets = np.append(kept[starts] - 1, len(data)) if len(starts) else np.zeros(1, np.int64)
    held = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    coded = held.dictionary_encode()
    doc = np.searchsorted(bounds, starts, side="right") - 1
    return Terms(coded.dictionary, coded.indices.to_numpy(), doc, len(texts))


def chunks(batch: pa.RecordBatch, column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most_bytes`` of text at most, one row at
    least."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most_bytes, side="right"))
        hi = max(hi, lo + 1)
        yield batch.slice(lo, hi - lo)
        lo = hi
