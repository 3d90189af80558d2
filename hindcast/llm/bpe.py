"""Byte-level BPE ids of whole texts, with each distinct piece encoded once.

Merges never cross a pre-token, so the ids of a text are the ids of its
pre-tokens in order. The boundaries are found for a block of texts at a time
on arrays of UTF-8 bytes, equal pieces are folded by Arrow's dictionary
encoding, and the tokenizers library encodes the distinct pieces, those of
earlier blocks from memory. Which class a character belongs to is asked of the
library's own pre-tokenizer, once per character.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from hindcast.llm.common import worker_model
from hindcast.llm.terms import string_bytes

#: bytes of text handled in one go, and distinct pieces remembered by a worker
BLOCK_BYTES = 8_000_000
CACHE_PIECES = 500_000
#: words of eight bytes that tell remembered pieces apart; longer pieces are asked for again in every block
WORDS = 3
#: pieces that the library gets as one text
JOINED = 1000

_LETTER, _NUMBER, _OTHER, _SPACE, _UNKNOWN = 0, 1, 2, 3, 255
#: endings that the byte-level pre-token pattern splits after an apostrophe (fixed values)
_SHORT = ("s", "t", "m", "d")
_LONG = ("re", "ve", "ll")


#: characters that byte-level vocabularies write bytes with (fixed values): printable ones stand for themselves
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_CHARS = np.arange(256, dtype="<u4")
_CHARS[np.setdiff1d(np.arange(256), _PRINTED)] = 256 + np.arange(256 - len(_PRINTED))


def _as_chars(raw: bytes) -> str:
    return _CHARS[np.frombuffer(raw, dtype=np.uint8)].tobytes().decode("utf-32-le")


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _keys(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """First words and length of every piece (binary), a row each, and a hash of them."""
    _, offsets, data = pieces.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
    held = np.zeros(int(at[-1]) + 8 * WORDS, dtype=np.uint8)
    held[: at[-1]] = np.frombuffer(data, dtype=np.uint8, count=int(at[-1]))
    words = np.ndarray(len(held) - 7, "<u8", held, strides=(1,))
    size, at = np.diff(at), at[:-1]
    key = np.empty((WORDS + 1, len(pieces)), dtype=np.uint64)
    for k in range(WORDS):
        key[k] = words[at + 8 * k] & _MASKS[np.clip(size - 8 * k, 0, 8)]
    key[WORDS] = size
    mixed = np.zeros(len(pieces), dtype=np.uint64)
    for part, odd in zip(key, _MIX):
        mixed = (mixed ^ part) * odd
        mixed ^= mixed >> np.uint64(31)
    return key, mixed


class _Known:
    """Ids of the pieces met last. Found by hash and compared whole, so pieces
    with equal hashes are at worst asked for again."""

    def __init__(self):
        self.hash, self.row = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.key, self.last = np.empty((WORDS + 1, 0), np.uint64), np.empty(0, np.int32)
        self.ends, self.ids = np.zeros(1, np.int32), np.empty(0, np.int32)
        self.block = 0

    def find(self, key: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """Row of every piece, -1 for unknown ones."""
        self.block += 1
        if not len(self.row):
            return np.full(len(mixed), -1, dtype=np.int32)
        place = np.minimum(np.searchsorted(self.hash, mixed), len(self.hash) - 1)
        row = self.row[place]
        same = self.hash[place] == mixed
        for mine, asked in zip(self.key, key):
            same &= mine[row] == asked
        self.last[row[same]] = self.block
        return np.where(same, row, np.int32(-1))

    def add(self, key: np.ndarray, mixed: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(mixed)
        place = np.searchsorted(self.hash, mixed[order])
        self.hash = np.insert(self.hash, place, mixed[order])
        self.row = np.insert(self.row, place, (len(self.last) + order).astype(np.int32))
        self.key = np.concatenate((self.key, key), axis=1)
        self.last = np.append(self.last, np.full(len(mixed), self.block, dtype=np.int32))
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(counts, dtype=np.int32))
        self.ids = np.append(self.ids, ids)

    def table(self, counts: np.ndarray, ids: np.ndarray) -> pa.ListArray:
        """The ids of all rows, and of further pieces behind them."""
        ends = np.append(self.ends, self.ends[-1] + np.cumsum(counts, dtype=np.int32))
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.append(self.ids, ids)))

    def shrink(self, most: int) -> None:
        """Only the ``most`` pieces met last stay."""
        keep = np.sort(np.argsort(self.last, kind="stable")[-most:])
        none = np.empty(0, np.int32)
        held = self.table(none, none).take(pa.array(keep))
        self.ends, self.ids = held.offsets.to_numpy().copy(), held.values.to_numpy().copy()
        self.key, self.last = self.key[:, keep], self.last[keep]
        row = np.full(len(self.row), -1, dtype=np.int32)
        row[keep] = np.arange(len(keep), dtype=np.int32)
        stays = row[self.row] >= 0
        self.hash, self.row = self.hash[stays], row[self.row][stays]


class PieceEncoder:
    """Encodes Arrow string arrays with one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.pre = self.tok.pre_tokenizer
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self._fast = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        line = self.tok.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self._lines = self._lines_of_bytes()
        self.kind = np.full(0x110000, _UNKNOWN, dtype=np.uint8)
        self.reset()

    def _lines_of_bytes(self):
        """The library's model for pieces that are cut already, many of them at a
        time: no further cutting, and none of the positions, words and masks of
        an encoding. None where the file's own characters for bytes are others."""
        probe = "".join(map(chr, range(1, 0x180)))
        if self.tok.normalizer is not None or "".join(p for p, _ in self.pre.pre_tokenize_str(probe)) != _as_chars(probe.encode("utf-8")):
            return None
        tokenize = self.tok.model.tokenize

        def lines(pieces: list[bytes]) -> list[list[int]]:
            # no UTF-8 text has a byte 255
            return [[t.id for t in tokenize(x)] for x in _as_chars(b"\xff".join(pieces)).split(_as_chars(b"\xff"))]

        return lines

    def reset(self) -> None:
        self.known = _Known()

    def _kind_of(self, cps: np.ndarray) -> np.ndarray:
        """Class of every code point."""
        kinds = self.kind[cps]
        new = np.unique(cps[kinds == _UNKNOWN])
        if len(new):
            for cp in new.tolist():
                c = chr(cp)
                for k, probe in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!")):
                    if len(self.pre.pre_tokenize_str(probe + c)) == 1:
                        self.kind[cp] = k
                        break
                else:
                    self.kind[cp] = _SPACE
            kinds = self.kind[cps]
        return kinds

    def _kinds(self, raw: np.ndarray) -> np.ndarray:
        """Class of the character that every byte belongs to."""
        kinds = np.append(self._kind_of(np.arange(128)), np.zeros(128, dtype=np.uint8))[raw]
        leads = np.flatnonzero(raw >= 0xC0)
        if len(leads):
            head = raw[leads].astype(np.int64)
            more = 1 + (head >= 0xE0) + (head >= 0xF0)
            cps = head & (0x3F >> more)
            for k in (1, 2, 3):
                part = more >= k
                cps[part] = cps[part] << 6 | raw[leads[part] + k] & 0x3F
            found = self._kind_of(cps)
            kinds[leads] = found
            for k in (1, 2, 3):
                part = more >= k
                kinds[leads[part] + k] = found[part]
        return kinds

    def _starts(self, raw: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
        """Positions where a pre-token begins; ``doc_starts`` are the first
        positions of the (non-empty) texts laid end to end in ``raw``."""
        n = len(raw)
        kind = self._kinds(raw)
        first = np.zeros(n + 1, dtype=bool)
        first[doc_starts] = True
        first[n] = True
        space = kind == _SPACE
        start = first[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        # one blank goes with the run it precedes
        start[1:] &= ~((raw[:-1] == 32) & ~space[1:] & ~first[1:n])
        # of a longer white-space run before more text, the last character stands apart
        ends = np.flatnonzero(space & ~np.append(space[1:], False) & ~first[1:])
        while len(back := np.flatnonzero(raw[ends] & 0xC0 == 0x80)):
            ends[back] -= 1
        start[ends] = True
        # a lone apostrophe that begins a piece takes a short ending with it
        at = np.flatnonzero((raw == 39) & start)
        at = at[at + 1 < n]
        at = at[~first[at + 1] & (kind[at + 1] == _LETTER)]
        one = raw[at + 1]
        two = np.where((at + 2 < n) & ~first[np.minimum(at + 2, n)], raw[np.minimum(at + 2, n - 1)], 0)
        take = np.zeros(len(at), dtype=np.int64)
        for x, y in _LONG:
            take[(one == ord(x)) & (two == ord(y))] = 2
        take[np.isin(one, [ord(x) for x in _SHORT])] = 1
        at, take = at[take > 0], take[take > 0]
        start[at + 1] = False
        end = at + 1 + take
        end = end[end < n]
        start[end] |= kind[end] == _LETTER
        return np.flatnonzero(start)

    def _encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
        """A list of ids for every piece: its number, and the lists. What was met
        longest ago is forgotten before the next block."""
        known = self.known
        if len(known.last) > 2 * CACHE_PIECES:
            known.shrink(CACHE_PIECES)
        key, mixed = _keys(pieces)
        rows = known.find(key, mixed)
        miss = np.flatnonzero(rows < 0)
        short = key[WORDS, miss] <= 8 * WORDS
        kept = int(short.sum())
        miss = np.concatenate((miss[short], miss[~short]))
        rows[miss] = np.arange(len(known.last), len(known.last) + len(miss), dtype=np.int32)
        counts, ids = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        for a in range(0, len(miss), 10_000):
            got = self._ask(pieces.take(pa.array(miss[a : a + 10_000])).to_numpy(zero_copy_only=False).tolist())
            counts.append(np.fromiter(map(len, got), dtype=np.int32, count=len(got)))
            ids.append(np.fromiter(chain.from_iterable(got), dtype=np.int32, count=int(counts[-1].sum())))
        count, flat = np.concatenate(counts), np.concatenate(ids)
        cut = int(count[:kept].sum())
        known.add(key[:, miss[:kept]], mixed[miss[:kept]], count[:kept], flat[:cut])
        return rows, known.table(count[kept:], flat[cut:])

    def _ask(self, pieces: list[bytes]) -> list[list[int]]:
        """The library's ids. Where its model cannot be asked, pieces without
        white space, but for a first blank, go to it many at a time with a line
        break after each: there a piece ends for the library too, and the break's
        id is in no other's, so the answer can be cut. Whatever comes back with
        another number of breaks, and the other pieces, are asked one by one."""
        if self._lines is not None:
            return self._lines(pieces)
        out: list = [None] * len(pieces)
        # a piece that ends in white space is nothing else
        plain = [i for i, p in enumerate(pieces) if 32 < p[-1] < 128 or p[-1] > 127 and not p.decode("utf-8")[-1].isspace()]
        groups = [plain[a : a + JOINED] for a in range(0, len(plain), JOINED)] if self.line is not None else []
        answers = self._fast([b"\n".join([*(pieces[i] for i in group), b""]).decode("utf-8") for group in groups], add_special_tokens=False)
        for group, answer in zip(groups, answers):
            ids = answer.ids
            ends = [k for k, i in enumerate(ids) if i == self.line]
            if len(ends) == len(group):
                at = 0
                for i, end in zip(group, ends):
                    out[i] = ids[at:end]
                    at = end + 1
        alone = [i for i, got in enumerate(out) if got is None]
        for i, answer in zip(alone, self._fast([pieces[i].decode("utf-8") for i in alone], add_special_tokens=False)):
            out[i] = answer.ids
        return out

    def _block(self, raw: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """Ids of the texts laid end to end in ``raw``; text ``i`` reaches from
        ``bounds[i]`` to ``bounds[i + 1]``."""
        texts = len(bounds) - 1
        if not len(raw):
            return [np.empty(0, np.int32)] * texts
        starts = self._starts(raw, bounds[:-1][bounds[1:] > bounds[:-1]])
        offsets = np.append(starts, len(raw)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        rows, table = self._encode_pieces(coded.dictionary)
        rows = rows[coded.indices.to_numpy()]
        flat = table.take(pa.array(rows)).values.to_numpy()
        after = np.zeros(len(rows) + 1, dtype=np.int64)
        np.cumsum(np.diff(table.offsets.to_numpy())[rows], out=after[1:])
        cut = after[np.searchsorted(starts, bounds)]
        return [flat[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of every text (null: none), as ``Tokenizer.encode(text,
        add_special_tokens=False)`` gives them; those of a block of texts are
        held at a time."""
        raw, bounds = string_bytes(texts)
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + BLOCK_BYTES, side="right")) - 1)
            part = raw[bounds[lo] : bounds[hi]]
            found = self._block(part, bounds[lo : hi + 1] - bounds[lo])
            held = part.tobytes() if self.special else b""
            if any(t.encode("utf-8") in held for t in self.special):
                for i in range(lo, hi):
                    s = texts[i].as_py() or ""
                    if any(t in s for t in self.special):
                        # the library finds its own special strings before pieces are cut
                        found[i - lo] = np.array(self.tok.encode(s, add_special_tokens=False).ids, dtype=np.int32)
            yield from found
            lo = hi


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and file. A task has one core: the
    library's own threads would only wait for each other."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return worker_model(("bpe", path), lambda: PieceEncoder(path))


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_with_end(texts: pa.Array, path: str, end_id: int) -> Iterator[np.ndarray]:
    """Ids of every text followed by ``end_id``."""
    end = np.array([end_id], dtype=np.int32)
    return (np.concatenate((ids, end)) for ids in encoder(path).encode(texts))
