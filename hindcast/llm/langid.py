"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built of a bounded sample of labelled
text. A text is then parsed greedily against each automaton: a phrase is the
longest match that continues from where the last one ended. The number of
phrases, times the logarithm of the sample's length and divided by the length
of the text, estimates the cross entropy; the language with the fewest
normalised phrases wins.

A parse only follows the automaton's transitions from the root, so each
automaton becomes one dense table ``state x letter`` whose missing transitions
hold the state after starting a new phrase, with the sign bit set. The table has
columns for the letters that are commonest in the sample; every other letter of
the sample has a code of its own as well, whose transitions are kept sorted by
state and code and looked up. A letter that a language's sample lacks is a
phrase of its own. Many segments of text step through all tables at once.
Segments of ``segment_letters`` letters are parsed on their own and their
phrases added; every letter of a text is parsed.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from hindcast.llm.common import boxed, worker_model

UNDETERMINED = "und"
_PILES = 64


@dataclass(frozen=True)
class LangIdParams:
    #: bounds of the labelled sample: texts of a language, and letters taken of each
    sample_texts: int = 48
    letters_per_text: int = 1000
    #: letters with a column in the dense table; the others are looked up
    letters: int = 60
    #: slices that a long text's part of the sample is taken in, spread over the text
    slices: int = 4
    #: letters of a text that are parsed in one go
    segment_letters: int = 2048


def suffix_automaton(codes: list[int], width: int) -> tuple[np.ndarray, dict[int, dict[int, int]]]:
    """Transitions of the suffix automaton of ``codes``: for codes below
    ``width`` an int32 table ``(states, width)`` with -1 where there is none,
    for the others a dictionary of the states that have any. State 0 is the
    root. Built online, one letter at a time."""
    # one flat table from the start: a dictionary for every state would take ten times the room
    table = array("i", [-1]) * ((2 * len(codes) + 1) * width)
    rare: dict[int, dict[int, int]] = {}
    link, length = array("i", [-1]), array("i", [0])

    def target(at: int, c: int) -> int:
        return table[at * width + c] if c < width else rare[at].get(c, -1) if at in rare else -1

    def lead(at: int, c: int, to: int) -> None:
        if c < width:
            table[at * width + c] = to
        else:
            rare.setdefault(at, {})[c] = to

    last = 0
    for c in codes:
        new = len(link)
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and target(at, c) < 0:
            lead(at, c, new)
            at = link[at]
        if at >= 0:
            to = target(at, c)
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(link)
                table[copy * width : (copy + 1) * width] = table[to * width : (to + 1) * width]
                if to in rare:
                    rare[copy] = dict(rare[to])
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and target(at, c) == to:
                    lead(at, c, copy)
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return np.frombuffer(table, dtype=np.int32).reshape(-1, width)[: len(link)], rare


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Lower-case code point of every letter; 0 for anything else."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low[0])
    return out


def normalise(text: str) -> np.ndarray:
    """Code points of the letters in lower case, each run of other characters
    as one 0, with a 0 before and after."""
    cps = _folded()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
    keep = np.ones(len(cps), dtype=bool)
    keep[1:] = (cps[1:] != 0) | (cps[:-1] != 0)
    cps = cps[keep]
    if not len(cps) or not cps.any():
        return np.empty(0, dtype=np.uint32)
    return np.concatenate((np.zeros(int(cps[0] != 0), np.uint32), cps, np.zeros(int(cps[-1] != 0), np.uint32)))


class CrossParser:
    """Automata of all languages in one table. ``sample`` maps a language to
    its texts."""

    def __init__(self, sample: dict[str, list[str]], params: LangIdParams):
        self.p = params
        self.langs = sorted(sample)
        texts = {k: [normalise(t) for t in sorted(sample[k])] for k in self.langs}
        counts = Counter()
        for parts in texts.values():
            for part in parts:
                cps, n = np.unique(part, return_counts=True)
                counts.update(dict(zip(cps.tolist(), n.tolist())))
        counts.pop(0, None)
        known = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
        # 0: between words, 1: a letter that no sample has; codes from `width` on have no column
        self.width = min(len(known), params.letters) + 2
        self.codes = len(known) + 2
        self.code = np.ones(0x110000, dtype=np.int32)
        self.code[0] = 0
        self.code[known] = np.arange(2, self.codes)
        tables, keys, aims, starts, self.roots, self.bits, at = [], [], [], [], [], [], 0
        for k in self.langs:
            codes = self.code[np.concatenate(texts[k])] if texts[k] else np.empty(0, np.int32)
            table, rare = suffix_automaton(codes.tolist(), self.width)
            # a letter that the sample lacks is a phrase of its own: the state after the last one
            alone = len(table)
            begin = np.full(self.codes, alone)
            begin[: self.width] = np.where(table[0] < 0, alone, table[0])
            for c, to in rare.get(0, {}).items():
                begin[c] = to
            start = begin[: self.width]
            table = np.vstack((table, np.full((1, self.width), -1, dtype=np.int32)))
            broken = table < 0
            broken[0] = False  # no phrase is open at the root
            table = (np.where(table < 0, start[None, :], table) + at) * self.width
            tables.append(np.where(broken, table | np.int32(-(2**31)), table).astype(np.int32))
            found = sorted(((state + at) * self.codes + c, (to + at) * self.width) for state, row in rare.items() for c, to in row.items())
            keys += [x for x, _ in found]
            aims += [x for _, x in found]
            starts.append((begin + at) * self.width)
            self.roots.append(at * self.width)
            self.bits.append(math.log2(max(2, len(codes))))
            at += len(table)
        self.table = np.concatenate(tables).ravel() if tables else np.empty(0, np.int32)
        self.keys, self.aims = np.array(keys, dtype=np.int64), np.array(aims, dtype=np.int64)
        self.starts = np.array(starts, dtype=np.int64)
        self.roots = np.array(self.roots, dtype=np.int32)
        self.bits = np.array(self.bits)

    def _look_up(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Steps of all languages (rows) on letters without a column, as the
        dense table gives them: a broken phrase has the sign bit set."""
        key = state.astype(np.int64) // self.width * self.codes + letter
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        there = self.keys[at] == key
        fresh = self.starts[:, letter]
        broken = np.where(state == self.roots[:, None], fresh, fresh | -(2**31))
        return np.where(there, self.aims[at], broken).astype(np.int32)

    def phrases(self, codes: list[np.ndarray]) -> np.ndarray:
        """Phrases per language (rows) and text (columns)."""
        step = self.p.segment_letters
        lens = np.array([len(c) for c in codes], dtype=np.int64)
        parts = -(-lens // step)
        owner = np.repeat(np.arange(len(codes)), parts)
        if not len(owner):
            return np.zeros((len(self.langs), len(codes)), dtype=np.int64)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.minimum(lens[owner] - nth * step, step)
        order = np.argsort(-size, kind="stable")
        owner, nth, size = owner[order], nth[order], size[order]
        flat = np.concatenate(codes)
        begin = (np.cumsum(lens) - lens)[owner] + nth * step
        live = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right")
        state = np.repeat(self.roots[:, None], len(owner), axis=1)
        count = np.zeros(state.shape, dtype=np.int32)
        rare = bool((flat >= self.width).any())
        for t, n in enumerate(live.tolist()):
            s = state[:, :n]
            letter = flat[begin[:n] + t]
            got = np.take(self.table, s + letter, mode="clip")
            if rare:
                odd = np.flatnonzero(letter >= self.width)
                if len(odd):
                    got[:, odd] = self._look_up(s[:, odd], letter[odd])
            count[:, :n] -= got >> 31
            np.bitwise_and(got, 0x7FFFFFFF, out=s)
        # the last phrase of a segment is open until its end
        open_end = state != self.roots[:, None]
        out = np.zeros((len(self.langs), len(codes)), dtype=np.int64)
        for k in range(len(self.langs)):
            np.add.at(out[k], owner, count[k] + open_end[k])
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of every text. The score is how much lower the
        winner's normalised phrases are than the runner-up's, as a share of
        the latter; 1 if there is one language only, 0 for ``und``."""
        out = [(UNDETERMINED, 0.0)] * len(texts)
        if not self.langs:
            return out
        rows, codes, held = [], [], 0

        def flush():
            nonlocal rows, codes, held
            lens = np.array([len(c) for c in codes])
            rate = self.phrases(codes) * self.bits[:, None] / lens
            for j, i in enumerate(rows):
                order = np.argsort(rate[:, j], kind="stable")  # ties: the first language by code point
                best = float(rate[order[0], j])
                second = float(rate[order[1], j]) if len(order) > 1 else math.inf
                score = 1.0 if math.isinf(second) else (second - best) / second if second > 0 else 0.0
                out[i] = (self.langs[order[0]], score)
            rows, codes, held = [], [], 0

        for i, t in enumerate(texts):
            c = self.code[normalise(t)] if t else ()
            if len(c):
                rows.append(i)
                codes.append(c)
                held += len(c)
                if held > 6_000_000:
                    flush()
        if rows:
            flush()
        return out


def _parser(sample: tuple, params: LangIdParams) -> CrossParser:
    """One parser per worker process."""
    return worker_model(("langid", sample, params), lambda: CrossParser({k: list(v) for k, v in sample}, params))


def labelled_sample(docs: DataFrame, params: LangIdParams = LangIdParams(), lang_col: str = "lang", text_col: str = "text") -> dict[str, list[str]]:
    """The bounded sample: of every language the ``sample_texts`` distinct
    texts with the smallest hashes, and ``letters_per_text`` characters of
    each, in ``slices`` spread evenly over a longer text. Rows without label or
    text are left out. The driver gets ``languages x sample_texts`` short
    strings."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    # equal texts of a language fold before the ranking, so copies cannot fill the sample; a language
    # is ranked in piles first, so that no task gets all of its rows
    keys = rows.select("lang", "h").distinct().withColumn("pile", F.pmod("h", F.lit(_PILES)))
    for by in (("lang", "pile"), ("lang",)):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("h"))
        keys = keys.withColumn("r", rank).filter(F.col("r") <= params.sample_texts).drop("r")
    chosen = {(r["lang"], r["h"]) for r in keys.select("lang", "h").collect()}
    if not chosen:
        return {}
    width, last = params.letters_per_text // params.slices, F.char_length("text") - params.letters_per_text // params.slices
    cuts = [F.substring(F.col("text"), (F.floor(last * k / max(1, params.slices - 1)) + 1).cast("int"), F.lit(width)) for k in range(params.slices)]
    piece = F.when(F.char_length("text") <= params.letters_per_text, F.col("text")).otherwise(F.concat_ws(" ", *cuts))
    some = rows.filter(F.col("h").isin(sorted({h for _, h in chosen}))).groupBy("lang", "h").agg(F.min(piece).alias("piece"))
    out: dict[str, list[str]] = {}
    for r in some.collect():
        if (r["lang"], r["h"]) in chosen:
            out.setdefault(r["lang"], []).append(r["piece"])
    return out


def identify(docs: DataFrame, sample: dict[str, list[str]], params: LangIdParams = LangIdParams(), text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` (a language of the sample; ``und`` if the
    text is null or has no letter, or if the sample is empty) and ``score``
    (0 to 1). Only the text is an input. Equal rates go to the language that
    comes first by code point. Columns of these two names are replaced."""
    frozen = tuple((k, tuple(sorted(v))) for k, v in sorted(sample.items()))
    keep = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    rows = boxed(docs, keep)
    at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(frozen, params)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                row = batch.column(0).slice(lo, 2048)
                pred = parser.predict(pc.struct_field(row, [at]).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [row, pa.array([x[0] for x in pred], pa.string()), pa.array([x[1] for x in pred], pa.float64())],
                    names=["row", "lang_pred", "score"],
                )

    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema).select("row.*", "lang_pred", "score")
