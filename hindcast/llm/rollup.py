"""Token counts as delta-maintained rollups.

A change feed of inserted, deleted and revised documents becomes signed rows:
what a document counted before goes out with a minus, what it counts now comes
in with a plus. A batch is summed by source, language and tokenizer version
and published under its id; totals are the sums over all published batches,
so they are exact whatever order batches come in. Publishing creates one
marker file that must not exist yet: a batch that is sent again, by a retry or
a second driver, changes nothing. Compaction adds the batches since the last one
to its sums and publishes them as the next snapshot, again by one file that must
not exist yet. It names the batches it has taken in; their markers move aside,
where they still tell a batch that is sent again.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.llm.common import WORD

KEYS = ("source", "lang", "tokenizer_version")
SUMS = ("documents", "tokens")
TABLE = "source string, lang string, tokenizer_version string, documents long, tokens long"
Counter = Callable[[Column], Column]


def pattern_counter(pattern: str) -> Counter:
    """Counts the matches of a pattern; a null text has none."""
    return lambda text: F.coalesce(F.regexp_count(text, F.lit(pattern)).cast("long"), F.lit(0).cast("long"))


#: words, and words or single signs
WORDS_1 = WORD
WORDS_2 = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\x20\x09-\x0D]"
WORD_COUNTERS: dict[str, Counter] = {"words-1": pattern_counter(WORDS_1), "words-2": pattern_counter(WORDS_2)}


def bpe_counter(path: str | None = None) -> Counter:
    """Counts the ids of a public byte-level BPE vocabulary."""
    import pandas as pd
    import pyarrow as pa

    from hindcast.llm.bpe import encoder, public_tokenizer

    vocabulary = path or public_tokenizer()

    def count(text):
        return pd.Series([len(i) for i in encoder(vocabulary).encode(pa.array(text, pa.string()))], dtype="int64")

    count.__annotations__ = {"text": pd.Series, "return": pd.Series}  # the classes themselves, not their names
    return F.pandas_udf(count, "long")


def signed_deltas(changes: DataFrame, counters: dict[str, Counter] = WORD_COUNTERS) -> DataFrame:
    """Signed sums by :data:`KEYS` of a change feed with ``old`` and ``new``,
    structs of ``(source, lang, text)``: an insert has a null ``old``, a
    delete a null ``new``, a revision both (source and language may change as
    well). A change without either is ignored; null sources and languages are
    keys of their own; a null text is a document of no tokens. Sums that
    cancel out are left out."""
    side = lambda sign, c: F.struct(F.lit(sign).cast("long").alias("sign"), F.col(c).alias("doc"))
    rows = changes.select(F.explode(F.array(side(-1, "old"), side(1, "new"))).alias("s")).filter("s.doc IS NOT NULL")
    rows = rows.select("s.sign", F.col("s.doc.source").cast("string").alias("source"), F.col("s.doc.lang").cast("string").alias("lang"), F.col("s.doc.text").alias("text"))
    counts = [F.sum(F.col("sign") * count(F.col("text"))).alias(f"n{k}") for k, count in enumerate(counters.values())]
    sums = rows.groupBy("source", "lang").agg(F.sum("sign").alias("documents"), *counts)
    by_version = F.array(*[F.struct(F.lit(v).alias("tokenizer_version"), F.col(f"n{k}").alias("tokens")) for k, v in enumerate(counters)])
    out = sums.select("source", "lang", "documents", F.explode(by_version).alias("v"))
    return out.select("source", "lang", "v.tokenizer_version", "documents", "v.tokens").filter("documents <> 0 OR tokens <> 0")


class TokenRollup:
    """A rollup in a folder of any file system that Spark writes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _marker(self, batch_id: str, folder: str = "_commits") -> str:
        return f"{self.path}/{folder}/{hashlib.sha256(batch_id.encode()).hexdigest()}.json"

    def _put(self, file: str, content: dict) -> bool:
        """Create a file that must not exist; False if it does. An empty one,
        left by a driver that died in between, is replaced."""
        if self._fs.exists(self._path(file)) and not self._fs.getFileStatus(self._path(file)).getLen():
            self._fs.delete(self._path(file), False)
        try:
            out = self._fs.create(self._path(file), False)
        except Exception:
            if self._fs.exists(self._path(file)):
                return False
            raise
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        return True

    def committed(self, batch_id: str) -> bool:
        for folder in ("_commits", "_folded", "_commits"):  # a marker may move between two looks
            file = self._path(self._marker(batch_id, folder))
            if self._fs.exists(file) and self._fs.getFileStatus(file).getLen() > 0:
                return True
        return False

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Add ``deltas`` (columns of :data:`TABLE`) once under ``batch_id``.
        False, and no change, if that id has been committed before."""
        if self.committed(batch_id):
            return False
        data = f"data/{uuid.uuid4().hex}"
        sums = deltas.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS])
        sums.write.parquet(f"{self.path}/{data}")
        if self._put(self._marker(batch_id), {"batch": batch_id, "data": data}):
            return True
        self._fs.delete(self._path(f"{self.path}/{data}"), True)
        return False

    def batches(self) -> dict[str, str]:
        """Ids of the batches committed since the last compaction and the
        folders of their sums."""
        taken = set(self._snapshot()["folded"])
        return {b: d for b, d in self._marked().items() if b not in taken}

    def _marked(self) -> dict[str, str]:
        folder = self._path(f"{self.path}/_commits")
        if not self._fs.exists(folder) or not len(self._fs.listStatus(folder)):
            return {}
        text = self.spark.read.text(f"{self.path}/_commits/*.json", wholetext=True)
        found = (json.loads(r["value"]) for r in text.collect() if r["value"])  # a line per batch since the last compaction
        return {x["batch"]: x["data"] for x in found}

    def _snapshot(self) -> dict:
        """The last published one: its number, data and the batches it took in."""
        folder = self._path(f"{self.path}/_snapshots")
        names = sorted(f.getPath().getName() for f in self._fs.listStatus(folder) if f.getLen()) if self._fs.exists(folder) else []
        if not names:
            return {"number": 0, "data": None, "folded": []}
        return json.loads(self.spark.read.text(f"{self.path}/_snapshots/{names[-1]}", wholetext=True).first()["value"])

    def _set_aside(self, snapshot: dict) -> None:
        """Move the markers of batches that a snapshot holds. Safe to repeat."""
        self._fs.mkdirs(self._path(f"{self.path}/_folded"))
        for batch in snapshot["folded"]:
            marker = self._path(self._marker(batch))
            if self._fs.exists(marker):
                self._fs.rename(marker, self._path(self._marker(batch, "_folded")))

    def compact(self) -> bool:
        """Fold the batches since the last compaction into one table of sums, so
        that totals read it and what came after. False if there is nothing to
        fold or another driver was first. Totals do not change; a batch that is
        sent again still changes nothing."""
        last = self._snapshot()
        self._set_aside(last)  # what a driver that died may have left
        folded = self.batches()
        if not folded:
            return False
        data = f"data/{uuid.uuid4().hex}"
        self._sums(last, folded).write.parquet(f"{self.path}/{data}")
        number = last["number"] + 1
        new = {"number": number, "data": data, "folded": sorted(folded)}
        if not self._put(f"{self.path}/_snapshots/{number:012d}.json", new):
            self._fs.delete(self._path(f"{self.path}/{data}"), True)
            return False
        self._set_aside(new)
        return True

    def _sums(self, snapshot: dict, batches: dict[str, str]) -> DataFrame:
        folders = sorted({*batches.values(), *([snapshot["data"]] if snapshot["data"] else [])})
        if not folders:
            return self.spark.createDataFrame([], TABLE)
        rows = self.spark.read.schema(TABLE).parquet(*[f"{self.path}/{d}" for d in folders])
        sums = rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        return sums.filter("documents <> 0 OR tokens <> 0")

    def totals(self) -> DataFrame:
        """Sums over all committed batches; keys whose documents and tokens
        have gone back to zero are left out. Empty before the first batch."""
        while True:
            last = self._snapshot()
            batches = {b: d for b, d in self._marked().items() if b not in set(last["folded"])}
            if self._snapshot()["number"] == last["number"]:  # no compaction in between
                return self._sums(last, batches)
