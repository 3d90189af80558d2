"""URL filters by a temporal list join.

List entries are dated: each adds a key to a list or takes it off. They become
validity intervals ``[since, until)`` per list, kind and key, and every capture
is held, as of its fetch time, against the entries active then. A URL has few
kinds of keys: itself, the directories of its path, its host and the domains
above it. Directories and domains are not written out: one pass over the path,
and one over the reversed host, digests every one of them as it grows, so a
URL's keys take space in proportion to its length. Digests join with the
list's, and what meets is held against the key itself. A key with many captures
is a skewed partition of the capture side only, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hindcast.llm.common import columns_of, free_name

#: kinds of entries, the most specific first
KINDS = ("url", "prefix", "host", "domain")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """Host in lower case; an empty string if there is none."""
    return F.lower(F.regexp_extract(url, HOST, 1))


#: as Spark's xxhash64
_SEED = 42
_FLUSH = 1 << 16


def plain_url(url: Column) -> Column:
    """The URL without its fragment."""
    return F.regexp_replace(url, "#.*$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _steps(text: str, stop: str) -> Iterator[int]:
    """Digests of the text's beginnings up to every ``stop``, which is
    included; one pass."""
    running = xxhash.xxh64(seed=_SEED)
    at = 0
    while (end := text.find(stop, at)) >= 0:
        running.update(text[at : end + 1].encode("utf-8"))
        yield running.intdigest()
        at = end + 1


def key_digests(plain: str, host: str, path: str) -> Iterator[tuple[int, int]]:
    """``(kind, digest)`` of every key of a URL: kinds by their place in
    :data:`KINDS`, domains digested from their last letter on."""
    digest = xxhash.xxh64_intdigest
    if plain:
        yield 0, digest(plain.encode("utf-8"), _SEED)
    if path:
        cut = path.rfind("/") + 1
        yield from ((1, d) for d in _steps(host + path[:cut], "/"))
    if host:
        yield 2, digest(host.encode("utf-8"), _SEED)
        running, at, back = xxhash.xxh64(seed=_SEED), 0, host[::-1]
        # every domain from the last label up: its reversal is a beginning of the reversed host
        while at <= len(back):
            end = back.find(".", at)
            end = len(back) if end < 0 else end
            running.update(back[at:end].encode("utf-8"))
            if end:
                yield 3, running.intdigest()
            running.update(b".")
            at = end + 1


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out():
        return pa.RecordBatch.from_pydict({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64()), "o": pa.array(kinds, pa.int32()), "d": pa.array(found, pa.int64())})

    us, vs, kinds, found = [], [], [], []
    for batch in batches:
        for u, v, plain, host, path in zip(*(c.to_pylist() for c in batch.columns)):
            for kind, d in key_digests(plain, host, path):
                us.append(u)
                vs.append(v)
                kinds.append(kind)
                found.append(_signed(d))
                if len(us) >= _FLUSH:
                    yield out()
                    us, vs, kinds, found = [], [], [], []
    if us:
        yield out()


def url_entries(urls: DataFrame, spans: DataFrame) -> DataFrame:
    """``(u, v)`` of every URL, two hashes that name it, with the listed
    intervals of its keys. ``urls`` has ``u``, ``v`` and ``url``."""
    known = F.array(*[F.lit(k) for k in KINDS])
    whole = F.when(F.col("kind") == "domain", F.reverse("key")).otherwise(F.col("key"))
    listed = spans.filter(F.col("kind").isin(*KINDS) & (F.col("key") != "")).withColumn("o", (F.array_position(known, F.col("kind")) - 1).cast("int"))
    listed = listed.withColumn("d", F.xxhash64(whole))
    parts = urls.select("u", "v", plain_url(F.col("url")).alias("plain"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    met = parts.mapInArrow(_digest_rows, "u long, v long, o int, d long").join(listed, ["o", "d"]).drop("d")
    # what met by digest is held against the key
    met = met.join(parts.withColumnsRenamed({"u": "u2", "v": "v2"}), (F.col("u") == F.col("u2")) & (F.col("v") == F.col("v2")))
    same = (
        F.when(F.col("o") == 0, F.col("key") == F.col("plain"))
        .when(F.col("o") == 1, F.endswith("key", F.lit("/")) & F.startswith(F.concat("host", "path"), F.col("key")))
        .when(F.col("o") == 2, F.col("key") == F.col("host"))
        .otherwise((F.col("key") == F.col("host")) | F.endswith("host", F.concat(F.lit("."), F.col("key"))))
    )
    return met.filter(same).select("u", "v", "list_id", "kind", "key", "since", "until", "o")


def intervals(entries: DataFrame) -> DataFrame:
    """``(list_id, kind, key, since, until)`` from ``(list_id, kind, key, at,
    listed)``: the stretches in which a key is listed; ``until`` is null while
    nothing ends it. Of entries at one time an addition outweighs a removal;
    repeats change nothing. Entries with a null key, kind, time or state are
    ignored."""
    fine = F.col("kind").isNotNull() & F.col("key").isNotNull() & F.col("at").isNotNull() & F.col("listed").isNotNull()
    states = entries.filter(fine).groupBy("list_id", "kind", "key", "at").agg(F.max("listed").alias("listed"))
    w = Window.partitionBy("list_id", "kind", "key").orderBy("at")
    turns = states.withColumn("was", F.lag("listed", 1, False).over(w)).filter(F.col("listed") != F.col("was"))
    spans = turns.withColumn("until", F.lead("at").over(w)).filter("listed")
    return spans.select("list_id", "kind", "key", F.col("at").alias("since"), "until")


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """Every row of ``captures`` with ``blocked``, ``n_active`` (entries that
    match the URL and are active at its fetch time) and ``entry``, the
    deciding one: ``(kind, key, list_id, since)`` of the most specific kind,
    then by the longest key, key, list and date.

    URLs may be of any length: a URL costs time and rows in proportion to it.
    A null URL or fetch time matches nothing. Repeated rows are judged alike
    and all stay; an empty list blocks nothing. Columns named as the three
    results are replaced."""
    keep = [c for c in captures.columns if c.lower() not in ("blocked", "n_active", "entry")]
    base = captures.select(*columns_of(keep))
    u, v, t, n, c = (free_name(base, x) for x in ("hit_u", "hit_v", "hit_t", "hit_n", "hit_c"))
    name_of = lambda url: (F.xxhash64(url), F.xxhash64(F.lit(1), url))
    asked = base.select(F.col(url_col).alias("url"), F.col(time_col).alias("t")).filter("url IS NOT NULL AND t IS NOT NULL")
    first, second = name_of(F.col("url"))
    urls = asked.groupBy(first.alias("u"), second.alias("v")).agg(F.min("url").alias("url"))
    times = asked.select(first.alias("u"), second.alias("v"), "t").distinct()
    active = (F.col("t") >= F.col("since")) & (F.col("until").isNull() | (F.col("t") < F.col("until")))
    hits = times.join(url_entries(urls, intervals(entries)), ["u", "v"]).filter(active)
    choice = F.struct("o", (-F.length("key")).alias("l"), "key", "list_id", "since", "kind")
    judged = hits.groupBy("u", "v", "t").agg(F.count("*").alias("n"), F.min(choice).alias("c"))
    judged = judged.withColumnsRenamed({"u": u, "v": v, "t": t, "n": n, "c": c})
    mine = name_of(F.col(url_col))
    out = base.join(judged, (mine[0] == F.col(u)) & (mine[1] == F.col(v)) & (F.col(time_col) == F.col(t)), "left")
    entry = F.when(F.col(n).isNotNull(), F.struct(*[F.col(f"{c}.{x}").alias(x) for x in ("kind", "key", "list_id", "since")]))
    return out.select(*columns_of(keep), F.col(n).isNotNull().alias("blocked"), F.coalesce(F.col(n), F.lit(0)).alias("n_active"), entry.alias("entry"))
