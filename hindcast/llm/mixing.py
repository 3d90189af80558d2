"""Mixing sources to target weights with a multivariate-hypergeometric
splitting tree.

Every source's documents fall into blocks by a hash, the more of them the
larger the source is, so that a block stays a small part of an output shard and
each shard gets many draws at any size. A source whose target is
``q`` times its size draws each block ``floor(q)`` times and, in a permuted
order of blocks, once more until the rest is reached; the block in which that
happens gives the documents of a permuted order up to the point nearest the
target. The drawn blocks of all sources are dealt to output shards by a binary
tree over the shards: at a node the draws that go to the left half are a
multivariate hypergeometric sample of the node's draws, so that leaves hold
exact integer quotas that add up over each source. A source's permuted draws
are then cut into runs of those lengths, which are disjoint, and every shard
is shuffled on its own. A node's random numbers depend on the seed and the
node alone, so each leaf walks its path from the root without the others.

A table of a row per block describes the whole plan. It grows with the words,
so nothing orders a source's blocks in one task, and beyond ``broadcast_bytes``
it is joined by key. Texts are read once for sizes and hashes and once to look
their block up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hindcast.llm.common import WORD, columns_of, free_name, materialize


@dataclass(frozen=True)
class MixParams:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)  # of the sources by code point, null last, repeating
    share: float = 1.5  # of all sizes
    most: float = 2.0  # times its size that a source may give
    blocks: int = 1024  # of a source, at least
    shard_size: int = 1 << 20  # words of an output shard
    shard_draws: int = 256  # blocks that a shard holds: sources are cut finer where theirs would be larger
    seed: int = 29
    shards: int = 1 << 21  # at most: beyond, shards hold more words
    #: block tables of up to so many bytes are broadcast; larger ones are joined by key
    broadcast_bytes: int = 16 << 20


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """``(source, source_size)``, one row per source, with ``target``: the
    weighted share of ``params.share`` times all sizes; what a source's cap
    ``most * source_size`` leaves over is shared again by weight until none is
    above. One row per source is ranked in one task."""
    w = F.array(*[F.lit(float(x)) for x in params.weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("n", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(w, F.col("n") % len(params.weights) + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(params.most)))
    ranked = ranked.withColumn("tight", F.col("cap") / F.col("weight"))
    # sources reach their caps in the order of cap / weight; the level is what the others get per weight
    upto = Window.orderBy("tight", "n").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("tight", "n").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    budget = total * F.lit(float(params.share))
    level = (budget - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(rest)
    capped = ranked.withColumn("level", level).withColumn("is_capped", F.col("tight") <= F.col("level"))
    # from the first source below its cap on, its level holds for all that follow
    cut = F.min(F.when(~F.col("is_capped"), F.struct("tight", "n", "level"))).over(Window.partitionBy())
    out = capped.withColumn("cut", cut)
    free = F.col("cut").isNotNull() & ~(F.struct("tight", "n") < F.struct("cut.tight", "cut.n"))
    target = F.when(free, F.col("weight") * F.col("cut.level")).otherwise(F.col("cap"))
    return out.select("source", "source_size", F.least(target, F.col("cap")).alias("target"))


def shard_quotas(draws: np.ndarray, shards: int, shard: int, seed: int) -> np.ndarray:
    """Draws of every source that go to ``shard``."""
    return shard_runs(draws, shards, shard, seed)[1]


def shard_runs(draws: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every source, the draws that go to shards before ``shard`` and those
    that go to it: the walk from the root of the splitting tree to that leaf.
    numpy raises an error from 10^9 draws on."""
    left = draws.astype(np.int64)
    before = np.zeros_like(left)
    lo, hi = 0, shards
    total = int(left.sum())

    def upto(k: int) -> int:
        return total * k // shards

    while hi - lo > 1:
        mid = (lo + hi) // 2
        take = upto(mid) - upto(lo)
        rng = np.random.default_rng([seed, lo, hi])
        part = _hypergeometric(left, take, rng)
        if shard < mid:
            left, hi = part, mid
        else:
            left, lo, before = left - part, mid, before + part
    return before, left


#: numpy draws from urns of fewer than so many
_NUMPY_URN = 10**9


def _hypergeometric(colours: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each colour are among ``take`` drawn from an urn without
    putting back."""
    if not take or not len(colours):
        return np.zeros_like(colours)
    if int(colours.sum()) < _NUMPY_URN:
        return rng.multivariate_hypergeometric(colours, take, method="marginals")
    out = np.zeros_like(colours)
    rest = int(colours.sum())
    for k, n in enumerate(colours.tolist()):
        rest -= n
        out[k] = hypergeometric(n, rest, take, rng)
        take -= int(out[k])
    return out


def _stirling_error(n: float) -> float:
    """``ln n! - ln(sqrt(2 pi n) (n / e)^n)``."""
    if n < 16:
        return math.lgamma(n + 1) - (0.5 * math.log(2 * math.pi * n) + n * math.log(n) - n) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n**2) / n**2) / n**2) / n


def _deviance(x: float, mean: float) -> float:
    """``x ln(x / mean) + mean - x`` without cancellation."""
    if x <= 0:
        return mean
    d = (x - mean) / (x + mean)
    if abs(d) >= 0.1:
        return x * math.log(x / mean) + mean - x
    # ln(x / mean) = 2 artanh(d)
    total, power, k = (x - mean) * d, 2 * x * d, 1
    while True:
        power *= d * d
        more = total + power / (2 * k + 1)
        if more == total:
            return total
        total, k = more, k + 1


def _log_binomial(x: int, n: int, p: float) -> float:
    """Logarithm of the binomial probability, by deviances, so that it keeps
    its precision for any ``n``."""
    if x == 0:
        return n * math.log1p(-p)
    if x == n:
        return n * math.log(p)
    spread = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x) - _deviance(x, n * p) - _deviance(n - x, n * (1 - p))
    return spread + 0.5 * (math.log(n) - math.log(2 * math.pi) - math.log(x) - math.log(n - x))


def hypergeometric(good: int, bad: int, take: int, rng: np.random.Generator) -> int:
    """A hypergeometric number for an urn of any size, by ratio of uniforms
    around the mode (the table-mountain hat of Stadlober, 1990)."""
    if not good or not take:
        return 0
    if not bad or take == good + bad:
        return min(good, take)
    if good + bad < _NUMPY_URN:
        return int(rng.hypergeometric(good, bad, take))
    whole = good + bad
    # the smaller colour in the smaller of the two halves
    few, few_take = min(good, bad), min(take, whole - take)
    p = few_take / whole
    mean = few_take * (few / whole)
    spread = math.sqrt((whole - few_take) / (whole - 1) * mean * (1 - few / whole) + 0.5)
    hat = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    least, most = max(0, few_take - (whole - few)), min(few, few_take)

    def log_odds(x: int) -> float:
        return _log_binomial(x, few, p) + _log_binomial(few_take - x, whole - few, p)

    top = log_odds(min(max((few_take + 1) * (few + 1) // (whole + 2), least), most))
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        x = math.floor(mean + 0.5 + hat * (v - 0.5) / u)
        if least <= x <= most and 2 * math.log(u) <= log_odds(x) - top:
            break
    if few_take != take:
        x = few - x
    return x if few == good else take - x


def plan_mixture(docs: DataFrame, params: MixParams = MixParams(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with five more columns: ``size`` (words), ``source_size``,
    ``target`` (of its source), and ``places``, an array of ``(shard, key)``,
    one for each time the mixture takes the document (possibly none). Columns
    of these names are replaced.

    Null sources are one source, ranked last. A null or empty text has size 0; a
    source without any words has target 0 and gives nothing.
    Rows that agree in id and text fall together. An empty table gives an
    empty result. The plan depends on the rows and the seed alone, so reruns
    agree."""
    p = params
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "places")]
    base = docs.select(*columns_of(keep))
    h = F.xxhash64(F.lit(p.seed), F.col(id_col), F.col(text_col))
    src, hash_, cuts_, block = (free_name(base, n) for n in ("mix_source", "mix_hash", "mix_blocks", "mix_block"))
    sized = base.withColumn("size", word_count(F.col(text_col))).withColumn(src, F.col(source_col).cast("string"))
    sized = sized.withColumn(hash_, h)

    # a short row per document
    narrow = materialize(sized.select(F.col(src).alias("source"), F.col(hash_).alias("h"), "size"), "sizes")
    targets = source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), p)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("copies", F.least(copies, F.lit(int(p.most))).cast("int"))
    targets = targets.withColumn("rest", F.greatest(F.col("target") - F.col("copies") * F.col("source_size"), F.lit(0.0)))
    asked = targets.agg(F.sum("target")).first()[0] or 0.0
    shard_size = max(p.shard_size, math.ceil(asked / p.shards))
    finer = F.ceil(F.col("source_size") / F.lit(max(1, shard_size // p.shard_draws)))
    targets = materialize(targets.withColumn("cuts", F.greatest(finer, F.lit(p.blocks)).cast("long")), "targets")

    # few sources are large enough for more blocks than all have at least
    large = _small(targets.filter(F.col("cuts") > p.blocks).select(F.col("source").alias("large_source"), "cuts"), p)

    def block_of(rows: DataFrame, source: str, hashed: str, cuts: str, name: str) -> DataFrame:
        fine = large.withColumnsRenamed({"large_source": free_name(rows, "large_source"), "cuts": cuts})
        out = rows.join(fine, rows[source].eqNullSafe(fine[fine.columns[0]]), "left").drop(fine.columns[0])
        return out.withColumn(name, F.pmod(F.col(hashed), F.coalesce(F.col(cuts), F.lit(p.blocks).cast("long")))).drop(cuts)

    sized = block_of(sized, src, hash_, cuts_, block)
    narrow = block_of(narrow, "source", "h", "cuts", "block")
    blocks = materialize(narrow.groupBy("source", "block").agg(F.sum("size").alias("words"), F.count("*").alias("docs")), "blocks")

    each = _small(targets, p).withColumnRenamed("source", "s")
    drawn = blocks.join(each, blocks["source"].eqNullSafe(each["s"])).select("source", "block", "words", "source_size", "target", "copies", "rest", "cuts")
    drawn = drawn.withColumn("turn", F.xxhash64(F.lit(p.seed + 1), "source", "block"))
    drawn = _running(drawn, F.col("words"), "upto", "block")
    drawn = drawn.withColumn("before", F.col("upto") - F.col("words"))
    whole = (F.col("rest") > 0) & (F.col("upto") <= F.col("rest"))
    cut_here = ~whole & (F.col("before") < F.col("rest"))
    drawn = drawn.withColumn("whole", whole).withColumn("open", F.when(cut_here, F.col("rest") - F.col("before")))
    drawn = materialize(drawn, "drawn")

    # the one block of a source that gives a part: documents in hash order up to the point nearest the target
    ends = _small(drawn.filter(F.col("open").isNotNull()).select(F.col("source").alias("s"), F.col("block").alias("b"), "open"), p)
    inside = narrow.join(ends, narrow["source"].eqNullSafe(ends["s"]) & (narrow["block"] == ends["b"]))
    inside = inside.select("source", "block", "h", "size", "open")
    run = Window.partitionBy("source", "block").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.sum("size").over(run))
    fits = F.col("upto") - F.col("size") / 2.0 <= F.col("open")
    last = inside.groupBy("source", "block").agg(F.max(F.when(fits, F.col("h"))).alias("last"))

    # each drawn block, once per copy, gets its place among its source's permuted draws
    extra = F.when(F.col("whole") | F.col("open").isNotNull(), 1).otherwise(0)
    times = drawn.withColumn("times", F.col("copies") + extra).filter("times > 0")
    times = times.select("source", "block", "cuts", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    times = times.withColumn("turn", F.xxhash64(F.lit(p.seed + 2), "source", "block", "copy"))
    times = _running(times, F.lit(1).cast("long"), "rank", "block", "copy")
    times = materialize(times.select("source", "block", "copy", (F.col("rank") - 1).alias("rank")), "draws")

    counts = times.groupBy("source").agg(F.count("*").alias("draws")).orderBy("source").collect()  # a row per source
    shards = max(1, math.ceil(asked / shard_size))
    names = [r["source"] for r in counts]
    draws = np.array([r["draws"] for r in counts], dtype=np.int64)
    seed = p.seed

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                first, quota = shard_runs(draws, shards, shard, seed)
                hit = np.flatnonzero(quota)
                cols = [pa.array([shard] * len(hit), pa.int32()), pa.array([names[k] for k in hit], pa.string()), pa.array(first[hit]), pa.array(quota[hit])]
                yield pa.RecordBatch.from_arrays(cols, names=["shard", "s", "first", "quota"])

    quotas = spark.range(shards).repartition(max(1, min(shards, 200))).mapInArrow(leaves, "shard int, s string, first long, quota long")
    runs = quotas.select("s", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("quota") - 1)).alias("r"))
    dealt = times.join(runs, times["source"].eqNullSafe(runs["s"]) & (times["rank"] == runs["r"]))
    per_block = dealt.groupBy("source", "block").agg(F.collect_list(F.struct("copy", "shard")).alias("dealt"))

    plan = drawn.join(per_block, drawn["source"].eqNullSafe(per_block["source"]) & (drawn["block"] == per_block["block"]), "left")
    plan = plan.join(last, drawn["source"].eqNullSafe(last["source"]) & (drawn["block"] == last["block"]), "left")
    plan = plan.select(drawn["source"].alias("s"), drawn["block"].alias("b"), "source_size", "target", "copies", F.col("open").isNotNull().alias("part"), "last", "dealt")
    plan = materialize(plan, "plan")
    part, cut, deal, full = (free_name(base, n) for n in ("mix_part", "mix_last", "mix_dealt", "mix_copies"))
    plan = plan.withColumnsRenamed({"part": part, "last": cut, "dealt": deal, "copies": full})
    s, b = free_name(sized, "mix_s"), free_name(sized, "mix_b")
    plan = plan.withColumnsRenamed({"s": s, "b": b})
    out = sized.join(_small(plan, p), sized[src].eqNullSafe(plan[s]) & (sized[block] == plan[b]), "left")
    # a block's last copy is its partial one where it has one
    taken = F.filter(
        F.coalesce(F.col(deal), F.array().cast("array<struct<copy:int,shard:int>>")),
        lambda x: (x["copy"] <= F.col(full)) | ~F.col(part) | (F.col(hash_) <= F.col(cut)),
    )
    places = F.transform(
        F.array_sort(taken),
        lambda x: F.struct(x["shard"].alias("shard"), F.xxhash64(F.lit(p.seed + 3), x["shard"], x["copy"], F.col(hash_)).alias("key")),
    )
    return out.select(*columns_of(keep), "size", "source_size", "target", places.alias("places"))


def _running(rows: DataFrame, value: Column, name: str, *ties: str) -> DataFrame:
    """``rows`` with column ``name``: the sum of ``value`` over the rows of
    their source up to them, in an order that the hash ``turn`` permutes. A
    source's rows are ordered in piles, about the square root of its blocks
    many, so that no task orders them all."""
    rows = rows.withColumn("pile", F.pmod(F.col("turn"), F.ceil(F.sqrt(F.col("cuts"))))).withColumn("value", value)
    piles = rows.groupBy("source", "pile").agg(F.sum("value").alias("held"))
    upto = F.sum("held").over(Window.partitionBy("source").orderBy("pile"))
    piles = piles.select(F.col("source").alias("s"), F.col("pile").alias("p"), (upto - F.col("held")).alias("past"))
    run = Window.partitionBy("source", "pile").orderBy("turn", *ties).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(name, F.sum("value").over(run))
    rows = rows.join(piles, rows["source"].eqNullSafe(piles["s"]) & (rows["pile"] == piles["p"]))
    return rows.withColumn(name, F.col(name) + F.col("past")).drop("s", "p", "past", "pile", "value")


def _small(table: DataFrame, p: MixParams) -> DataFrame:
    """A table broadcast only if its rows are few by their bytes: eight for a
    value and, for what varies, its length besides."""
    width = F.lit(16 * len(table.columns)).cast("long")
    for name, kind in table.dtypes:
        if kind == "string":
            width = width + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith("array"):
            width = width + F.greatest(F.size(name), F.lit(0)) * 32
    size = table.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(table) if size <= p.broadcast_bytes else table


def mixture(docs: DataFrame, params: MixParams = MixParams(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixture itself: the rows of ``docs``, each as often as it is taken,
    dealt to their shards (one partition each) in a shuffled order. Rows that
    agree in id and text are taken alike, each as often as the plan says; null
    sources are one source; an empty table gives an empty mixture. All columns
    are kept as they are, whatever they are called."""
    planned = plan_mixture(docs, params, id_col, source_col, text_col)
    names = [c for c in planned.columns if c not in ("size", "source_size", "target", "places")]
    place, shard, key = (free_name(planned, n) for n in ("mix_place", "mix_shard", "mix_key"))
    rows = planned.select(*columns_of(names), F.explode("places").alias(place))
    rows = rows.select(*columns_of(names), F.col(f"{place}.shard").alias(shard), F.col(f"{place}.key").alias(key))
    rows = rows.repartition(F.col(shard)).sortWithinPartitions(shard, key)
    return rows.select(*columns_of(names))
