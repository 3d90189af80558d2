"""Registered queries of the training-data operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.llm import bitsliced, codebooks, fingerprints
from hindcast.llm.common import materialize, scratch_path
from hindcast.llm.langid import identify, labelled_sample
from hindcast.llm.mixing import plan_mixture
from hindcast.llm.one_bit import nearest
from hindcast.llm.packing import pack_documents
from hindcast.llm.pivot_search import exact_top_k
from hindcast.llm.rollup import TokenRollup, bpe_counter, signed_deltas
from hindcast.llm.simhash import near_duplicates
from hindcast.llm.token_files import read_token_files, write_token_files
from hindcast.llm.url_filter import filter_urls, host_of
from hindcast.llm.warc import archived_pages, to_records, write_warc

QueryFn = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: day that a page was fetched, and the list's days, as offsets from the year's first
_YEAR = "DATE '2024-01-01'"


def dated_list(pages: DataFrame) -> DataFrame:
    """Dated list entries for the hosts, directories and URLs of ``pages``:
    which are listed, from which day, and whether they are taken off after 60
    days and listed again 30 days later, follows from a digest of the key."""
    seen = pages.select(F.regexp_replace("url", "#.*$", "").alias("url"), host_of(F.col("url")).alias("host")).filter("url IS NOT NULL AND host <> ''")
    hosts = seen.select("host").distinct()
    keys = (
        hosts.select(F.lit("host").alias("kind"), F.col("host").alias("key"))
        .unionByName(hosts.select(F.lit("prefix").alias("kind"), F.concat("host", F.lit("/en/")).alias("key")))
        .unionByName(hosts.select(F.lit("domain").alias("kind"), F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("key")).filter("key <> ''").distinct())
        .unionByName(seen.select(F.lit("url").alias("kind"), F.col("url").alias("key")).distinct())
    )
    digest = F.md5(F.concat("kind", F.lit(" "), "key"))
    byte = lambda k: F.conv(F.substring("digest", k, 2), 16, 10).cast("int")
    listed = keys.withColumn("digest", digest).withColumn("v", byte(1)).withColumn("w", byte(3)).filter("v < 48")
    listed = listed.withColumn("list_id", F.when(F.col("v") % 2 == 0, "blocklist").otherwise("optout"))
    steps = F.expr(
        f"""array(named_struct('at', date_add({_YEAR}, w), 'listed', true),
                  named_struct('at', date_add({_YEAR}, w + 60), 'listed', v >= 24),
                  named_struct('at', date_add({_YEAR}, w + 90), 'listed', v < 12 OR v >= 24))"""
    )
    return listed.select("list_id", "kind", "key", F.explode(steps).alias("s")).select("list_id", "kind", "key", "s.at", "s.listed")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.expr(f"date_add({_YEAR}, CAST(page_id % 366 AS INT))").alias("fetched"))
    judged = filter_urls(captures, dated_list(pages))
    return judged.select("page_id", "url", "fetched", "blocked", "n_active", "entry.kind", "entry.key", "entry.list_id", "entry.since")


_OP1 = r"""
WITH seen AS (
  SELECT regexp_replace(url, '#.*$', '') AS url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host
  FROM pages WHERE url IS NOT NULL
),
hosts AS (SELECT DISTINCT host FROM seen WHERE host <> ''),
keys AS (
  SELECT 'host' AS kind, host AS key FROM hosts
  UNION ALL SELECT 'prefix', host || '/en/' FROM hosts
  UNION ALL SELECT DISTINCT 'domain', regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) FROM hosts WHERE regexp_matches(host, '([^.]+\.[^.]+\.[^.]+)$')
  UNION ALL SELECT DISTINCT 'url', url FROM seen WHERE host <> ''
),
digests AS (
  SELECT kind, key, ('0x' || substr(md5(kind || ' ' || key), 1, 2))::INT AS v, ('0x' || substr(md5(kind || ' ' || key), 3, 2))::INT AS w FROM keys
),
listed AS (SELECT *, CASE WHEN v % 2 = 0 THEN 'blocklist' ELSE 'optout' END AS list_id FROM digests WHERE v < 48),
spans AS (
  SELECT list_id, kind, key, DATE '2024-01-01' + w AS since, CASE WHEN v < 24 THEN DATE '2024-01-01' + (w + 60) END AS until FROM listed
  UNION ALL SELECT list_id, kind, key, DATE '2024-01-01' + (w + 90), NULL FROM listed WHERE v < 12
),
captures AS (
  SELECT page_id, url, DATE '2024-01-01' + (page_id % 366)::INT AS fetched,
    regexp_replace(url, '#.*$', '') AS plain,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages
),
hits AS (
  SELECT c.page_id, s.*, CASE s.kind WHEN 'url' THEN 1 WHEN 'prefix' THEN 2 WHEN 'host' THEN 3 ELSE 4 END AS o
  FROM captures c JOIN spans s ON s.since <= c.fetched AND (s.until IS NULL OR c.fetched < s.until) AND (
    (s.kind = 'url' AND s.key = c.plain) OR (s.kind = 'host' AND s.key = c.host)
    OR (s.kind = 'prefix' AND c.path <> '' AND starts_with(c.host || c.path, s.key))
    OR (s.kind = 'domain' AND (s.key = c.host OR ends_with(c.host, '.' || s.key))))
),
judged AS (
  SELECT *, count(*) OVER (PARTITION BY page_id) AS n, row_number() OVER (PARTITION BY page_id ORDER BY o, length(key) DESC, key, list_id, since) AS r FROM hits
)
SELECT c.page_id, c.url, c.fetched, j.page_id IS NOT NULL AS blocked, coalesce(j.n, 0) AS n_active, j.kind, j.key, j.list_id, j.since
FROM captures c LEFT JOIN judged j ON j.page_id = c.page_id AND j.r = 1
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(to_records(table(spark, sf_dir, "pages")), path)
    return archived_pages(spark, path)


_OP3 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, ''))::BIGINT AS bytes FROM pages
),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, bytes AS payload_bytes, digest AS payload_digest,
  CASE WHEN bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load of all documents, a takedown and a revision of those a digest of
    the id picks, and the takedown once more, which must change nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    turn = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1)
    state = F.struct("source", "lang", "text")
    gone = F.lit(None).cast("struct<source:string,lang:string,text:string>")
    revised = F.struct(F.lit("revised").alias("source"), "lang", F.concat(F.coalesce("text", F.lit("")), F.lit(" (revised)")).alias("text"))
    rollup = TokenRollup(spark, scratch_path(spark, "token-rollup"))
    takedown = docs.filter(turn.isin("0", "1")).select(state.alias("old"), gone.alias("new"))
    revision = docs.filter(turn.isin("2", "3")).select(state.alias("old"), revised.alias("new"))
    rollup.commit("load", signed_deltas(docs.select(gone.alias("old"), state.alias("new"))))
    rollup.commit("takedown", signed_deltas(takedown))
    rollup.commit("revision", signed_deltas(revision))
    rollup.commit("takedown", signed_deltas(takedown))
    return rollup.totals()


_OP5 = r"""
WITH d AS (
  SELECT substr(md5(doc_id::VARCHAR), 1, 1) AS turn, source, lang, coalesce(text, '') AS text FROM documents
),
now AS (
  SELECT source, lang, text FROM d WHERE turn IS NULL OR turn NOT IN ('0', '1', '2', '3')
  UNION ALL SELECT 'revised', lang, text || ' (revised)' FROM d WHERE turn IN ('2', '3')
),
counts AS (
  SELECT source, lang, 'words-1' AS tokenizer_version, len(regexp_extract_all(text, '[^ 	-
]+')) AS n FROM now
  UNION ALL
  SELECT source, lang, 'words-2', len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ 	-
]')) FROM now
)
SELECT source, lang, tokenizer_version, count(*)::BIGINT AS documents, sum(n)::BIGINT AS tokens FROM counts GROUP BY ALL
"""


def token_rollup_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the public byte-level vocabulary by source and language: half of
    the documents, a compaction, the other half, a revision that moves a source,
    and a compaction again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    state = F.struct("source", "lang", "text")
    gone = F.lit(None).cast("struct<source:string,lang:string,text:string>")
    odd = F.coalesce(F.col("doc_id") % 2 == 1, F.lit(False))
    moved = F.struct(F.lit("moved").alias("source"), "lang", "text")
    counters = {"byte_bpe_50k": bpe_counter()}
    rollup = TokenRollup(spark, scratch_path(spark, "token-rollup"))
    rollup.commit("odd", signed_deltas(docs.filter(odd).select(gone.alias("old"), state.alias("new")), counters))
    rollup.compact()
    rollup.commit("even", signed_deltas(docs.filter(~odd).select(gone.alias("old"), state.alias("new")), counters))
    rollup.commit("move", signed_deltas(docs.filter("source IS NULL").select(state.alias("old"), moved.alias("new")), counters))
    rollup.compact()
    rollup.commit("even", signed_deltas(docs.filter(~odd).select(gone.alias("old"), state.alias("new")), counters))
    return rollup.totals()


def op2_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


_OP2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.vec, c.vec) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op4_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    sample = labelled_sample(docs.filter(~F.coalesce(held_out, F.lit(False))))
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return identify(rows, sample).drop("text")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan_mixture(table(spark, sf_dir, "documents"))
    taken = (F.col("size") * F.size("places")).alias("taken")
    return planned.select("doc_id", "size", "source_size", "target", taken)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path)


def op11_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = codebooks.compress(table(spark, sf_dir, "embeddings"), keep=["vec_id", "label"])
    digest = made.codebooks.sha256() if made.codebooks else None
    rows = made.rows.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error")
    summed = codebooks.sum_over_equal(materialize(rows, "codes"), "label", "error", "label_error")
    return summed.select("vec_id", "code", "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256"))


def _op11_sql(rounds: int = 6) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
d{k} AS MATERIALIZED (SELECT r, p, e, sum((x - y) * (x - y)) AS d FROM l JOIN c{k} USING (p, j) GROUP BY r, p, e),
a{k} AS MATERIALIZED (SELECT r, p, min(d * 16 + e) % 16 AS e, min(d * 16 + e) // 16 AS d FROM d{k} GROUP BY r, p)""")
        if k < rounds:
            steps.append(f"""
s{k} AS (SELECT p, e, j, sum(x) AS s, count(*) AS n FROM l JOIN a{k} USING (r, p) GROUP BY p, e, j),
c{k + 1} AS MATERIALIZED (SELECT p, e, j, coalesce((s - ((s % n) + n) % n) // n, y) AS y FROM c{k} LEFT JOIN s{k} USING (p, e, j))""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
u AS (SELECT r, unnest(embedding) AS c, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) // 8 AS width FROM v),
l AS MATERIALIZED (SELECT r, i // width AS p, i % width AS j, floor(4096 * c::DOUBLE)::BIGINT AS x FROM u),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, j, x AS y FROM l WHERE r <= 16),{",".join(steps)},
codes AS (SELECT r, string_agg(printf('%02x', e::INTEGER), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r),
book AS (SELECT sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY p, e, j)) AS digest FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256
FROM v JOIN codes USING (r) CROSS JOIN book
"""


def op12_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = bitsliced.build_index(table(spark, sf_dir, "documents"))
    return bitsliced.search(index, table(spark, sf_dir, "benchmark"))


_OP12 = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
),
g AS (SELECT count(*) AS n_docs, sum(len(t)) AS n_terms FROM d WHERE len(t) > 0),
tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, g GROUP BY term, n_docs),
m AS (SELECT r, doc_id, 75 + (25 * len(t) * n_docs) // n_terms AS m FROM d, g),
q AS (
  SELECT i, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS i, item_id,
      unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL
),
s AS (
  SELECT i, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def op13_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints and likenesses, and from the block tables ``n_near``
    and ``near_id``: how many documents have a fingerprint within 3 of the
    128 bits, and the smallest id among them (their own included)."""
    judged = materialize(fingerprints.edited_fingerprints(table(spark, sf_dir, "documents")), "judged")
    words, edited = fingerprints.word_names("fp", fingerprints.BITS), fingerprints.word_names("edited", fingerprints.BITS)
    near = fingerprints.near_counts(judged, words)
    return judged.join(near, words).select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.hex_of(words).alias("fingerprint"), fingerprints.hex_of(edited).alias("edited_fingerprint"),
        "near_edited", "near_next", "n_near", "near_id",
    )


QUERIES: dict[str, QueryFn] = {
    "op1_url_filter": op1_url_filter,
    "op2_pivot_top_k": op2_pivot_top_k,
    "op3_warc": op3_warc,
    "op4_one_bit_neighbours": op4_one_bit_neighbours,
    "op5_token_rollup": op5_token_rollup,
    "op6_language_id": op6_language_id,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_mix_sources": op9_mix_sources,
    "op10_token_files": op10_token_files,
    "op11_code_compression": op11_code_compression,
    "op12_bit_sliced_search": op12_bit_sliced_search,
    "op13_simhash_fingerprints": op13_simhash_fingerprints,
    "token_rollup_bpe": token_rollup_bpe,
}

SQL: dict[str, str] = {
    "op1_url_filter": _OP1,
    "op2_pivot_top_k": _OP2,
    "op3_warc": _OP3,
    "op5_token_rollup": _OP5,
    "op11_code_compression": _op11_sql(),
    "op12_bit_sliced_search": _OP12,
}
