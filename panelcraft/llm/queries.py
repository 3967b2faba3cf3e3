"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcraft.llm import decontaminate, importance, licenses, mixing, ngram_join, packing, perplexity, sharding, spelling, token_counts, toxicity, url_filter, vector_topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _number(text):
    """A whole number from a text, the same in both engines."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("int")


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as captures: fetched on a day of 2024 given by the page's id."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched"))


def dated_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List entries about the crawl's own hosts: some domains are blocked, cleared and blocked again,
    some sections are allowed or blocked for good."""
    pages = crawl(spark, sf_dir).select(url_filter.host(F.col("url")).alias("h"), url_filter.path_parts(F.col("url"), 1).alias("p"))
    sites = pages.select(F.expr("array_join(slice(split(h, '[.]'), -3, 3), '.')").alias("pattern")).where("size(split(pattern, '[.]')) = 3")
    sections = pages.where("size(p) > 0").select(F.concat_ws("/", "h", F.expr("p[0]")).alias("pattern"))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), (n % 200).cast("int"))
    n = _number(F.col("pattern"))
    turns = F.explode(F.from_json(F.lit('[{"k":0,"a":"block"},{"k":60,"a":"remove"},{"k":150,"a":"block"}]'), "array<struct<k:int,a:string>>"))
    domains = sites.distinct().where(n % 3 == 0).select("pattern", day(n).alias("d"), turns.alias("t"))
    domains = domains.select("pattern", F.expr("date_add(d, t.k)").alias("day"), F.col("t.a").alias("action"))
    parts = sections.distinct().where(n % 4 < 2).select("pattern", day(n).alias("day"), F.when(n % 4 == 0, "allow").otherwise("block").alias("action"))
    return domains.unionByName(parts)


@query
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the list entries in force on the day it was fetched."""
    return url_filter.evaluate(crawl(spark, sf_dir), dated_list(spark, sf_dir))


ORACLE["op1_url_filters"] = r"""
WITH captures AS (
  SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '[.]$', '') AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '/'), lambda p: p <> '') AS parts,
         DATE '2024-01-01' + (page_id % 366)::INT AS day
  FROM pages
), named AS (
  SELECT DISTINCT array_to_string(string_split(host, '.')[-3:], '.') AS pattern, true AS site FROM captures
  UNION SELECT DISTINCT host || '/' || parts[1], false FROM captures WHERE len(parts) > 0
), numbered AS (
  SELECT *, ('0x' || substr(md5(pattern), 1, 7))::INT AS n FROM named WHERE NOT site OR len(string_split(pattern, '.')) = 3
), entries AS (
  SELECT pattern, DATE '2024-01-01' + (n % 200)::INT + k AS day, action
  FROM numbered, (VALUES (0, 'block'), (60, 'remove'), (150, 'block')) t(k, action) WHERE site AND n % 3 = 0
  UNION ALL SELECT pattern, DATE '2024-01-01' + (n % 200)::INT, CASE WHEN n % 4 = 0 THEN 'allow' ELSE 'block' END
  FROM numbered WHERE NOT site AND n % 4 < 2
), valid AS (
  SELECT pattern, action, day AS since, lead(day) OVER (PARTITION BY pattern ORDER BY day) AS until FROM entries
), domains AS (
  SELECT *, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS domain
  FROM captures
), keyed AS (
  SELECT *, unnest(list_transform(range(0, len(parts) + 1), lambda n: array_to_string(list_prepend(domain, parts[1:n]), '/'))) AS pattern FROM domains
), active AS (
  SELECT page_id, arg_max(k.pattern, (length(k.pattern), k.pattern)) AS pattern, arg_max(since, (length(k.pattern), k.pattern)) AS since,
         arg_max(action, (length(k.pattern), k.pattern)) AS action
  FROM keyed k JOIN valid v ON k.pattern = v.pattern AND day >= since AND (until IS NULL OR day < until)
  WHERE action <> 'remove' GROUP BY page_id
)
SELECT page_id, nullif(host, '') AS host, day, pattern, since, CASE WHEN action = 'block' THEN 'block' ELSE 'keep' END AS verdict
FROM captures LEFT JOIN active USING (page_id)
"""


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every document: lines or texts within 0.8 of a template."""
    return licenses.scan(table(spark, sf_dir, "documents"), percent=80)


ORACLE["op7_license_scan"] = licenses.oracle(80)


@query
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10-word windows of every benchmark item against every document."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: the hash of op3 and op4 in DuckDB
HASH_SQL = "('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT"

SHARD_BYTES = 1 << 20


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard; shards hold 1 MiB of text at most."""
    return sharding.shards(table(spark, sf_dir, "documents"), max_bytes=SHARD_BYTES)


ORACLE["op3_sharding"] = f"""
WITH d AS (
  SELECT doc_id, {HASH_SQL} AS h, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes FROM documents
), grid AS (
  SELECT doc_id, h, n_bytes, depth::INT AS depth, h >> (60 - depth)::INT AS prefix
  FROM d, range(0, 41) r(depth)
), sized AS (
  SELECT *, sum(n_bytes) OVER p AS total, min(h) OVER p AS low, max(h) OVER p AS high
  FROM grid WINDOW p AS (PARTITION BY depth, prefix)
), leaf AS (
  SELECT doc_id, any_value(n_bytes) AS n_bytes, min(depth) AS depth, any_value(h) AS h
  FROM sized WHERE total <= {SHARD_BYTES} OR low = high GROUP BY doc_id
)
SELECT doc_id, n_bytes, depth, depth || '/' || (h >> (60 - depth)) AS shard, '0' AS page FROM leaf
"""


MIX_PERIOD, MIX_BLOCK = 1000, 16


@query
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in blocks of 16, interleaved by the square roots of their sources' sizes."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.temperature_weights(docs, MIX_PERIOD), block_rows=MIX_BLOCK)


ORACLE["op4_source_mixing"] = f"""
WITH RECURSIVE roots AS (
  SELECT source, count(*) AS n, floor(sqrt(count(*)::DOUBLE) * 1000)::BIGINT AS root FROM documents GROUP BY source
), shares AS (
  SELECT source, n, root * ({MIX_PERIOD} - count(*) OVER ()) AS part, sum(root) OVER () AS whole FROM roots
), weighed AS (
  SELECT source, n, 1 + part // whole AS base, row_number() OVER (ORDER BY part % whole DESC, source NULLS LAST) AS place,
         {MIX_PERIOD} - sum(1 + part // whole) OVER () AS spare
  FROM shares
), weights AS (
  SELECT source, n, (base + (place <= spare)::INT)::BIGINT AS w, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM weighed
), lists AS (
  SELECT list(w ORDER BY k) AS ws, count(*) AS m FROM weights
), slots(t, done, k) AS (
  SELECT -1::BIGINT, list_transform(ws, lambda x: 0::BIGINT), 0::BIGINT FROM lists
  UNION ALL
  SELECT t + 1, list_transform(done, lambda x, i: CASE WHEN i = pick THEN x + 1 ELSE x END), pick
  FROM (
    SELECT t, done, list_min(list_transform(
      list_filter(range(1, m + 1), lambda i: (done[i] * {MIX_PERIOD}) // ws[i] <= t + 1),
      lambda i: (((done[i] + 1) * {MIX_PERIOD} + ws[i] - 1) // ws[i]) * 100000 + i)) % 100000 AS pick
    FROM slots, lists WHERE t < {MIX_PERIOD} - 1
  )
), plan AS (
  SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS nth FROM slots WHERE t >= 0
), ranked AS (
  SELECT doc_id, d.source, k, w, row_number() OVER (PARTITION BY k ORDER BY {HASH_SQL}, doc_id) - 1 AS rank
  FROM documents d JOIN weights ON d.source IS NOT DISTINCT FROM weights.source
), empty AS (
  SELECT min((n // {MIX_BLOCK} // w) * {MIX_PERIOD} + t) AS first
  FROM weights JOIN plan ON plan.k = weights.k AND nth = (n // {MIX_BLOCK}) % w
)
SELECT doc_id, source, rank, rank // {MIX_BLOCK} AS block, (rank // {MIX_BLOCK} // w) * {MIX_PERIOD} + t AS slot,
       ((rank // {MIX_BLOCK} // w) * {MIX_PERIOD} + t) * {MIX_BLOCK} + rank % {MIX_BLOCK} AS position,
       (rank // {MIX_BLOCK} // w) * {MIX_PERIOD} + t < first AS in_ratio
FROM ranked JOIN plan ON plan.k = ranked.k AND nth = (rank // {MIX_BLOCK}) % w, empty
"""


@query
def op5_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under a model of the trusted ones, and whether it is kept."""
    return perplexity.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), n=5)


@query
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of 0.85 or more over 4-word shingles."""
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), n=4, percent=85)


@query
def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products for every vector whose id is divisible by 50."""
    return vector_topk.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, k=5, scale=256.0)


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the word-level vocabulary."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary, limit=2048)


def held_out(doc_id):
    """A quarter of the ids, never used for training."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, trained on the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable=lambda doc_id: ~held_out(doc_id))
    scored = toxicity.score(docs, model, threshold=0.3)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("segments").alias("n_segments")
    )


#: CRC-32 of a text in DuckDB: ``tab`` is the table of byte steps, ``crc_of(text, tab)`` the unsigned sum
CRC_SQL = """
crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab
)"""


def crc_sql(text: str) -> str:
    """SQL for the CRC-32 of a text column, next to a table with ``tab``."""
    code = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::INT, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {code}), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


#: A-Z lower-cased and nothing else
LOWER_SQL = f"translate({{0}}, '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}')"


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all documents, drawn towards the benchmark's words."""
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    drawn = importance.resample(docs, target, percent=10, min_n=1, max_n=1, buckets=10_000, min_words=20, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE["op12_importance_resampling"] = rf"""
WITH {CRC_SQL}, words AS (
  SELECT doc_id, regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), wanted AS (
  SELECT regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), found AS (
  SELECT w, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t
  FROM (SELECT unnest(ws) AS w, 1 AS s, 0 AS t FROM words UNION ALL SELECT unnest(ws), 0, 1 FROM wanted) GROUP BY w
), placed AS (
  SELECT w, s, t, {crc_sql("w")} % 10000 AS bucket FROM found, crc
), sized AS (
  SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM placed GROUP BY bucket
), totals AS (
  SELECT sum(s) AS s_all, sum(t) AS t_all FROM sized
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM sized, totals
), of_word AS (
  SELECT w, gain FROM placed JOIN gains USING (bucket)
), weighed AS (
  SELECT doc_id, sum(gain)::BIGINT AS weight FROM (SELECT doc_id, unnest(ws) AS w FROM words) JOIN of_word USING (w) GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM words LEFT JOIN weighed USING (doc_id)
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () * 10 // 100 AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n THEN place END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""


@query
def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens of the byte-level vocabulary."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, with planted misspellings, grouped with their frequent near words."""
    found = spelling.spelling_groups(table(spark, sf_dir, "documents"), min_length=7, min_count=2, ratio=10, damage_every=31)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


ORACLE["op13_spelling_variants"] = rf"""
WITH RECURSIVE {CRC_SQL}, runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all({LOWER_SQL.format("text")}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run
), named AS (
  SELECT run, n, doc_id || ':' || run AS name FROM runs
), summed AS (
  SELECT run, n, {crc_sql("name")} AS h FROM named, crc
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM summed GROUP BY word HAVING length(word) >= 7 AND sum(n) >= 2
), shorter AS (
  SELECT word, n, k, substr(word, 1, (k - 1)::INT) || substr(word, (k + 1)::INT) AS rest FROM words, unnest(range(1, length(word) + 1)) u(k)
), near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.rest = b.word
), ranked AS (
  SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, encode(other)) AS place FROM near
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN other END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND place = 1
), steps AS (
  SELECT word, word AS last, 0 AS step FROM formed
  UNION ALL SELECT s.word, f.form, step + 1 FROM steps s JOIN formed f ON s.last = f.word WHERE f.form IS NOT NULL
), roots AS (
  SELECT word, arg_max(last, step) AS root FROM steps GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
"""
