"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.llm import bpe, embed, html, licenses, lines, ngram_join, packing, pq, quality, runs, toxicity, urls, warc
from firmlens.llm.common import table


def vocabulary() -> str:
    """The public tokenizer file that the contracts name; every operator takes it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, vocabulary()), vocabulary())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.little_endian("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    counts = quality.with_counts(docs).select("doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality.judge_counts(counts).drop("source")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, lines = warc.write(table(spark, sf_dir, "pages"))
    found = warc.captures(folder, warc.index(folder, lines))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.size("toxicity.spans").alias("n_spans"),
    )


RULES: list[urls.Rule] = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op11_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = pq.compress(table(spark, sf_dir, "embeddings"))
    digests = F.create_map(*(F.lit(x) for dim, b in books.items() for x in (dim, pq.digest(b)))) if books else F.lit(None).cast("map<int, string>")
    return coded.select("vec_id", "code", "error", "label_error", F.element_at(digests, F.col("dim")).alias("codebooks_sha256"))


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """Periodic words from some place on, in one text of ten; none without an id."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find(table(spark, sf_dir, "documents"), order=planted_order)
    top = F.expr("array_min(transform(runs, r -> struct(-r.length as length, r.start as start, r.period as period)))")
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), (-F.col("top.length")).alias("length"), F.col("top.period").alias("period"),
        F.expr("(1000 * -top.length) div top.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents")).withColumn("base", F.expr("filter(spans, s -> s.exact)"))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.expr("array_min(base.start)").alias("first_word"), F.expr("array_max(base.start)").alias("last_word"),
        licenses.labels_of("base").alias("base_labels"), licenses.labels_of().alias("labels"), F.coalesce(F.expr("array_max(spans.share)"), F.lit(0.0)).alias("score"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_quality_rules, op3_line_dedup, op4_ngram_jaccard, op5_embedding_near_dedup, op6_warc, op7_toxicity, op8_url_filters, op9_packing, op10_html_extraction, op11_product_codes, op12_runs, op13_licenses)}


OP2_SQL = r"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
  w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
  x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
  y AS (SELECT doc_id, i, word || chr(10) || lead(word, 1) OVER o || chr(10) || lead(word, 2) OVER o AS g FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
  z AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM y WHERE g IS NOT NULL),
  r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM z WHERE c > 1) GROUP BY doc_id),
  l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
  b AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
  f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
  h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS bad FROM f GROUP BY source),
  m AS (SELECT sum(bad) / sum(n) AS m, sum(n * (bad / n) * (bad / n)) / sum(n) AS m2, count(*) / sum(1.0 / n) AS size FROM h),
  v AS (SELECT m, m2 - m * m - m * (1 - m) / size AS between_hosts FROM m),
  k AS (SELECT m, greatest(1.0, least(1000.0, CASE WHEN between_hosts > 0 THEN m * (1 - m) / between_hosts - 1 ELSE 1000.0 END)) AS k FROM v),
  rates AS (SELECT source, (bad + m * k) / (n + k) AS rate FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.9 AS kept FROM f JOIN rates ON f.source IS NOT DISTINCT FROM rates.source"""

#: Without links between hosts, which the given pages don't have, no host is condemned.
OP8_SQL = r"""WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
  r AS (SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/' WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/' WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT *, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM r"""


def _template_rows() -> str:
    rows = [(label, "true", text) for label, text in licenses.PHRASES] + [(label, "false", text) for label, text in licenses.NOTICES]
    return ", ".join(f"({i}, '{label}', {exact}, '{text.replace(chr(39), chr(39) * 2)}')" for i, (label, exact, text) in enumerate(rows))


#: The same votes and checks on words themselves instead of hashes; ids are unique in the given table.
OP13_SQL = r"""WITH t AS (SELECT tid, label, exact, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM (VALUES %s) v(tid, label, exact, text)),
  k AS (SELECT *, len(ws) AS m, least(4, len(ws)) AS k FROM t),
  g AS (SELECT tid, k, p, array_to_string(ws[p + 1 : p + k], ' ') AS gram FROM (SELECT *, unnest(range(m - k + 1)) AS p FROM k)),
  d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
  w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM d),
  a AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o AS g2, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o AS g4 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
  h AS (SELECT doc_id, tid, i - p AS diagonal FROM a JOIN g ON g.k = 2 AND a.g2 = g.gram UNION ALL SELECT doc_id, tid, i - p FROM a JOIN g ON g.k = 4 AND a.g4 = g.gram),
  v AS (SELECT doc_id, tid, diagonal, count(*) AS votes FROM h GROUP BY ALL),
  n AS (SELECT v.*, k.exact, k.m, k.m - k.k + 1 AS windows, coalesce(k.exact OR diagonal - lag(diagonal) OVER q > k.m // 8 + 1, true) AS fresh FROM v JOIN k USING (tid) WINDOW q AS (PARTITION BY doc_id, tid ORDER BY diagonal)),
  c AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id, tid ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM n),
  s AS (SELECT doc_id, tid, span, exact, m, list(diagonal) AS ds FROM c GROUP BY ALL HAVING CASE WHEN exact THEN sum(votes) = any_value(windows) ELSE 4 * sum(votes) >= any_value(windows) END),
  e AS (SELECT s.doc_id, s.tid, s.span, x.u, d.ws, k.ws AS ts FROM s JOIN d USING (doc_id) JOIN k USING (tid), (SELECT unnest(s.ds) AS u) x),
  f AS (SELECT doc_id, tid, span, u, unnest(range(len(ts))) AS j, ws, ts FROM e),
  r AS (SELECT doc_id, tid, span, min(u) AS first, count(DISTINCT CASE WHEN u + j >= 0 AND ws[u + j + 1] = ts[j + 1] THEN j END) / any_value(len(ts)) AS share FROM f GROUP BY ALL),
  o AS (SELECT r.*, k.label, k.exact, greatest(0, r.first) AS start FROM r JOIN k USING (tid) WHERE NOT k.exact OR share = 1)
SELECT d.doc_id, len(any_value(d.ws))::BIGINT AS n_words, count(o.tid) FILTER (WHERE o.exact) AS n_base, min(o.start) FILTER (WHERE o.exact) AS first_word, max(o.start) FILTER (WHERE o.exact) AS last_word,
  coalesce(array_to_string(list_sort(list(DISTINCT o.label) FILTER (WHERE o.exact)), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list(DISTINCT o.label) FILTER (WHERE o.share >= 0.8)), ','), '') AS labels,
  coalesce(max(o.share), 0.0) AS score FROM d LEFT JOIN o USING (doc_id) GROUP BY d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2_SQL, "op8_url_filters": OP8_SQL, "op13_licenses": OP13_SQL % _template_rows()}
