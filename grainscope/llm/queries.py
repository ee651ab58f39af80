"""The registered queries of this subpackage: thin calls of its operators on whole tables."""

from __future__ import annotations

import public_tokenizers as public
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainscope.plans.registry import query
from grainscope.session import shared_dir

WORDS = public.path("word_bpe_49k.json")
BYTES = public.path("byte_bpe_50k.tiktoken")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainscope.llm.packing import pack

    return pack(documents(spark, sf_dir), WORDS, with_ids=False)


@query("op9_token_files")
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainscope.llm.tokenfiles import read_token_files, write_token_files

    return read_token_files(write_token_files(documents(spark, sf_dir), shared_dir(spark), WORDS), with_ids=False)


@query("op10_byte_bpe")
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainscope.llm.bytebpe import encode_texts

    return encode_texts(documents(spark, sf_dir), BYTES, public.PATTERN, digest_only=True)


@query("op4_language")
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainscope.llm.language import held_out, identify, train_language_model

    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = train_language_model(docs)
    return identify(docs.select("doc_id", "text", held_out("doc_id").alias("held_out")), model).select(
        "doc_id", "held_out", "lang_pred", "score")


LINE_DEDUP_SQL = """
WITH lines AS (
  SELECT doc_id, i, list[i] AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS list FROM documents) d,
       LATERAL (SELECT unnest(range(1, len(list) + 1)) AS i)),
windows AS (
  SELECT doc_id, i, line, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY line, b, c ORDER BY doc_id, i) AS k
                         FROM windows WHERE c IS NOT NULL) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, (VALUES (0), (1), (2)) v(k)),
marked AS (
  SELECT l.doc_id, l.i, l.line, g.i IS NOT NULL AS gone,
         coalesce(lag(g.i IS NOT NULL) OVER (PARTITION BY l.doc_id ORDER BY l.i), false) AS before
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       count(*) FILTER (gone AND NOT before) AS n_spans,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query("op5_line_dedup", LINE_DEDUP_SQL)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainscope.llm.linededup import dedup_lines

    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


@query("op2_secret_scan")
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainscope.llm.secretscan import as_text, count_kind, labelled_tokens, pair_weights, scan_secrets

    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = scan_secrets(docs, pair_weights(labelled_tokens(docs)))
    return found.select(
        "doc_id", *[count_kind("base", k).alias(name) for k, name in enumerate(("n_assign", "n_access", "n_hex"))],
        F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("found")).alias("spans"))


@query("op3_ngram_join")
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainscope.llm.jaccard import similar_components

    return similar_components(documents(spark, sf_dir).select("doc_id", "text"))


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainscope.llm.suffixes import dedup_substrings

    return dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"), digest_only=True)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")


@query("op6_rp_forest")
def op6_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainscope.llm.rpforest import search

    rows = embeddings(spark, sf_dir)
    return search(rows, rows.where("vec_id % 20 = 0"), k=20)


@query("op7_itq_near_dedup")
def op7_itq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainscope.llm.itq import link_near_vectors

    return link_near_vectors(embeddings(spark, sf_dir))


PASSAGES_SQL = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS list FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(list[i:i + 49], ' ') AS w
  FROM words, LATERAL (SELECT unnest(range(1, len(list) - 48)) AS i)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS lead FROM windows) WHERE lead < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, range(50) t(k)),
kept AS (
  SELECT p.doc_id, count(g.i) AS n_removed, coalesce(string_agg(p.word, ' ' ORDER BY p.i) FILTER (g.i IS NULL), '') AS kept
  FROM (SELECT doc_id, i, list[i] AS word FROM words, LATERAL (SELECT unnest(range(1, len(list) + 1)) AS i)) p
  LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
SELECT w.doc_id, len(w.list)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id"""


@query("op11_passages", PASSAGES_SQL)
def op11_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainscope.llm.passages import dedup_passages

    return dedup_passages(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS list
  FROM documents),
terms AS (SELECT doc, lang, source, unnest(list) AS term FROM docs),
kept AS (SELECT lang, term FROM terms GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
found AS (SELECT lang, source, term, count(*) AS c FROM terms SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sources AS (SELECT DISTINCT lang, source FROM docs),
counts AS (
  SELECT s.lang, s.source, k.term, coalesce(f.c, 0)::HUGEINT AS c
  FROM sources s JOIN kept k ON s.lang = k.lang
  LEFT JOIN found f ON f.lang = s.lang AND f.source = s.source AND f.term = k.term),
grid AS (
  SELECT lang, source, term, c, 1 + (1000000000 * (c + 1)) // (sum(c) OVER g + count(*) OVER g) AS p
  FROM counts WINDOW g AS (PARTITION BY lang, source)),
langs AS (
  SELECT lang, term, 1 + (1000000000 * (c + 1)) // (sum(c) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q
  FROM (SELECT lang, term, sum(c)::HUGEINT AS c FROM counts GROUP BY lang, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT g.lang, g.source, 'term', g.term, (((g.p - l.q) * (g.p - l.q)) // l.q)::BIGINT
  FROM grid g JOIN langs l ON g.lang = l.lang AND g.term = l.term WHERE g.c > 0 AND g.p > l.q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
WHERE part = 'pair' OR rank <= 200"""


@query("op12_source_divergence", DIVERGENCE_SQL)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainscope.llm.divergence import source_divergence

    return source_divergence(documents(spark, sf_dir))


#: CRC-32 in SQL: the remainders of all bytes by eight steps each, then one step per byte of the string.
SPELLING_SQL = r"""
WITH RECURSIVE remainders AS (
  SELECT list(list_reduce([b::UBIGINT] || range(8)::UBIGINT[],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY b) AS t
  FROM range(256) r(b)),
raw AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(
    text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
runs AS (SELECT doc_id, run, count(*) AS times FROM raw WHERE length(run) >= 5 GROUP BY ALL),
sums AS (
  SELECT run, times, xor(list_reduce([4294967295::UBIGINT] || list_transform(
      range(1, octet_length(b) + 1), lambda i: ('0x' || substring(hex_text, 2 * i - 1, 2))::UBIGINT),
      lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)::BIGINT])), 4294967295::UBIGINT) AS h
  FROM (SELECT run, times, encode(coalesce(doc_id::VARCHAR, '') || ':' || run) AS b, hex(b) AS hex_text FROM runs), remainders),
words AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT times, CASE WHEN h % 97 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2)
                       ELSE run END AS word FROM sums) WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
cut AS (
  SELECT word, n, length(word) AS size, i, substring(word, 1, i) || substring(word, i + 2) AS rest
  FROM words, LATERAL (SELECT unnest(range(0, length(word))) AS i)),
pairs AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b
    ON a.rest = b.rest AND a.i = b.i AND a.size = b.size AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near,
         row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS k FROM pairs),
judged AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 2 * w.n THEN b.other END AS form,
         CASE WHEN b.other_n >= 2 * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word AND b.k = 1),
chain AS (
  SELECT word, word AS root, form AS onward FROM judged
  UNION ALL SELECT c.word, j.word, j.form FROM chain c JOIN judged j ON c.onward = j.word)
SELECT j.word, j.form, c.root, j.n, j.n_near, j.form_n FROM judged j JOIN chain c ON j.word = c.word AND c.onward IS NULL"""


@query("op13_spelling", SPELLING_SQL)
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainscope.llm.spelling import spelling_variants

    return spelling_variants(documents(spark, sf_dir).select("doc_id", "text"))
