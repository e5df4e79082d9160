"""The registered queries of the training-data operators, and their SQL where there is some."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import (
    collocations, conversation_trie, decontaminate, fertility, langid, merge_dropout, nearest, page_text, repeats, simhash, token_counts, token_files, url_rules,
)
from eventloom.llm.common import read_table, written
from eventloom.session import scratch_path


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.learn(docs.where(~langid.held_out("doc_id")))
    marked = docs.select("doc_id", "text", langid.held_out("doc_id").alias("held_out"))
    return langid.predict(marked, model, columns=("doc_id", "held_out"))


def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract_text(read_table(spark, sf_dir, "pages"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_token_files(read_table(spark, sf_dir, "documents"), path, tokenizer)
    return token_files.read_token_files(spark, path)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = read_table(spark, sf_dir, "documents")
    lengths = token_counts.with_lengths(docs, ranks, public_tokenizers.PATTERN)
    # Small, and read twice: written down, so that texts are encoded once.
    return token_counts.context_table(written(token_counts.length_histogram(lengths), "lengths"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_rules.rule_table(spark, url_rules.RULES)
    return url_rules.judge_urls(read_table(spark, sf_dir, "pages"), rules)


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_report(read_table(spark, sf_dir, "documents"))


def op10_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return merge_dropout.segment(docs, model, restored="decoded").select(
        "doc_id", "ids", F.size("ids").cast("bigint").alias("n_ids"), F.col("text").eqNullSafe(F.col("decoded")).alias("lossless")
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.numbered_turns(read_table(spark, sf_dir, "conversations"))
    return conversation_trie.prefix_trie(conversation_trie.with_shared_heads(turns))


def op12_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return fertility.judge(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language": op1_language,
    "op2_page_text": op2_page_text,
    "op3_token_files": op3_token_files,
    "op4_token_counts": op4_token_counts,
    "op5_simhash": op5_simhash,
    "op6_url_rules": op6_url_rules,
    "op7_nearest": op7_nearest,
    "op8_decontaminate": op8_decontaminate,
    "op9_repeats": op9_repeats,
    "op10_merge_dropout": op10_merge_dropout,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_fertility": op12_fertility,
    "op13_collocations": op13_collocations,
}

ORACLES = {
    "op6_url_rules": r"""
WITH split AS (
  SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS place FROM pages),
cut AS (
  SELECT page_id, CASE WHEN place > 0 THEN substr(url, place + 3) ELSE '' END AS rest FROM split),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(rule_host, rule_path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS place
  FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host))
    AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE place = 1""",
    "op11_prefix_trie": r"""
WITH t AS (
  SELECT conv_id, coalesce(text, '') AS text, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '')
      || coalesce(text, '')) AS id, row_number() OVER (PARTITION BY conv_id
      ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list(id ORDER BY place) AS ids, list(strlen(text) ORDER BY place) AS sizes
  FROM t GROUP BY conv_id),
heads AS (
  SELECT *, conv_id - conv_id % 5 AS base, xor(list_reduce([4294967295]::BIGINT[] || flatten(list_transform(
      string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c), 0, 0, 0, 0, 0, 0, 0]::BIGINT[])),
      lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295) % 9 AS h FROM own),
rebuilt AS (
  SELECT a.conv_id, coalesce(b.ids, [])[1:a.h] || a.ids[a.h + 1:] AS ids,
    coalesce(b.sizes, [])[1:a.h] || a.sizes[a.h + 1:] AS sizes
  FROM heads a LEFT JOIN own b ON b.conv_id = a.base),
deep AS (SELECT *, unnest(range(0, len(ids) + 1)) AS depth FROM rebuilt),
m AS (
  SELECT conv_id, depth, sha256(array_to_string(ids[1:depth], '')) AS node, depth = len(ids) AS ended,
    CASE WHEN depth > 0 THEN sha256(array_to_string(ids[1:depth - 1], '')) END AS parent,
    CASE WHEN depth > 0 THEN sizes[depth] ELSE 0 END AS size FROM deep),
n AS (
  SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    any_value(size) AS size, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)
      FILTER (ended), '')) AS ends_sha256 FROM m GROUP BY node),
c AS (SELECT parent AS node, count(*) AS n_children FROM n GROUP BY parent),
below AS (
  SELECT m.node, count(*) FILTER (c.node IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.size)::BIGINT AS saved_tokens
  FROM n LEFT JOIN c USING (node) JOIN m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY m.node)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children,
  below.n_leaves, below.saved_tokens, n.ends_sha256
FROM n LEFT JOIN n p ON p.node = n.parent LEFT JOIN c ON c.node = n.node JOIN below ON below.node = n.node""",
    "op13_collocations": r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, words FROM (
    SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda w: w <> '') AS words FROM documents)),
places AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces),
grams AS (SELECT lang, words, i, unnest([1, 2, 3]) AS k FROM places),
f AS (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS f
  FROM grams WHERE i + k - 1 <= len(words) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
often AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT o.lang, o.k, o.phrase, a, c, l.f AS l, r.f AS r, 1000000 * a * a // (l.f * r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS c FROM often) o
  JOIN f l ON l.lang = o.lang AND l.phrase = array_to_string(words[1:c], ' ')
  JOIN f r ON r.lang = o.lang AND r.phrase = array_to_string(words[c + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
longer AS (
  SELECT lang, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) AS phrase, a
  FROM often WHERE k = 3),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM longer g
    WHERE g.lang = b.lang AND g.phrase = b.phrase AND 100 * g.a >= 50 * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000""",
}
