"""Queries of the corpus operators, with their SQL where SQL can express the operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, line_dedup, mixing, ngram_join, pii, quality, suffix_dedup, token_align, token_shards, topk, toxicity, variants
from .common import table

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and the smallest doc_id that links reach: 4 words, 85 %."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=85)


OP10_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_LETTERS}), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[]
    ELSE list_distinct(list_transform(range(1, greatest(len(ws) - 2, 2)), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh
  FROM w),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
  WHERE 100 * n >= 85 * (len(x.sh) + len(y.sh) - n)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, min(reach.b)::BIGINT AS component_id
FROM s JOIN reach ON reach.a = s.doc_id GROUP BY 1, 2
"""


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests, read back from the output, of every conversation and of conversation -7."""
    fixed = spark.sql("SELECT -7L AS conv_id, stack(2, 0L, 'user', 1L, 'assistant') AS (turn, role), '</s>[INST] ok [/INST]' AS text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(fixed)
    return chat.digest(chat.format_conversations(rows))


OP3_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, coalesce(role = lag(role) OVER w, false) AS joined,
    length(text) + len(regexp_extract_all(text, '[<\[]\\*(\||/?s>|/?INST\])')) AS text_chars,
    length(role) + len(regexp_extract_all(role, '[<\[]\\*(\||/?s>|/?INST\])')) AS role_chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(text_chars + CASE WHEN joined THEN 8 ELSE 8 + role_chars + 8 + 7 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that occur again, in every document."""
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i + 1:i + 50], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM g) WHERE n > 1),
b AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM r),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM b)
SELECT doc_id, min(i)::INTEGER AS start_word, (max(i) + 50)::INTEGER AS end_word, (max(i) + 50 - min(i))::INTEGER AS n_words
FROM s GROUP BY doc_id, span
"""


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal numbers, dates and addresses under keyed pseudonyms."""
    return pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), key="ledgerloom-demo-key")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every whole document, encoded and decoded again."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all other vectors for every vector whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, F.col("vec_id") % 50 == 0, k=5)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.v, v.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND len(q.v) = len(v.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of the shards that hold every document's sequences in training order."""
    return token_shards.write_shards(table(spark, sf_dir, "documents"), tokenizer_path(), key="epoch-0")


#: Shares of all tokens that the mixture should have.
SHARES = {"good": 0.9, "good_toxic": 0.02, "low": 0.07, "low_toxic": 0.01}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, posterior and fitted rate of every document."""
    return mixing.rate_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), SHARES)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    return quality.judge(table(spark, sf_dir, "documents"))


def _sql_words(x: str) -> str:
    return rf"regexp_extract_all({x}, '[^\x20\x09-\x0D]+')"


OP8_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (
  SELECT doc_id, i, x AS line, len({_sql_words("x")}) AS n, {_sql_words("x")} AS ws, length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) AS syms
  FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d))),
s AS (SELECT *, coalesce(n BETWEEN 1 AND {quality.SHORT_WORDS} AND regexp_matches(line, '{quality.OPEN_END.replace("'", "''")}'), false) AS short FROM a),
l AS (
  SELECT *, short AND (coalesce(lag(short) OVER w, false) AND (coalesce(lag(short, 2) OVER w, false) OR coalesce(lead(short) OVER w, false)) OR coalesce(lead(short) OVER w, false) AND coalesce(lead(short, 2) OVER w, false)) AS menu,
    n >= {quality.REPEAT_WORDS} AND row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again
  FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
f AS (
  SELECT doc_id, line, length(line) AS n,
    100 * len(list_filter(ws, lambda w: regexp_matches(w, '[#*$%&<>|~^=_!?]{{2,}}$'))) >= 30 * l.n OR 100 * syms > 10 * length(line)
    OR 100 * len(list_filter(ws, lambda w: w IN ('|', '>', '»', '•', '·', '/'))) >= 20 * l.n OR menu OR again
    OR regexp_matches(line, '{quality.NOTICE}') AND l.n <= {quality.NOTICE_WORDS} * len(regexp_extract_all(line, '{quality.NOTICE}')) AS failed
  FROM l WHERE l.n > 0),
lost AS (
  SELECT doc_id, sum(n) AS chars, coalesce(sum(n) FILTER (failed), 0) AS lost, count(*) - count(DISTINCT line) AS n_dup_lines FROM f GROUP BY doc_id),
w AS (SELECT doc_id, text, {_sql_words("text")} AS ws FROM d),
p AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM p) WHERE n > 1),
rw AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
t AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(rw.n, 0)::BIGINT AS n_repeat_words, coalesce(chars, 0) AS chars, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN lost USING (doc_id) LEFT JOIN rw USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= 50 * chars AS kept
FROM t
"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document: its lines, how many leave as boilerplate on 10 sources or more, digest of the rest."""
    return line_dedup.line_report(table(spark, sf_dir, "documents"), least_sites=10)


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, source, i, list_extract(string_split(text, chr(10)), i) AS x
  FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
t AS (SELECT *, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l),
bad AS (SELECT line FROM t WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
m AS (SELECT t.*, bad.line IS NOT NULL AS cut FROM t LEFT JOIN bad USING (line)),
a AS (
  SELECT doc_id, count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (cut) AS n_removed,
    coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT cut), '') AS rest
  FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS text_sha256
FROM documents LEFT JOIN a USING (doc_id)
"""


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document, learned from the labels of three quarters of the ids."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return toxicity.score(docs, table(spark, sf_dir, "labels"), limit=0.3)


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of every whole document under two tokenizers, with corpus counts of the links."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return token_align.align(docs, tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every word of 7 code points or more that occurs at least twice in all documents."""
    words = variants.count_words(table(spark, sf_dir, "documents"), least=7, every=31)
    return variants.group_variants(words.where("n >= 2"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_array_dedup": op1_suffix_array_dedup,
        "op2_pii": op2_pii,
        "op3_chat_formatting": op3_chat_formatting,
        "op4_bpe": op4_bpe,
        "op5_exact_top_k": op5_exact_top_k,
        "op6_token_shards": op6_token_shards,
        "op7_mixing": op7_mixing,
        "op8_quality_rules": op8_quality_rules,
        "op9_line_dedup": op9_line_dedup,
        "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
        "op11_toxicity": op11_toxicity,
        "op12_cross_tokenizer_alignment": op12_cross_tokenizer_alignment,
        "op13_spelling_variants": op13_spelling_variants,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_array_dedup": OP1_SQL,
        "op3_chat_formatting": OP3_SQL,
        "op5_exact_top_k": OP5_SQL,
        "op8_quality_rules": OP8_SQL,
        "op9_line_dedup": OP9_SQL,
        "op10_ngram_jaccard_join": OP10_SQL,
    }
