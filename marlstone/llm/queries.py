"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat, jaccard_join, licenses, order_minhash, packing, quality_rules, sentencepiece_codec, token_store, toxicity, warc
from .common import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archive(spark, warc.write_archive(table(spark, sf_dir, "pages")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edit_report(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored ledger under two versions of the policy."""
    entries = quality_rules.stored_ledger(table(spark, sf_dir, "documents"))
    both = quality_rules.apply_policy(entries, quality_rules.POLICIES["1"]).withColumnRenamed("kept", "kept_by_1")
    both = quality_rules.apply_policy(both, quality_rules.POLICIES["2"])
    return both.selectExpr("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "NOT kept_by_1 AS base_failed", "kept")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy does, from the stored bits alone."""
    return quality_rules.ablations(quality_rules.stored_ledger(table(spark, sf_dir, "documents")), quality_rules.POLICIES["2"])


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_store.read_tokens(spark, store)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents"), jaccard_join.Near(3, 90, 100))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_report(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_warc": op2_warc,
    "op3_toxicity": op3_toxicity,
    "op4_order_minhash": op4_order_minhash,
    "op5_licenses": op5_licenses,
    "op6_packing": op6_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_store": op8_token_store,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_chat": op10_chat,
    "quality_ablations": quality_ablations,
}

#: The measurements of the quality rules.
MEASURES = r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
        u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
        g AS (SELECT doc_id, i, x || ' ' || lead(x, 1) OVER d || ' ' || lead(x, 2) OVER d || ' ' || lead(x, 3) OVER d || ' ' || lead(x, 4) OVER d AS g FROM u WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
        c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g WHERE g IS NOT NULL),
        r AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM c, (SELECT unnest(range(5)) AS j) WHERE n > 1 GROUP BY doc_id),
        m AS (SELECT doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (doc_id))
"""

#: DuckDB SQL where it can express a query; the others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op2_warc": r"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT *, max(page_id) OVER (PARTITION BY b) AS keeper FROM p),
        bits AS (SELECT page_id, octet_length(b) AS n, keeper, unhex(sha1(b)) AS h FROM d),
        five AS (SELECT page_id, n, keeper, list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(hex(h), 1 + 2 * ((5 * k) // 8), 2))::INT * 256 + coalesce(TRY_CAST('0x' || substr(hex(h), 3 + 2 * ((5 * k) // 8), 2) AS INT), 0)) >> (11 - (5 * k) % 8)) & 31)::INT, 1)) AS c FROM bits)
        SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(c, '') AS payload_digest, CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN keeper = page_id THEN NULL ELSE keeper END AS refers_to FROM five
    """,
    "op9_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        u AS (SELECT doc_id, len(w) AS k, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
        g AS (SELECT doc_id, k, x AS x0, lead(x, 1) OVER d AS x1, lead(x, 2) OVER d AS x2 FROM u WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
        t AS MATERIALIZED (SELECT DISTINCT doc_id, x0 || ' ' || x1 || ' ' || x2 AS s FROM g WHERE x2 IS NOT NULL
            UNION SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 2),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
        sides AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r AS (SELECT a AS v, a AS root FROM sides UNION SELECT sides.b, r.root FROM r JOIN sides ON sides.a = r.v),
        m AS (SELECT v, min(root) AS root FROM r GROUP BY v)
        SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(root, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.v = w.doc_id
    """,
    "op10_chat": r"""
        WITH c AS (SELECT conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
        e AS (SELECT *, replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|') AS r, replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|') AS x FROM c)
        SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            sum(length(r) + length(x) + length('<|im_start|>') + length('<|im_end|>') + 2)::BIGINT AS formatted_chars, 0::BIGINT AS n_unlocated, false AS rewrites
        FROM e GROUP BY conv_id
    """,
    "op7_quality_rules": MEASURES + r"""
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
            NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept FROM m
    """,
    "quality_ablations": MEASURES + r""",
        bits AS (SELECT [n_words < 10, 100 * n_repeat_words > 20 * n_words, 10 * n_symbols > 3 * n_words, 10 * n_dup_lines > 3 * n_lines, word_chars < 2 * n_words, word_chars > 20 * n_words] AS f FROM m),
        fails AS (SELECT f, len(list_filter(f, lambda x: x)) AS n FROM bits),
        kept AS (SELECT count(*) AS n_documents, count(*) FILTER (n = 0) AS n_kept FROM fails),
        names AS (SELECT unnest(['few_words', 'repeated_words', 'many_symbols', 'repeated_lines', 'short_words', 'long_words']) AS rule, unnest(range(1, 7)) AS i),
        rules AS (SELECT rule, count(*) FILTER (f[i]) AS n_failed, count(*) FILTER (f[i] AND n = 1) AS n_alone FROM names, fails GROUP BY rule)
        SELECT n_documents, n_kept, rule, n_failed, n_alone, n_kept + n_alone AS n_kept_without FROM rules, kept
    """,
}
