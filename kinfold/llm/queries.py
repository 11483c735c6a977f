"""The queries of this package's operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import bpe, chat_format, collocations, conversation_repair, decontaminate, exact_dedup, language_id, pii, quality, secret_scan, simhash, suffix_dedup, url_filter
from kinfold.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, rejected = chat_format.last_turn_pairs(table(spark, sf_dir, "conversations"))
    return chat_format.format_preferences(chosen, rejected)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OPERATORS = (
    op1_secret_scan,
    op2_simhash,
    op3_bpe,
    op4_pii,
    op5_exact_dedup,
    op6_url_filter,
    op7_language_id,
    op8_suffix_dedup,
    op9_decontaminate,
    op10_chat_format,
    op11_collocations,
    op12_conversation_repair,
    op13_quality,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


#: White space of the contracts, as a class of DuckDB's regular expressions.
_WS = r"[\x20\x09-\x0D]"

ORACLE_SQL = {
    "op5_exact_dedup": rf"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                   regexp_replace(coalesce(text, ''), '{_WS}', '', 'g') AS content
            FROM documents),
        r AS (
            SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY content) AS group_size
            FROM n WINDOW w AS (PARTITION BY content ORDER BY n_chars DESC, doc_id NULLS LAST))
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept,
               sha256(content) AS text_sha256
        FROM r""",
    "op6_url_filter": r"""
        WITH p AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)', 1),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '^[\s\S]*?://[^/?#]*([^?#]*)', 1) AS path
            FROM pages),
        r(verdict, rule_host, rule_path) AS (
            VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                   ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        b AS (
            SELECT p.*, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
                   arg_max(verdict, length(rule_host || rule_path)) AS by_rule
            FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY ALL)
        SELECT page_id, host, path, rule,
               coalesce(by_rule, CASE WHEN regexp_matches(path, '/(casino|phishing|tracking|adserver|warez)/')
                                      THEN 'block' ELSE 'allow' END) AS verdict
        FROM b""",
    "op10_chat_format": r"""
        WITH c AS (
            SELECT conv_id AS pair_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations),
        e AS (
            SELECT pair_id, max(turn) AS last_turn, arg_max(text, (turn, text)) AS last_text FROM c GROUP BY pair_id),
        r AS (
            SELECT c.pair_id, turn, role, CASE WHEN turn = e.last_turn THEN o.last_text ELSE text END AS text
            FROM c JOIN e USING (pair_id) LEFT JOIN e o ON o.pair_id = c.pair_id + 1
            WHERE turn <> e.last_turn OR o.pair_id IS NOT NULL),
        d AS (
            SELECT pair_id, min(turn) AS first
            FROM ((FROM c EXCEPT ALL FROM r) UNION ALL (FROM r EXCEPT ALL FROM c)) GROUP BY pair_id),
        s AS (
            SELECT c.*, 'chosen' AS side FROM c UNION ALL SELECT r.*, 'rejected' FROM r),
        h AS (
            SELECT s.*, CASE WHEN d.first IS NULL OR turn < d.first THEN 'prompt' ELSE 'completion' END AS part,
                   row_number() OVER (PARTITION BY pair_id, turn, side ORDER BY role, text) AS nth,
                   '<|' || regexp_replace(role, '\|(\\*)>', '|\1\\>', 'g') || '|>' || chr(10) AS header,
                   regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') || '<|end|>' || chr(10) AS body
            FROM s LEFT JOIN d USING (pair_id)),
        t AS (
            SELECT *, header || body AS rendered, length(header) + CASE WHEN role = 'assistant' THEN 0 ELSE length(body) END AS masked,
                   CASE WHEN role = 'assistant' THEN length(body) ELSE 0 END AS trained
            FROM h WHERE side = 'chosen' OR part = 'completion')
        SELECT pair_id, part, turn, CAST(nth AS INTEGER) AS nth, max(rendered) FILTER (part = 'prompt') AS prompt,
               max(rendered) FILTER (part <> 'prompt' AND side = 'chosen') AS chosen,
               max(rendered) FILTER (part <> 'prompt' AND side = 'rejected') AS rejected,
               coalesce(max(masked) FILTER (part <> 'prompt' AND side = 'chosen'), 0) AS chosen_masked,
               coalesce(max(trained) FILTER (part <> 'prompt' AND side = 'chosen'), 0) AS chosen_trained,
               coalesce(max(masked) FILTER (part <> 'prompt' AND side = 'rejected'), 0) AS rejected_masked,
               coalesce(max(trained) FILTER (part <> 'prompt' AND side = 'rejected'), 0) AS rejected_trained
        FROM t GROUP BY ALL""",
    "op11_collocations": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
        total AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
        s AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
        g AS (SELECT lang, array_to_string(words[i : i + k - 1], ' ') AS g FROM s, range(1, 6) t(k) WHERE i + k - 1 <= len(words)),
        f AS (SELECT lang, g, count(*) AS a, string_split(g, ' ') AS ws FROM g GROUP BY lang, g HAVING count(*) >= 100),
        cut AS (SELECT lang, g, a, k, array_to_string(ws[:k], ' ') AS g1, array_to_string(ws[k + 1:], ' ') AS g2 FROM f, range(1, 5) t(k) WHERE k < len(ws)),
        cuts AS (
            SELECT c.lang, c.g, c.a, k, x.a AS l, y.a AS r, n, CAST((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
            FROM cut c JOIN f x ON x.lang = c.lang AND x.g = g1 JOIN f y ON y.lang = c.lang AND y.g = g2 JOIN total ON total.lang = c.lang),
        best AS (SELECT lang, g, any_value(a) AS a, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r, any_value(n) AS n, min(score) AS score FROM cuts GROUP BY lang, g),
        inner_g AS (
            SELECT lang, array_to_string(ws[i : i + k - 1], ' ') AS g, max(a) AS longer FROM f, range(2, 5) t(k), range(1, 5) u(i)
            WHERE k < len(ws) AND i + k - 1 <= len(ws) GROUP BY ALL),
        kept AS (SELECT best.* FROM best LEFT JOIN inner_g USING (lang, g) WHERE longer IS NULL OR 100 * longer < 100 * a),
        ranked AS (
            SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank, g AS phrase, a, l, r, n, score FROM kept)
        SELECT * FROM ranked WHERE rank <= 2000""",
}
