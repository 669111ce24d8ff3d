"""Queries of the operators made of column expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from antecede.llm import decontamination, line_dedup, preference, quality_rules
from antecede.llm.common import table
from antecede.llm.registry import query

_PREFERENCE_SQL = """
WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, -4611686018427387904) AS turn,
                  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
last AS (SELECT conv_id, max({'turn': turn, 'text': text}) AS l FROM t WHERE role = 'assistant' GROUP BY conv_id),
swap AS (SELECT a.conv_id, a.l.turn AS last_turn, a.l.text AS last_text, b.l.text AS answer
         FROM last a LEFT JOIN last b ON b.conv_id = a.conv_id + 1),
other AS (SELECT DISTINCT t.conv_id, turn, role,
                 CASE WHEN hit THEN answer ELSE text END AS text
          FROM (SELECT t.*, s.answer, coalesce(turn = last_turn AND role = 'assistant' AND text = last_text, false) AS hit
                FROM t LEFT JOIN swap s USING (conv_id)) t WHERE NOT hit OR answer IS NOT NULL),
sides AS (SELECT 'c' AS side, * FROM t UNION ALL SELECT 'r', * FROM other),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, side ORDER BY turn, role, text) AS pos FROM sides),
paired AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.pos, b.pos) AS pos,
                  coalesce(a.role = b.role AND a.text = b.text, false) AS same
           FROM (FROM placed WHERE side = 'c') a FULL JOIN (FROM placed WHERE side = 'r') b USING (conv_id, pos)),
cut AS (SELECT conv_id, coalesce(min(pos) FILTER (NOT same) - 1, max(pos)) AS n FROM paired GROUP BY conv_id),
shown AS (SELECT p.*, n, '<|im_start|>' || role || chr(10) AS head, text || '<|im_end|>' || chr(10) AS tail
          FROM placed p JOIN cut USING (conv_id)),
spans AS (SELECT *, coalesce(sum(length(head) + length(tail)) OVER (PARTITION BY conv_id, side, pos > n ORDER BY pos
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS first FROM shown)
SELECT conv_id AS pair_id, CAST(any_value(n) AS INTEGER) AS n_prefix,
       coalesce(string_agg(head || tail, '' ORDER BY pos) FILTER (side = 'c' AND pos <= n), '') AS prompt,
       coalesce(string_agg(head || tail, '' ORDER BY pos) FILTER (side = 'c' AND pos > n), '') AS chosen,
       coalesce(string_agg(head || tail, '' ORDER BY pos) FILTER (side = 'r' AND pos > n), '') AS rejected,
       coalesce(string_agg(CAST(first AS BIGINT) || '-' || CAST(first + length(tail) - 1 AS BIGINT), ',' ORDER BY pos)
                FILTER (side = 'c' AND pos > n AND role = 'assistant'), '') AS chosen_loss,
       coalesce(string_agg(CAST(first AS BIGINT) || '-' || CAST(first + length(tail) - 1 AS BIGINT), ',' ORDER BY pos)
                FILTER (side = 'r' AND pos > n AND role = 'assistant'), '') AS rejected_loss
FROM spans GROUP BY conv_id"""


@query("op1_preference_formatting", _PREFERENCE_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation against itself with its last answer swapped for its neighbour's."""
    conversations = table(spark, folder, "conversations")
    pairs = preference.preference_examples(conversations, preference.answers_swapped(conversations))
    shown = {c: F.array_join(F.transform(f"{c}_spans", lambda s: F.concat_ws("-", s["first"], s["last"])), ",")
             for c in ("chosen", "rejected")}
    return pairs.select("pair_id", "n_prefix", "prompt", "chosen", "rejected",
                        shown["chosen"].alias("chosen_loss"), shown["rejected"].alias("rejected_loss"))


_RULES_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
           FROM documents),
pos AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
tri AS (SELECT doc_id, p, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM pos
        WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
twice AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS c FROM tri WHERE w3 IS NOT NULL),
cover AS (SELECT doc_id, count(DISTINCT q) AS n FROM
          (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM twice WHERE c > 1) GROUP BY doc_id),
m AS (SELECT doc_id, text, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
      FROM d LEFT JOIN cover USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 100 * n_dup_lines > 30 * (len(string_split(text, chr(10))) - 1) + 30
            OR 2 * length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) > length(regexp_replace(text, '[^\p{L}]+', '', 'g'))
            OR 10 * length(regexp_replace(text, '[^\p{L}]+', '', 'g')) < 6 * word_chars) AS kept
FROM b"""


@query("op3_quality_rules", _RULES_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Base measures, base verdict and cascade verdict of every whole document."""
    return quality_rules.cascade(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op7_line_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the lines removed that repeat an earlier line, nearly or exactly."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.deduplicated(docs, shortest=1).select("doc_id", "n_lines", "n_dropped", "text")


@query("op10_benchmark_decontamination")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the benchmark item it holds, if any."""
    return decontamination.flagged(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
