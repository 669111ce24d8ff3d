"""Queries that audit filters, mix sources and prove what a dataset holds."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, functions as F

from antecede.llm import filter_audit, merkle, source_schedule
from antecede.llm.common import fold_is, table
from antecede.llm.registry import query

_WORDS_SQL = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_AUDIT_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_WORDS_SQL} AS ws FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS is_good, bool_or(toxic = 1) AS is_toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(is_good, false) AS is_good, coalesce(is_toxic, false) AS is_toxic,
      (CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END)
   || (CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END)
   || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END)
   || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
   || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails
      FROM d LEFT JOIN l USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
           WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
gone AS (SELECT f.*, o, coalesce(list_min([instr(o, x) for x in string_split(fails, '') if x <> '']), 6) AS gone_at FROM f, orders),
steps AS (SELECT part, o, step, substr(o, step, 1) AS letter FROM (SELECT DISTINCT part FROM f), orders, range(1, 6) t(step)),
r AS (SELECT s.part, s.o, s.step, any_value(letter) AS letter,
      count(*) FILTER (gone_at > step) AS kept, count(*) FILTER (gone_at = step) AS removed,
      count(*) FILTER (gone_at < step AND contains(fails, letter)) AS redundant, count(*) FILTER (fails = letter) AS unique_fails,
      count(*) FILTER (gone_at = step AND is_good) AS good_lost, count(*) FILTER (gone_at = step AND is_toxic) AS toxic_lost
      FROM steps s JOIN gone g ON s.part = g.part AND s.o = g.o GROUP BY s.part, s.o, s.step)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, letter AS filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r"""


@query("op11_filter_interaction_audit", _AUDIT_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Five filters in all 120 orders over every whole text, a row for each language, order and step."""
    checks = filter_audit.text_checks(F.col("text"))
    rows = filter_audit.masked(table(spark, folder, "documents"), checks)
    counts = filter_audit.repeats_counted(rows, table(spark, folder, "labels"), len(checks))
    return filter_audit.audited(counts, [*checks, "E"])


_MIX_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS_SQL}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS have, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS weight, 3 * have AS most, sum(have) OVER () AS total FROM s),
v AS (SELECT *, total - coalesce(sum(most) OVER before, 0) AS rest, sum(weight) OVER (ORDER BY most / weight, place
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sharing FROM w
      WINDOW before AS (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT min({{'ratio': most / weight, 'place': place, 'rest': rest, 'sharing': sharing}}) AS lvl FROM v WHERE most * sharing > weight * rest),
t AS (SELECT source, place, CAST(have AS BIGINT) AS have, greatest(ceil(total / {source_schedule.SLOTS}), 1) AS want,
      CASE WHEN most * sharing <= weight * rest THEN CAST(most AS DOUBLE)
           ELSE CAST(weight AS DOUBLE) * CAST(lvl.rest AS DOUBLE) / CAST(lvl.sharing AS DOUBLE) END AS target FROM v, o),
b AS (SELECT *, CAST(least(want, {source_schedule.MOST_WORDS}) AS BIGINT) AS block FROM t),
n AS (SELECT *, CAST(ceil(have / block) AS BIGINT) AS blocks FROM b),
k AS (SELECT *, CASE WHEN have > 0 THEN CAST(floor(target * blocks / have + 0.5) AS BIGINT) ELSE 0 END AS slots FROM n),
p AS (SELECT d.doc_id, d.size, k.*, CAST(sum(d.size) OVER (PARTITION BY place
             ORDER BY md5('{source_schedule.SEED}' || coalesce(CAST(d.doc_id AS VARCHAR), '-')), d.doc_id NULLS FIRST, d.size
             ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start
      FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, have AS source_size, target,
       CASE WHEN have = 0 THEN 0 ELSE slots // blocks * size
            + greatest(least(start + size, slots % blocks * block) - start, 0) END AS taken FROM p"""


@query("op12_source_schedule", _MIX_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return source_schedule.taken(table(spark, folder, "documents").select("doc_id", "source", "text"))


def _manifest_sql(levels: int = 7) -> str:
    """Levels are joined one by one; ``levels`` levels of eight hold 8 ** levels documents a language."""
    def field(c: str) -> str:
        return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"

    def climb(name: str, key: str) -> str:
        """Levels name0, name1, ...: a tree that has one node left keeps it."""
        out = ""
        for i in range(levels):
            out += f""", {name}{i + 1} AS (SELECT {key}, idx // 8 AS idx, CASE WHEN any_value(c) = 1 THEN any_value(h)
  ELSE sha256(string_agg(h, '' ORDER BY idx)) END AS h FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS c FROM {name}{i}) GROUP BY {key}, idx // 8)"""
        return out

    def fold(name: str, key: str, rows: str, at: str) -> str:
        """Each row with the siblings of one level more, and the root folded so far."""
        out, last = "", rows
        for i in range(levels):
            out += f""", {name}f{i} AS (SELECT r.* REPLACE (r.proof || coalesce(l, '') || coalesce(g, '') AS proof,
  CASE WHEN c > 1 THEN sha256(coalesce(l, '') || cur || coalesce(g, '')) ELSE cur END AS cur, r.{at} // 8 AS {at})
  FROM {last} r JOIN (SELECT {key}, idx, count(*) OVER (PARTITION BY {key}) AS c, string_agg(h, '') OVER (PARTITION BY {key}, idx // 8 ORDER BY idx
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, string_agg(h, '') OVER (PARTITION BY {key}, idx // 8 ORDER BY idx
    ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS g FROM {name}{i}) t ON r.{key} = t.{key} AND r.{at} = t.idx)"""
            last = f"{name}f{i}"
        return out

    lowered = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""
WITH d AS (SELECT doc_id, lang, {leaf('text')} AS h, CASE WHEN crc32 % 3 = 0 THEN {leaf(lowered)} ELSE {leaf('text')} END AS cur FROM
  (SELECT *, {_CRC_SQL} AS crc32 FROM documents)),
trees AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM d GROUP BY lang),
a AS (SELECT doc_id, tree, h, cur, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS idx
      FROM d JOIN trees ON d.lang IS NOT DISTINCT FROM trees.lang),
t0 AS (SELECT tree, idx, h FROM a){climb('t', 'tree')},
u0 AS (SELECT 0 AS one, tree AS idx, h FROM t{levels}){climb('u', 'one')},
rows_ AS (SELECT doc_id, tree, h AS leaf, cur, idx, '' AS proof FROM a){fold('t', 'tree', 'rows_', 'idx')},
over_ AS (SELECT *, tree AS spot, 0 AS one FROM tf{levels - 1}){fold('u', 'one', 'over_', 'spot')}
SELECT doc_id, leaf, s.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root.h AS verified
FROM uf{levels - 1} r JOIN t{levels} s ON r.tree = s.tree, u{levels} root"""


# crc32 of the decimal digits, bit by bit with the reflected polynomial 0xEDB88320; null for a null id.
_CRC_SQL = """xor(4294967295, list_reduce([4294967295] || flatten([[ord(x)] || [-1, -1, -1, -1, -1, -1, -1, -1]
  for x in string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x)
  WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""


def tampered_proofs(docs: DataFrame, levels: int = merkle.LEVELS) -> DataFrame:
    """Every document's leaf, proof and roots; a third of the documents is held against its proof with altered text."""
    kept = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = merkle.leaf_digest([*kept, F.col("text")])
    altered = merkle.leaf_digest([*kept, F.translate("text", string.ascii_uppercase, string.ascii_lowercase)])
    made = merkle.manifest(docs.select(F.col("lang").alias("name"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("leaf"),
                                       F.when(fold_is("doc_id", 3, 0), altered).otherwise(leaf).alias("shown")), levels)
    return merkle.proved(made).withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op13_merkle_manifest", _manifest_sql())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest of all documents, a tree for each language, with the proof of each row."""
    return tampered_proofs(table(spark, folder, "documents"))
