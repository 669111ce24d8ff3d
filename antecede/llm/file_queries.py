"""Queries of the operators that write and read files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from antecede.llm import warc
from antecede.llm.common import table
from antecede.llm.registry import query

_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT html, max(page_id) AS head FROM p GROUP BY html),
d AS (SELECT page_id, head, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex FROM p JOIN h USING (html)),
bits AS (SELECT *, list_transform(range(0, 32), lambda i: list_sum(list_transform(range(0, 5), lambda b:
         (((strpos('0123456789abcdef', hex[(i * 5 + b) // 4 + 1]) - 1) >> (3 - (i * 5 + b) % 4)) & 1) << (4 - b)))) AS five FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(five, lambda v: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(v AS BIGINT) + 1]), '') AS payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> head THEN head END AS refers_to
FROM bits"""


@query("op4_warc", _WARC_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as a WARC record, written to archives and read back from them."""
    return warc.archived(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
