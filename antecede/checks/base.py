"""Common table expressions of the comparison SQL, and rounding for both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType

DIGITS = 9

CTES = {
    "ev": """
        SELECT event_id AS GlobalEventID,
               CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS day,
               CAST(ts AS DATE) AS event_date,
               rc || CAST(event_id % 4 AS VARCHAR) AS EventCode,
               rc AS EventRootCode,
               CASE WHEN event_type IN ('view', 'click') THEN '1' WHEN event_type = 'purchase'
                    THEN '2' WHEN event_type = 'signup' THEN '3' ELSE '4' END AS QuadClass,
               value / 10.0 - 10.0 AS GoldsteinScale,
               CASE WHEN user_id % 7 = 0 THEN '' ELSE 'ACTOR' || (user_id % 40) END AS Actor1Name,
               'C' || (user_id % 25) AS Actor1CountryCode,
               'GROUP' || (event_id % 30) AS Actor2Name,
               CASE WHEN event_id % 11 = 0 THEN '' ELSE 'C' || (event_id % 25) END
                   AS Actor2CountryCode,
               'G' || (user_id % 10) AS ActionGeo_CountryCode,
               'https://src' || (event_id % 20) || '.example/a/' || event_id AS SOURCEURL
        FROM (SELECT *, CASE event_type WHEN 'view' THEN '01' WHEN 'click' THEN '04'
                     WHEN 'signup' THEN '14' WHEN 'purchase' THEN '06' ELSE '18' END AS rc
              FROM events)""",
    "keyed": """
        SELECT *, least(a, b) || '|' || greatest(a, b) || '|' || EventRootCode AS pair_key
        FROM (SELECT *,
                     coalesce(nullif(Actor1CountryCode, ''), ActionGeo_CountryCode, 'XX') AS a,
                     coalesce(nullif(Actor2CountryCode, ''), ActionGeo_CountryCode, 'XX') AS b
              FROM ev)""",
    "deg": """
        SELECT *, count(*) OVER (PARTITION BY pair_key ORDER BY event_date
                    RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING)
                  AS causal_in_degree
        FROM keyed""",
    "links": """
        SELECT f.GlobalEventID AS later_id, p.GlobalEventID AS earlier_id
        FROM deg f JOIN keyed p ON p.pair_key = f.pair_key
         AND p.event_date >= f.event_date - INTERVAL 7 DAYS AND p.event_date < f.event_date
        WHERE f.causal_in_degree BETWEEN 1 AND 2""",
    "served": """
        SELECT d.*, coalesce(l.ids, '') AS precursor_ids
        FROM deg d LEFT JOIN (
            SELECT later_id, string_agg(CAST(earlier_id AS VARCHAR), ',' ORDER BY earlier_id) AS ids
            FROM links GROUP BY later_id) l ON l.later_id = d.GlobalEventID
        WHERE d.causal_in_degree <= 2""",
}
NEEDS = {
    "keyed": ("ev",), "deg": ("keyed",), "links": ("deg", "keyed"), "served": ("deg", "links"),
}


def define(name: str, sql: str, *needs: str) -> None:
    CTES[name] = sql
    NEEDS[name] = needs


def with_(names: str, body: str, recursive: str = "") -> str:
    """``body`` under the named CTEs and everything they need, each once, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS.get(name, ()):
            visit(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        visit(name)
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in order]
    if recursive:
        return "WITH RECURSIVE " + ", ".join([*parts, recursive]) + " " + body
    return "WITH " + ", ".join(parts) + " " + body if parts else body


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every floating column, as the SQL side does with ``r(...)``."""
    floats = {
        f.name: F.round(F.col(f.name).cast("double"), digits)
        for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))
    }
    return df.withColumns(floats) if floats else df


def as_text(column: Column | str) -> Column:
    """An array column as comma-joined text, for comparison."""
    c = F.col(column) if isinstance(column, str) else column
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
