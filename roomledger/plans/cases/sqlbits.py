"""DuckDB spellings shared by the oracle SQL of several cases.

RE2 (DuckDB's regex engine) has ASCII ``\\b`` and no ``(?U)``, so word
boundaries are written as explicit non-word classes, and whitespace uses
the same explicit class as the Spark side.
"""

from __future__ import annotations

import re

from ...functions.text import WS_CLASS

# Outside a word: not a letter, mark, decimal digit or underscore.
NOT_WORD = r"[^\p{L}\p{M}\p{Nd}_]"


def phrase_re2(patterns: list[str]) -> str:
    """``\\bA\\b|\\bB\\b`` -> one case-insensitive RE2 pattern with explicit boundaries."""
    inner = "|".join(re.sub(r"^\\b|\\b$", "", p) for p in patterns)
    return f"(?i)(?:^|{NOT_WORD})(?:{inner})(?:$|{NOT_WORD})"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def contains_any_sql(expr: str, keywords: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(k)})" for k in keywords) + ")"


def strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g')"


def nonempty_sql(expr: str) -> str:
    return f"nullif({expr}, '')"


def ppm_sql(price: str, size: str) -> str:
    """price / size rounded half-even to 1 decimal, exactly, as DOUBLE."""
    pi = f"CAST(({price}) * 10000 AS HUGEINT)"
    si = f"CAST(({size}) * 10000 AS HUGEINT)"
    qv = f"(({pi}) * 10 // ({si}))"
    rv = f"(({pi}) * 10 % ({si}))"
    up = f"CASE WHEN 2 * {rv} > {si} THEN 1 WHEN 2 * {rv} = {si} AND {qv} % 2 = 1 THEN 1 ELSE 0 END"
    return f"CASE WHEN ({price}) > 0 AND ({size}) > 0 THEN CAST({qv} + {up} AS DOUBLE) / 10 END"


def keyed_sql(src: str, address: str = "address", price: str = "price_eur_month") -> str:
    """CTEs ``keyed`` and ``marked`` (W1) over the CTE/view ``src``."""
    return f"""
keyed AS (
  SELECT *, CASE WHEN regexp_matches(_k, '\\p{{Nd}}') AND {price} IS NOT NULL THEN _k END AS dedup_key
  FROM (SELECT *, regexp_replace(lower({address}), '{WS_CLASS}+', '', 'g') AS _k FROM {src})),
marked AS (
  SELECT *, COALESCE(dedup_key IS NOT NULL
                     AND site_rank > min(site_rank) OVER (PARTITION BY dedup_key, {price}), false) AS is_duplicate
  FROM keyed)"""
