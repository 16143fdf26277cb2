"""Queries of repeated lines (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import repeated_lines


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand in at least six articles of their source."""
    return repeated_lines.repeated_lines(table(spark, sf_dir, "news_articles")).select("article_id", "line_no").distinct()


def p6_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each article's content without the lines its source repeats."""
    return repeated_lines.without_repeated_lines(table(spark, sf_dir, "news_articles"))


QUERIES = {"p6_found": p6_found, "p6_cleaned": p6_cleaned}

_LINE = "trim(regexp_replace(regexp_replace(regexp_replace(line, '[\\p{Cf}]', '', 'g'), '\\p{Nd}+', '0', 'g'), '[\\t\\x0B\\f\\r\\x1C-\\x1F\\x{85}\\p{Z}]+', ' ', 'g'))"
SQL = {
    "p6_found": f"WITH l AS (SELECT article_id, coalesce(lower(trim(source_code)), '') AS src, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line_no FROM news_articles WHERE content IS NOT NULL), k AS (SELECT article_id, CAST(line_no AS INT) AS line_no, src, lower(upper({_LINE})) AS key FROM l), f AS (SELECT src, key FROM k WHERE key <> '' GROUP BY src, key HAVING count(DISTINCT article_id) >= 6) SELECT DISTINCT article_id, line_no FROM k JOIN f USING (src, key)",
}
