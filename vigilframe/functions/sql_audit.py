"""Lint of SQL texts held in a column: one chain of native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keywords that decide the verdict.
BLOCKED = ["COPY", "DO", "CALL", "LISTEN", "NOTIFY", "EXECUTE", "PG_SLEEP", "PG_TERMINATE_BACKEND"]
READ_ONLY = ["SELECT", "WITH", "VALUES", "TABLE", "EXPLAIN"]

LEADING_COMMENTS = r"(?s)^(?:--[^\n]*(?:\n|\z)\s*|/\*.*?\*/\s*|/\*.*\z)+"


def _body(stripped: Column) -> Column:
    """Text after one final semicolon, opening brackets and leading comments are dropped."""
    body = F.regexp_replace(stripped, r";\z", "")
    body = F.regexp_replace(body, r"^[\s(]+", "")
    body = F.regexp_replace(body, LEADING_COMMENTS, "")
    return F.trim(F.regexp_replace(body, r"\s+", " "))


def audit(df: DataFrame, sql_column: str) -> DataFrame:
    """Add ``is_valid`` and ``error_code`` (NULL when valid).

    Quotes are not understood and only the first word is checked against the
    blocked list: a lint over a registry, not a security boundary.
    """
    stripped = F.regexp_replace(F.col(sql_column), r"^\s+|\s+\z", "")
    semicolons = F.length("_s") - F.length(F.replace(F.col("_s"), F.lit(";"), F.lit("")))
    inner_semicolon = (semicolons > 1) | ((semicolons == 1) & ~F.col("_s").endswith(";"))
    words = F.regexp_extract_all(F.upper("_b"), F.lit("([A-Z_]+)"), 1)
    analyze = F.array_contains("_w", "ANALYZE")
    code = (
        F.when(F.col(sql_column).isNull() | (F.col("_s") == ""), "empty")
        .when(inner_semicolon, "multiple_statements")
        .when(F.col("_k").startswith("\\") | F.col("_k").isin(BLOCKED), "blocked_keyword")
        .when((F.col("_k") == "EXPLAIN") & (F.try_element_at("_w", F.lit(2)) == "EXPLAIN"), "nested_explain")
        .when((F.col("_k") == "EXPLAIN") & analyze, "explain_analyze")
        .when(analyze, "analyze")
        .when((F.col("_k") != "") & ~F.col("_k").isin(READ_ONLY), "not_read_only")
    )
    return (
        df.withColumn("_s", stripped)
        .withColumn("_b", _body(F.col("_s")))
        .withColumn("_k", F.upper(F.substring_index("_b", " ", 1)))
        .withColumn("_w", words)
        .withColumn("error_code", code)
        .withColumn("is_valid", F.col("error_code").isNull())
        .drop("_s", "_b", "_k", "_w")
    )
