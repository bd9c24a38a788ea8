"""Facts about SQL statements held in a text column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and words that decide the result.
BLOCK_COMMENT = r"/\*[\s\S]*?\*/"
LINE_COMMENT = r"--[^\n]*"
TABLE_NAME = r"([a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)?)"
REFERENCED = r"(?i)\b(?:FROM|JOIN)\s+" + TABLE_NAME + r"\b"
CREATED = r"(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?" + TABLE_NAME + r"\b"
STATEMENT_WORDS = ("SELECT", "CREATE", "INSERT", "UPDATE", "DELETE", "ALTER", "DROP", "WITH")


def strip_comments(sql: Column) -> Column:
    """The statement without block and line comments."""
    return F.regexp_replace(F.regexp_replace(sql, BLOCK_COMMENT, ""), LINE_COMMENT, "")


def referenced_tables(sql: Column) -> Column:
    """Distinct table names after FROM and JOIN."""
    return F.array_distinct(F.regexp_extract_all(sql, F.lit(REFERENCED), F.lit(1)))


def created_tables(sql: Column) -> Column:
    """Distinct table names the statement creates."""
    return F.array_distinct(F.regexp_extract_all(sql, F.lit(CREATED), F.lit(1)))


def _occurrences(text: Column, piece: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / F.lit(len(piece))


def lint(sql: Column) -> Column:
    """The first problem found in the statement, or null when it looks sound."""
    has_word = F.upper(sql).rlike("|".join(STATEMENT_WORDS))
    open_quotes = (_occurrences(sql, "'") - _occurrences(sql, "\\'")).cast("long")
    return (
        F.when(F.coalesce(F.trim(F.translate(sql, "\t\r\n", "   ")), F.lit("")) == "", "empty")
        .when(~has_word, "no keyword")
        .when(_occurrences(sql, "(") != _occurrences(sql, ")"), "unbalanced parentheses")
        .when(open_quotes % 2 != 0, "unterminated string")
    )
