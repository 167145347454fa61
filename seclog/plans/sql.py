"""SQL statements over registered tables."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from seclog.operators.tables import first_row

# A comment, a quoted text, or any one character but a semicolon.
_PIECE = re.compile(
    r"""--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|[^;]""", re.S)
_COMMENT = re.compile(r"--[^\n]*|/\*.*?\*/", re.S)


def split_script(script: str) -> list[str]:
    """Statements between semicolons; one inside quotes or a comment does not split. What is a
    comment alone is no statement."""
    statements, position = [""], 0
    while position < len(script):
        piece = _PIECE.match(script, position)
        if piece:
            statements[-1] += piece.group()
            position = piece.end()
        else:
            statements.append("")
            position += 1
    return [s.strip() for s in statements if _COMMENT.sub("", s).strip()]


@dataclass
class Outcome:
    """A statement with its lazy result, or with the reason it has none."""

    statement: str
    result: DataFrame | None = None
    error: str | None = None


def register(tables: Mapping[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, statements: str | list[str]) -> list[Outcome]:
    """Every statement, whether or not others fail.

    A query is checked here and runs when its result is read: read it with ``rows_of``, which holds
    a failure while running like one in the statement.
    """
    if isinstance(statements, str):
        statements = split_script(statements)

    def run(statement: str) -> Outcome:
        try:
            return Outcome(statement, spark.sql(statement))
        except PySparkException as problem:
            return Outcome(statement, error=f"Error executing query '{statement}': {problem}")

    return [run(s) for s in statements]


class Rows(NamedTuple):
    """Rows of a result, the reason there are none, and whether a limit left some out."""

    rows: list
    error: str | None
    more: bool = False


def rows_of(outcome: Outcome, limit: int | None = None) -> Rows:
    """All rows of a statement's result, or the first ``limit`` of them, on the driver."""
    if outcome.result is None:
        return Rows([], outcome.error)
    try:
        if limit is None:
            return Rows(outcome.result.collect(), None)
        found = outcome.result.limit(limit + 1).collect()
        return Rows(found[:limit], None, len(found) > limit)
    except PySparkException as problem:
        return Rows([], f"Error executing query '{outcome.statement}': {problem}")


def first_row_each(tables: Mapping[str, DataFrame], *order: str) -> dict[str, DataFrame]:
    """One row of every table."""
    return {name: first_row(df, *order) for name, df in tables.items()}
