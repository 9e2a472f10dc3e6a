"""Registered queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mnemospark.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``fn(tables) -> DataFrame``; ``sql`` may use the views of ``corpus.VIEWS``."""
    from mnemospark.plans.corpus import FOLD_SQL, Tables, tokens_sql, with_views

    def register(fn: Callable[[Tables], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(prepare(spark), sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            filled = sql.replace("__FOLDED__", FOLD_SQL.format("fact"))
            for field in ("entity", "fact"):
                filled = filled.replace(f"__{field.upper()}__", tokens_sql(field))
            SQL[name] = with_views(filled)
        return fn

    return register
