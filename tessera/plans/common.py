"""Shared pieces of the query catalogue: registries, rounding, SQL fragments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.values import DEFAULT_MISSING_TOKENS, NUMERIC_PATTERN

QUERIES: dict = {}
ORACLES: dict = {}

LI_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def register(name: str, sql: str | None = None):
    """Decorator: add a (spark, sf_dir) -> DataFrame function, with its DuckDB oracle."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def r6(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


# ----------------------------------------------------------------- SQL fragments
def sql_str_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


TOKENS_SQL = sql_str_list(sorted({t.strip().lower() for t in DEFAULT_MISSING_TOKENS}))


def sql_token_null(expr: str) -> str:
    """DuckDB: trim + missing token -> NULL (same rule as ``null_if_token(trim_ws(...))``)."""
    t = f"trim({expr})"
    return f"(CASE WHEN lower({t}) IN ({TOKENS_SQL}) OR {t} = '' THEN NULL ELSE {t} END)"


def sql_strict_double(expr: str) -> str:
    t = f"trim({expr})"
    return f"(CASE WHEN regexp_matches({t}, '{NUMERIC_PATTERN}') THEN TRY_CAST({t} AS DOUBLE) END)"


def sql_q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'
