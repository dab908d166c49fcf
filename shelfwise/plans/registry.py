"""Catalogue of runnable queries and the SQL each one is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.plans import ctes
from shelfwise.sources.fixtures import Tables

_RUN: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}
_TABLES: dict[str, dict] = {}


def query(name: str, sql: str | None = None, **tables):
    """Register `fn(Tables) -> DataFrame`; `tables` are keyword arguments of Tables."""

    def register(fn):
        if name in _RUN:
            raise ValueError(f"query {name} registered twice")
        _RUN[name] = fn
        _TABLES[name] = tables
        if sql is not None:
            _SQL[name] = sql
        return fn

    return register


def finish(df: DataFrame) -> DataFrame:
    """Comparable output: doubles to 6 digits, integers as long, dates as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            # floor with an off-centre half: decimal ties round up in both engines
            c = F.floor(c.cast("double") * 1e6 + 0.50013) / 1e6
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.TimestampType):
            c = F.to_date(c).cast("string")
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(_RUN[name](Tables(spark, sf_dir, **_TABLES[name])))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(name):
        return lambda spark, sf_dir: run(name, spark, sf_dir)

    return {name: bind(name) for name in _RUN}


def _expand(sql: str) -> str:
    """Prepend the common table expressions `sql` uses, in dependency order."""
    done: dict[str, str] = {}

    def visit(text: str) -> None:
        for variant, name in re.findall(r"\b([cus])_(\w+)\b", text):
            key = f"{variant}_{name}"
            if name in ctes.CTE and key not in done:
                body = ctes.render(name, variant)
                visit(body)
                done.setdefault(key, body)

    visit(sql)
    parts = [f"{k} AS MATERIALIZED (\n{v.strip()}\n)" for k, v in done.items()]
    # a query may bring its own CTEs: "WITH a AS (...) SELECT ..."
    body, opening = sql.strip(), "WITH "
    for start in ("WITH RECURSIVE ", "WITH "):
        if not body.startswith(start):
            continue
        opening = start
        head, select = body[len(start):].rsplit("\n--\n", 1)
        parts.append(head.strip())
        body = select.strip()
        break
    parts.append(f"result AS (\n{body}\n)")
    return opening + ",\n".join(parts)


@lru_cache(maxsize=1)
def oracle_sql() -> dict[str, str]:
    """SQL per query, its result columns brought to the same form as `finish`.

    Column types come from binding each statement against empty tables.
    """
    import duckdb

    con = duckdb.connect()
    con.execute(ctes.TABLE_DDL)
    out = {}
    for name, sql in _SQL.items():
        text = _expand(sql)
        try:
            cols = con.execute(f"DESCRIBE {text}\nSELECT * FROM result").fetchall()
        except duckdb.Error as e:
            raise ValueError(f"SQL of {name} does not bind: {e}") from e
        select = []
        for column, kind, *_ in cols:
            q = f'"{column}"'
            if kind in ("DOUBLE", "FLOAT") or kind.startswith("DECIMAL"):
                q = f"floor(CAST({q} AS DOUBLE) * 1e6 + 0.50013) / 1e6"
            elif kind in ("HUGEINT", "INTEGER", "SMALLINT", "TINYINT", "UBIGINT"):
                q = f"CAST({q} AS BIGINT)"
            elif kind == "DATE":
                q = f"CAST({q} AS VARCHAR)"
            elif kind.startswith("TIMESTAMP"):
                q = f"CAST(CAST({q} AS DATE) AS VARCHAR)"
            select.append(f'{q} AS "{column}"')
        out[name] = f"{text}\nSELECT " + ",\n  ".join(select) + "\nFROM result"
    con.close()
    return out
