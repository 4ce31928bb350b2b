"""Queries by name: a Spark callable over a workspace and, where SQL can say it,
the equivalent DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from metermill.functions.numeric import snap_round
from metermill.plans.workspace import Workspace, workspace

from .sqlkit import build

QUERIES: dict[str, Callable] = {}
_RAW: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(ws) -> DataFrame`` under an operator id."""

    def deco(fn: Callable[[Workspace], DataFrame]):
        def run(spark, sf_dir):
            return fn(workspace(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            _RAW[name] = sql
        return fn

    return deco


def oracles() -> dict[str, str]:
    """Complete statements, built once every shared expression is known."""
    return {name: build(sql) for name, sql in _RAW.items()}


def out(df: DataFrame, digits: int = 4, **per: int) -> DataFrame:
    """Result form: decimals and doubles as rounded doubles; ``per`` gives
    single columns their own digits."""
    fixed = {
        f.name: snap_round(F.col(f"`{f.name}`"), per.get(f.name, digits))
        for f in df.schema.fields
        if f.dataType.typeName() in ("double", "float", "decimal")
    }
    return df.withColumns(fixed) if fixed else df
