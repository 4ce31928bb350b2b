"""Inline relations: parameters and rule tables as VALUES, so their exact size
is known to the optimizer."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, date):
        return f"DATE'{v.isoformat()}'"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return str(v)


def relation(spark: SparkSession, ddl: Sequence[tuple[str, str]], rows: Iterable[Sequence]) -> DataFrame:
    """Rows of literals as a typed relation; ``ddl`` = [(name, type), ...]."""
    names = ", ".join(n for n, _ in ddl)
    cast = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in ddl)
    rows = [tuple(r) for r in rows]
    if not rows:
        nulls = ", ".join(f"CAST(NULL AS {t}) AS {n}" for n, t in ddl)
        return spark.sql(f"SELECT {nulls} WHERE FALSE")
    body = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT {cast} FROM VALUES {body} AS t({names})")
