"""Builds one DuckDB statement from named, reusable common table expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from metermill.params import driver_scale
from metermill.sources.values import literal as lit

P = driver_scale()
CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def r(expr: str, digits: int) -> str:
    """Same rounding as ``snap_round``: half up after snapping noise away."""
    return f"round(CAST(round(TRY_CAST(({expr}) AS DECIMAL(38,{digits + 4})), {digits}) AS DOUBLE), {digits})"


def d(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def values(alias: str, cols: str, rows) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS {alias}({cols})"


def inlist(items) -> str:
    return "(" + ", ".join(lit(x) for x in items) + ")"


_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _needs(sql: str) -> list[str]:
    seen: list[str] = []
    for w in _WORD.findall(re.sub(r"'[^']*'", "", sql)):
        if w in CTES and w not in seen:
            seen.append(w)
    return seen


def clone(tag: str, given: dict[str, str], wanted: Sequence[str]) -> None:
    """Register <name>__<tag> for every expression in ``wanted`` and what it needs, where that depends on one of ``given``.

    ``given`` are the texts that differ in this copy; they may name other expressions, which are copied as well if they are touched.
    """
    touched: dict[str, bool] = {name: True for name in given}

    def depends(name: str) -> bool:
        if name not in touched:
            touched[name] = False  # a recursive expression names itself
            touched[name] = any([depends(n) for n in _needs(CTES[name])])
        return touched[name]

    def visit(name: str) -> None:
        if f"{name}__{tag}" in CTES:
            return
        text = given.get(name, CTES[name])
        needs = [n for n in _needs(text) if n == name or depends(n)]
        CTES[f"{name}__{tag}"] = _renamed(text, needs, tag)
        for n in needs:
            visit(n)

    for name in wanted:
        visit(name)


def _renamed(text: str, names: Sequence[str], tag: str) -> str:
    if not names:
        return text
    pattern = re.compile(r"(?<![\w.])(" + "|".join(map(re.escape, names)) + r")(?!\w)")
    parts = re.split(r"('(?:[^']|'')*')", text)  # string literals stay
    return "".join(t if i % 2 else pattern.sub(rf"\1__{tag}", t) for i, t in enumerate(parts))


def build(sql: str) -> str:
    """WITH <every CTE the text needs, dependencies first> <text>."""
    order: list[str] = []

    def visit(name: str, path: tuple[str, ...]) -> None:
        if name in order:
            return
        for dep in _needs(CTES[name]):
            if dep != name and dep not in path:
                visit(dep, (*path, name))
        order.append(name)

    for name in _needs(sql):
        visit(name, ())
    sql = sql.strip()
    if not order:
        return sql
    if sql.startswith("WITH "):  # the query's own expressions follow the shared ones
        sql = "," + sql[5:]
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + sql
