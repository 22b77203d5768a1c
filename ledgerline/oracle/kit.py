"""Small text helpers shared by the checking statements."""

from __future__ import annotations

from ledgerline.bindings import VIEWS, view_sql


def using(*views: str, rest: str = "") -> str:
    """``WITH`` clause holding the named bindings, followed by further expressions."""
    unknown = [v for v in views if v not in VIEWS]
    if unknown:
        raise KeyError(unknown)
    parts = [view_sql(v) for v in views]
    if rest:
        parts.append(rest.strip().rstrip(","))
    return "WITH " + ",\n".join(parts) + "\n"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def rnd(x: str, digits: int = 0) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(30,12)), {digits}) AS DOUBLE)"


def pct(a: str, b: str, digits: int = 2) -> str:
    return rnd(f"{div(a, b)} * 100", digits)


def growth(now: str, before: str, digits: int = 2) -> str:
    return rnd(f"({div(now, before)} - 1) * 100", digits)


def cents(x: str) -> str:
    return f"CAST(ROUND(({x}) * 100) AS BIGINT)"


def money(x: str) -> str:
    return f"(CAST({x} AS DOUBLE) / 100)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def steps(table: str, n: int = 4000) -> str:
    """The table's rows once for each of ``n + 1`` places of a numeric integral."""
    return f"{table}, range({n + 1}) g(i)"


def area(density: str, to: str, table: str, n: int = 4000) -> str:
    """Simpson's rule for a density of x from 0 to ``to``, over the rows of ``steps``."""
    x = f"({to} * i / {n})"
    weight = f"CASE WHEN i IN (0, {n}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"SUM({weight} * {density.replace('x', x).replace(f'e{x}p', 'exp')}) * any_value({to}) / {3 * n}"
