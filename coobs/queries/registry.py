"""Registry of queries and their DuckDB oracles, with shared SQL table expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_TABLES: dict[str, tuple[tuple[str, ...], str]] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its inventory id; ``sql`` is the oracle."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(name: str, sql: str, *needs: str) -> None:
    """A named table expression for oracles."""
    _TABLES[name] = (needs, sql.strip())


def oracle(body: str, *needs: str, extra: Mapping[str, str] | None = None) -> str:
    """WITH clause of the needed tables (dependencies first) and the query body."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in _TABLES[n][0]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in needs:
        visit(n)
    parts = [f"{n} AS ({_TABLES[n][1]})" for n in order]
    parts += [f"{n} AS ({s.strip()})" for n, s in (extra or {}).items()]
    head = "WITH " + ",\n".join(parts) + "\n" if parts else ""
    return head + body.strip()


def rs(expr: str, digits: int = 6) -> str:
    """SQL: round, without a negative zero."""
    return f"(round({expr}, {digits}) + 0.0)"


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column (``special`` sets digits per column)."""
    cols: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() in {"double", "float"}:
            c = (F.round(c.cast("double"), special.get(f.name, digits)) + F.lit(0.0)).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def ridge2_stats(y: str, a: str, b: str) -> str:
    """SQL aggregates of a two-predictor ridge: n, means, centred cross products."""
    return (
        f"count(*) AS n, avg({y}) AS my, avg({a}) AS m1, avg({b}) AS m2, var_pop({y}) * count(*) AS yy,"
        f" var_pop({a}) * count(*) AS g11, var_pop({b}) * count(*) AS g22, covar_pop({a}, {b}) * count(*) AS g12,"
        f" covar_pop({y}, {a}) * count(*) AS c1, covar_pop({y}, {b}) * count(*) AS c2"
    )


def ridge2_fit(source: str, keys: str, alpha: str, standardise: bool = False) -> str:
    """SQL: (keys, n, stats.., b0, b1, b2) by Cramer's rule; ``alpha`` may be a column."""
    if standardise:
        # the penalty acts on unit-variance columns: alpha times the variance on the diagonal
        d1, d2 = f"({alpha} * g11 / n)", f"({alpha} * g22 / n)"
    else:
        d1 = d2 = alpha
    det = f"((g11 + {d1}) * (g22 + {d2}) - g12 * g12)"
    return (
        f"SELECT *, my - b1 * m1 - b2 * m2 AS b0 FROM (SELECT *,"
        f" ((g22 + {d2}) * c1 - g12 * c2) / {det} AS b1, ((g11 + {d1}) * c2 - g12 * c1) / {det} AS b2 FROM {source})"
    )


def ridge2_gcv(source: str, keys: str) -> str:
    """SQL: the fit per key whose penalty of 0.1, 1, 10, 100 has the least GCV score."""
    fits = ridge2_fit(f"(SELECT * FROM {source} CROSS JOIN (SELECT unnest([0.1, 1.0, 10.0, 100.0]) AS alpha))", keys, "alpha")
    det = "((g11 + alpha) * (g22 + alpha) - g12 * g12)"
    score = (
        "(yy - 2 * (b1 * c1 + b2 * c2) + b1 * b1 * g11 + 2 * b1 * b2 * g12 + b2 * b2 * g22)"
        f" / (1 - (3 - alpha * (g11 + g22 + 2 * alpha) / {det}) / n) ^ 2"
    )
    return f"SELECT * FROM ({fits}) QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {score}, alpha) = 1"


def ridge2_loo(source: str, rows: str, y: str, a: str, b: str) -> str:
    """SQL: the fit per (property, left-out fold) whose penalty of 0.1, 1, 10, 100 has the least leave-one-out error."""
    fits = ridge2_fit(f"(SELECT * FROM {source} CROSS JOIN (SELECT unnest([0.1, 1.0, 10.0, 100.0]) AS alpha))", "", "alpha")
    det = "((c.g11 + c.alpha) * (c.g22 + c.alpha) - c.g12 * c.g12)"
    da, db = f"(r.{a} - c.m1)", f"(r.{b} - c.m2)"
    leverage = f"(1.0 / c.n + ((c.g22 + c.alpha) * {da} * {da} - 2 * c.g12 * {da} * {db} + (c.g11 + c.alpha) * {db} * {db}) / {det})"
    miss = f"(r.{y} - c.b0 - c.b1 * r.{a} - c.b2 * r.{b}) / (1 - {leverage})"
    return (
        f"SELECT c.* EXCLUDE (err) FROM (SELECT c.*, (SELECT sum(({miss}) ^ 2) FROM {rows} r WHERE r.property = c.property AND r.fold <> c.fold) AS err FROM ({fits}) c) c"
        " QUALIFY row_number() OVER (PARTITION BY property, fold ORDER BY err, alpha) = 1"
    )


def r2_sql(y: str, p: str) -> str:
    return f"(1 - sum(({y} - {p}) ^ 2) / (var_pop({y}) * count(*)))"
