"""Named queries over the given tables, each with a DuckDB twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from vintagekit.plans.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    body: str | None
    needs: tuple[str, ...]

    @property
    def sql(self) -> str | None:
        return with_views(list(self.needs), self.body) if self.body else None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(spark, sf_dir))


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, needs: str = ""):
    """Register a query; `needs` names the shared views its SQL starts from."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = Query(name, build, sql, tuple(needs.split()))
        return build

    return register


def row_text(*fields: str) -> str:
    """DuckDB SQL of a row's text: its fields, each after its length, nulls marked."""
    texts = (f"CAST({f} AS VARCHAR)" for f in fields)
    return " || ".join(f"coalesce(CAST(length({t}) AS VARCHAR) || ':' || {t}, '~')" for t in texts)


def row_sha(*fields: str) -> str:
    return f"sha256({row_text(*fields)})"


VIEWS: dict[str, tuple[str, str]] = {}


def view(name: str, sql: str, needs: str = "") -> None:
    VIEWS[name] = (needs, sql)


def with_views(names: list[str], body: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for dep in VIEWS[n][0].split():
            visit(dep)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n][1].strip()}\n)" for n in order)
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
