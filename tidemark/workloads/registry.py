"""Where queries are registered, and how their SQL counterparts are assembled."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import configure
from tidemark.workloads.fixture_sql import VIEWS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_VIEW = re.compile(r"\bfx_[a-z0-9_]+\b")


def with_views(body: str) -> str:
    """Prefix a statement with the fixture views it mentions, dependencies first."""
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in _VIEW.findall(text):
            if name in VIEWS and name not in ordered:
                need(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    need(body)
    if not ordered:
        return body.strip()
    views = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in ordered)
    return f"WITH {views}\n{body.strip()}"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``oracle`` is the SQL that must give the same rows."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(configure(spark), sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return function

    return register
