"""Query registry: each query is a Spark callable (spark, sf_dir) -> DataFrame
plus, where SQL can express it on whole tables, an equivalent DuckDB SQL string."""

from __future__ import annotations

import functools
from collections.abc import Callable

from postmill.session import let_workers_import

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query. It may be called in a session that this library did not make,
    from any working directory, so Python workers are told where the package lies."""
    def deco(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            let_workers_import(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return deco
