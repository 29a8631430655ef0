"""Name -> query, and name -> the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from callmark.session import ship
from callmark.sources.domain import PRELUDE, Domain

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, prelude: bool = True) -> Callable:
    """Registers f(domain) under its name; sql may use the tables of PRELUDE."""

    def register(f: Callable[[Domain], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Domain(ship(spark), sf_dir))
        if sql:
            ORACLES[f.__name__] = f"WITH {PRELUDE}{',' if sql.lstrip().startswith('+') else ''} {sql.replace('+', '', 1) if sql.lstrip().startswith('+') else sql}" if prelude else sql
        return f

    return register


#: Names that whole-table queries had while another query of theirs read a part of the table only.
FORMER = {"all_facets": "facets", "all_items_without_calls": "items_without_calls", "all_landed_prices": "landed_prices", "set_algebra_of_all": "set_algebra", "whole_queue": "pending_queue", "item_vectors": "mean_pooled", "item_links": "links"}


def load() -> None:
    """Imports the modules that register queries."""
    from callmark.plans import audits, cleaning, details, functions, incremental, leaderboards, listings, opinions, search, texts, views  # noqa: F401

    for old, name in FORMER.items():
        QUERIES[old] = QUERIES[name]
        if name in ORACLES:
            ORACLES[old] = ORACLES[name]


load()
