"""Query registry: name -> (spark builder, DuckDB oracle SQL or None).

Every builder takes ``(spark, sf_dir)`` and reads the driver tables through the adapters, so its
work grows with the tables. Floats are rounded to 6 dp on both sides for comparison.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from threadlens.functions.common import round_doubles
from threadlens.plans.views_sql import with_views

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    name: str
    build: Builder
    oracle: str | None
    round_digits: int | None = 6


REGISTRY: dict[str, Entry] = {}


def query(name: str, views: tuple[str, ...] = (), sql: str | None = None, round_digits: int | None = 6,
          dbl: tuple[str, ...] | list[str] = ()):
    """Register a query; ``sql`` is the DuckDB body, prefixed with the adapter CTEs in ``views``.

    ``dbl`` names the double columns of the result; the oracle rounds them like the Spark side.
    """

    def deco(fn: Builder) -> Builder:
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return round_doubles(df, round_digits) if round_digits is not None else df

        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        oracle = with_views(views, sql) if sql is not None else None
        if oracle is not None and dbl:
            repl = ", ".join(f'ROUND(CAST("{c}" AS DOUBLE) + 1e-10, {round_digits or 6}) AS "{c}"' for c in dbl)
            oracle = f"SELECT * REPLACE ({repl}) FROM (\n{oracle}\n) AS _q"
        REGISTRY[name] = Entry(name, build, oracle, round_digits)
        return fn

    return deco


def load_all() -> dict[str, Entry]:
    """Import every ``q_*`` query module so that the registry is complete."""
    import importlib
    import pkgutil

    import threadlens.plans as plans

    for mod in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
        if mod.startswith("q_"):
            importlib.import_module(f"threadlens.plans.{mod}")
    return REGISTRY
