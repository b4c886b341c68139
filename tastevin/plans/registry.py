"""Registered queries of the engine and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import dealt, oracle, view

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(views: list[str], sql: str | None = None, heavy: bool = False):
    """Registers a function of the named views' frames; sql is the oracle over the same views (and base tables). heavy: the
    first frame's rows cost so much work that few partitions are dealt to all cores first."""

    def add(f):
        name = f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            frames = [view(spark, sf_dir, v) for v in views]
            if heavy:
                frames[0] = dealt(frames[0])
            return f(*frames)

        run.__name__, run.__doc__ = name, f.__doc__
        _queries[name] = run
        if sql is not None:
            from ..sources.tables import BASE

            own = [v for v in views if v not in BASE]
            _oracles[name] = oracle(own, sql) if own else sql
        return f

    return add


def _load() -> None:
    from . import aggregates, extraction, joins, merges, scalars, searches, upkeep  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
