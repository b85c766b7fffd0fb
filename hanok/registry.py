"""Registry of runnable queries: a builder over a table folder, the covered survey ids, and an SQL oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, oracle: str | None = None):
    """Register ``fn(star) -> DataFrame`` where ``star`` is a :class:`hanok.starmap.Star`."""

    def wrap(fn):
        from hanok.starmap import Star

        def build(spark, sf_dir):
            return fn(Star(spark, sf_dir))

        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, tuple(covers.split()), build, oracle)
        return fn

    return wrap


def load_all() -> dict[str, Query]:
    import importlib
    import pkgutil

    import hanok.queries as pkg

    for info in pkgutil.iter_modules(pkg.__path__):
        importlib.import_module(f"hanok.queries.{info.name}")
    return REGISTRY
