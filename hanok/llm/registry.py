"""Registered queries of this subpackage: ``fn(spark, folder) -> DataFrame`` and, where SQL can say it, the oracle."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class LlmQuery:
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


QUERIES: dict[str, LlmQuery] = {}


def llm_query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = LlmQuery(fn, oracle)
        return fn

    return wrap


def load_all() -> dict[str, LlmQuery]:
    import hanok.llm.queries as pkg

    for info in pkgutil.iter_modules(pkg.__path__):
        importlib.import_module(f"{pkg.__name__}.{info.name}")
    return dict(sorted(QUERIES.items(), key=lambda item: (len(item[0].split("_")[0]), item[0])))
