"""Registry of query programs: name, pattern, builder and the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .session import make_importable

Builder = Callable[[SparkSession, str], DataFrame]

#: Modules that register queries when imported.
MODULES = (
    "sceneloom.operators.counting",
    "sceneloom.operators.selection",
    "sceneloom.operators.numeric",
    "sceneloom.operators.sequence",
    "sceneloom.operators.relations",
    "sceneloom.operators.geometry",
    "sceneloom.operators.rules",
    "sceneloom.operators.graphs",
    "sceneloom.operators.simulation",
    "sceneloom.operators.scoring",
    "sceneloom.operators.pipeline",
    "sceneloom.operators.streams",
)


@dataclass(frozen=True)
class Query:
    name: str
    pattern: str
    families: tuple[str, ...]
    build: Builder
    oracle: str | None = None
    doc: str = field(default="", compare=False)


_registry: dict[str, Query] = {}


def query(name: str, pattern: str, families: Iterable[str] = (), oracle: str | None = None) -> Callable[[Builder], Builder]:
    """Registers a builder (spark, sf_dir) -> DataFrame. Names are unique."""

    def register(build: Builder) -> Builder:
        if name in _registry:
            raise ValueError(f"query {name} is registered twice")
        _registry[name] = Query(name, pattern, tuple(families), build, oracle, build.__doc__ or "")
        return build

    return register


def load() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(module)
    return _registry


def list_queries(pattern: str | None = None, family: str | None = None) -> list[Query]:
    """Registered queries by name, narrowed by pattern code or operation family."""
    found = (q for q in load().values() if (pattern is None or pattern in q.pattern.split("+")) and (family is None or family in q.families))
    return sorted(found, key=lambda q: q.name)


def all_queries() -> dict[str, Builder]:
    return {q.name: q.build for q in list_queries()}


def all_oracles() -> dict[str, str]:
    return {q.name: q.oracle for q in list_queries() if q.oracle is not None}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    make_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
