"""Collects the queries of all plan modules and their checking statements."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline import oracle, plans
from ledgerline.bindings import Bound
from ledgerline.session import tune


def _modules(package):
    for info in pkgutil.iter_modules(package.__path__):
        yield importlib.import_module(f"{package.__name__}.{info.name}")


def _merged(package, attribute: str) -> dict:
    merged: dict = {}
    for module in _modules(package):
        part = getattr(module, attribute, {})
        clash = merged.keys() & part.keys()
        if clash:
            raise ValueError(f"{module.__name__} redefines {sorted(clash)}")
        merged.update(part)
    return merged


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(plan):
        return lambda spark, sf_dir: plan(Bound(tune(spark), sf_dir))

    return {key: bind(plan) for key, plan in _merged(plans, "QUERIES").items()}


def all_sql() -> dict[str, str]:
    return _merged(oracle, "SQL")
