"""Collects the queries and, where SQL can say the same, their oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from zephyrgrid.plans.bindings import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(build):
        QUERIES[name] = build
        if oracle is not None:
            ORACLE[name] = sql(oracle)
        return build
    return keep
