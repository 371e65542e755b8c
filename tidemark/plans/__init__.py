"""Registered queries: each plan module holds ``QUERIES`` and ``ORACLE``."""

from __future__ import annotations

from functools import wraps
from importlib import import_module

MODULES = ["audit", "access", "retrieval", "documents", "records", "streams"]


def _in_utc(query):
    """The tables' zone-less times are UTC, whatever zone the session came with."""

    @wraps(query)
    def run(spark, sf_dir):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)

    return run


def collect() -> tuple[dict, dict]:
    queries, oracle = {}, {}
    for name in MODULES:
        module = import_module(f"tidemark.plans.{name}")
        queries.update({key: _in_utc(query) for key, query in module.QUERIES.items()})
        oracle.update(module.ORACLE)
    return queries, oracle
