"""All registered queries and oracles, merged from the per-group modules."""

from __future__ import annotations

import functools
import importlib

from ..session import ship_package

GROUPS = ("pages", "extraction", "messages", "store", "listing", "crawl", "streams", "errors")


def _shipped(fn):
    """The query, after making sure the Python workers can import this package."""

    @functools.wraps(fn)
    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir)

    return run


def _load():
    queries, oracles = {}, {}
    for g in GROUPS:
        m = importlib.import_module(f"eventpipe.plans.{g}")
        queries.update({k: _shipped(v) for k, v in m.QUERIES.items()})
        oracles.update(m.ORACLES)
    return queries, oracles


def queries():
    return _load()[0]


def oracles():
    return _load()[1]
