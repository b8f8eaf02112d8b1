"""Reuse of built column expressions.

The geometry expressions are large trees of higher-order functions; building
one from Python costs thousands of JVM calls. A built ``Column`` can be used
in any number of DataFrames of the same session, so expressions that depend
only on column names and parameters are built once per Spark context.
"""

from __future__ import annotations

import functools

from pyspark import SparkContext


def cached_expr(fn):
    """Memoise ``fn(*hashable_args)`` per active Spark context."""
    cache: dict = {}

    @functools.wraps(fn)
    def wrapper(*args):
        sc = SparkContext._active_spark_context
        key = (id(sc._jsc) if sc is not None else None, args)
        hit = cache.get(key)
        if hit is None:
            hit = fn(*args)
            cache[key] = hit
        return hit

    wrapper.cache = cache
    return wrapper
