"""Reuse of large column expressions.

A column is a description that is bound to data only when a plan is analysed,
so the same one serves every query. Building the larger ones takes thousands
of calls into the JVM; doing that once per process keeps queries quick to state.
"""

from __future__ import annotations

import functools

from pyspark import SparkContext


def build_once(builder):
    """Cache a function of hashable arguments that returns columns, per JVM connection."""
    built: dict = {}

    @functools.wraps(builder)
    def cached(*args):
        key = (id(getattr(SparkContext, "_gateway", None)), args)
        if key not in built:
            built[key] = builder(*args)
        return built[key]

    return cached
