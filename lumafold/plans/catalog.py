"""All registered queries over the supplied tables, and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumafold.plans import blocks, closed, iterative, logs, masks, parts, reports, signals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _part in (masks, blocks, signals, iterative, parts, logs, reports, closed):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
QUERIES = dict(sorted(QUERIES.items()))
