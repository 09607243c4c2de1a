"""Where the serving layer gets its summaries.

In production the summaries are Parquet tables written by the summarise job
(``folder_summaries``); a query then scans only a small table.  For tests
and the oracle check every query can also derive its summary from a fact
DataFrame on the fly (``fact_summaries``) — the same plan, one stage longer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from carelens.operators.summaries import SUMMARIES
from carelens.sources.tables import read_summary


class FactSummaries:
    """Summary lookup that derives each summary lazily from a fact DataFrame."""

    def __init__(self, fact: DataFrame, store: Callable[[DataFrame], DataFrame] | None = None):
        """``store`` writes a summary and returns what it wrote; each is then built once, however often it is read."""
        self.fact, self.store, self.stored = fact, store, {}

    def __call__(self, name: str) -> DataFrame:
        if self.store is None:
            return SUMMARIES[name](self.fact)
        if name not in self.stored:
            self.stored[name] = self.store(SUMMARIES[name](self.fact))
        return self.stored[name]


class FolderSummaries:
    """Summary lookup over ``<folder>/<summary name>`` Parquet tables, each in its newest complete version."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __call__(self, name: str) -> DataFrame:
        if name not in SUMMARIES:
            raise KeyError(name)
        found = read_summary(self.spark, f"{self.folder}/{name}")
        if found is None:
            raise FileNotFoundError(f"no complete {name} in {self.folder}")
        return found
