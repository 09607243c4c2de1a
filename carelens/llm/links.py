"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from carelens.llm.shared import cut


LINKS_PER_TASK = 250_000


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b); a component is named by its smallest id.

    Every step points ids at smaller ones of their component until each points
    at the smallest.  A step aggregates minima before it joins them back, so an
    id with very many links is a skewed join side, which Spark splits, and
    never one group.  Each step's links are checkpointed, and a table of few
    links is handled in few tasks: every task of a shuffle or checkpoint writes files of its own.
    """
    links = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = cut(links)
    before = _fingerprint(links)
    tasks = max(1, -(-before[0] // LINKS_PER_TASK))
    links = links.coalesce(tasks)
    while before[0]:
        both = links.union(links.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = cut(large.distinct().coalesce(tasks))
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select("b", "low").union(low.select("a", "low")).where("b != low")
        links = cut(small.toDF("a", "b").distinct().coalesce(tasks))
        after = _fingerprint(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        links.select("b").distinct().select("b", F.col("b").alias("component")))
