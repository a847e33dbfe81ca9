"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinline.session import written


def _links(df: DataFrame) -> DataFrame:
    """Distinct (a, b) with b < a."""
    return df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of ``links`` (a, b): the smallest node it reaches.

    Each round hangs every node's larger neighbours under the smallest one (large star),
    then its smaller ones (small star), until nothing moves; the rounds needed grow with
    the logarithm of the nodes. A node with very many neighbours is met by joins, which
    Spark can split, and never gathered. Each round is written to the shared folder.
    """
    links = written(_links(links), "links")
    state = _state(links)
    while True:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _links(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("b", "m").union(least.select("a", "m")).toDF("a", "b")
        links = written(_links(small), "links")
        before, state = state, _state(links)
        if state == before:
            break
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = links.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return nodes.union(roots)
