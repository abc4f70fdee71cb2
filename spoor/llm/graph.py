"""Connected components of links that never leave the cluster: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm import shared


def _ordered(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.filter(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _large(pairs: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the node's smallest neighbour."""
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _ordered(both.join(low, "u").filter("v > u"), "v", "m")


def _small(pairs: DataFrame) -> DataFrame:
    """A node and its neighbours below it are linked to the smallest of them."""
    low = pairs.groupBy("b").agg(F.min("a").alias("m"))
    return _ordered(pairs.join(low, "b").select("m", "a").unionAll(low.select("m", F.col("b").alias("a"))), "m", "a")


def _is_settled(pairs: DataFrame) -> bool:
    """Every node hangs from one node, which hangs from none."""
    ends = pairs.select(F.col("b").alias("node"), F.lit(1).alias("hangs")).unionAll(pairs.select("a", F.lit(0)))
    bad = ends.groupBy("node").agg(F.sum("hangs").alias("n"), F.min("hangs").alias("m")).filter("n > 1 OR n = 1 AND m = 0")
    return bad.limit(1).count() == 0


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b); the component is its smallest node. Rounds grow with the
    logarithm of a component's size; each round is a written table, so a lost executor costs one round at most."""
    spark = links.sparkSession
    pairs = shared.written(_ordered(links, "a", "b"), "links")
    while not _is_settled(pairs):
        after = shared.written(_small(_large(pairs)), "links")
        shared.drop(spark, pairs)
        pairs = after
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(
        pairs.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components after further links: only components that the new links touch are looked at again."""
    name = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_label"))
    between = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(
        F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    # a new node stands for itself until it is linked
    news = links.select(F.col("a").alias("node")).unionAll(links.select("b")).distinct().join(labels, "node", "left_anti")
    merged = components(between).select(F.col("node").alias("old"), F.col("component").alias("new"))
    every = labels.unionAll(news.select("node", F.col("node").alias("component")))
    return every.join(merged, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
