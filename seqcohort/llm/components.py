"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqcohort.functions.labels import labels_of  # noqa: F401
from seqcohort.session import checksum, release, settle


def star_step(links: DataFrame, large: bool) -> DataFrame:
    """Point neighbours at the smallest one: larger neighbours of each node (large star), or
    the smaller ones and the node itself (small star)."""
    if large:
        links = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = links.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    joined = links.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return out.filter("a > b").distinct()


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b`` longs): root is the smallest node of
    its component. A hub's links are combined before the shuffle where they are reduced, and
    where they are joined the other side has one row per node."""
    links = settle(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = checksum(links)
    for _ in range(rounds):
        if before[0] == 0:
            break
        before_links, links = links, settle(star_step(star_step(links, True), False))
        release(before_links)
        after = checksum(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
