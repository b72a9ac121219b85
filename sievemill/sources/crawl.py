"""Crawling one site, level by level."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from sievemill.functions import urls
from sievemill.functions.suffixes import NONE, registrable, suffix_rules
from sievemill.operators.dom import parse
from sievemill.operators.structure import link_targets
from sievemill.plans.lineage import cut

#: Levels whose URLs are kept apart until they are merged, so what is known isn't written again at each level.
MERGE = 16


def stored(pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A page source that looks pages (norm_url, html) up; html is null for those that can't be fetched."""
    return lambda frontier: frontier.join(pages.select(F.col("norm_url").alias("norm"), "html"), "norm", "left").select("ord", "url", "norm", "html")


def crawl(spark: SparkSession, seed: str, source: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(pos, url, html) of all pages that can be reached from the seed within its registrable domain.

    url is normalised; pos orders pages as a queue would visit them.  Each URL is fetched once, also if that fails; failed
    pages are left out.  A seed without a domain gives no pages.  Each round is a join, an aggregation and an anti
    join over the new links; only a count comes to the driver.
    """
    home = registrable(seed, suffix_rules())
    if home == NONE:
        return spark.createDataFrame([], "pos long, url string, html string")
    frontier = cut(spark.createDataFrame([(0, seed)], "ord long, url string").withColumn("norm", urls.normalized(F.col("url"))))
    known = [frontier.select("norm")]
    found: DataFrame | None = None
    level = 0
    while frontier.take(1):
        fetched = cut(source(frontier).where(F.col("html").isNotNull()))
        part = fetched.select(F.lit(level).alias("level"), "ord", F.col("norm").alias("url"), "html")
        found = part if found is None else found.union(part)
        links = parse(fetched).select("ord", F.posexplode(link_targets(F.col("dom"))).alias("k", "url"))
        links = links.where(urls.domain(F.col("url")) == home).withColumn("norm", urls.normalized(F.col("url")))
        new = links.groupBy("norm").agg(F.min(F.struct("ord", "k", "url")).alias("first")).join(reduce(DataFrame.union, known), "norm", "left_anti")
        # Sorted by range, the running number of a row grows with its place in the queue.
        new = new.orderBy("first.ord", "first.k").select(F.monotonically_increasing_id().alias("ord"), F.col("first.url").alias("url"), "norm")
        frontier = cut(new)
        known.append(frontier.select("norm"))
        if len(known) >= MERGE:
            known = [cut(reduce(DataFrame.union, known))]
        level += 1
    return found.orderBy("level", "ord").select(F.monotonically_increasing_id().alias("pos"), "url", "html")
