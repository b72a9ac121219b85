"""Reports on streams of pages.  Page operators keep no state, so they are the same as on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sievemill.operators.pages import analyze_pages


def page_features(stream: DataFrame) -> DataFrame:
    """A stream of pages (site, url, html, home_domain) to the three feature structs of each."""
    reports = analyze_pages(stream)
    return reports.select(
        *[c for c in stream.columns if c != "html"],
        F.col("web_code.features").alias("web_code"), F.col("scripts.features").alias("scripts"), F.col("text.features").alias("text"),
    )


def site_counts(stream: DataFrame, site: str = "home_domain") -> DataFrame:
    """Running totals per site, for the update output mode; the state is one row per site."""
    return page_features(stream).groupBy(site).agg(
        F.count(F.lit(1)).alias("page_count"),
        F.sum("web_code.form_count").alias("form_count"),
        F.max("scripts.max_suspicious_score").alias("max_suspicious_script_score"),
        F.sum("text.money_hit_count").alias("total_money_hits"),
    )
