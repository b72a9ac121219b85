"""Whole plans: pages of sites to site features and payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sievemill.functions.suffixes import NONE
from sievemill.operators.pages import analyze_pages, with_home
from sievemill.operators.payloads import payloads
from sievemill.operators.site import rollup
from sievemill.plans.lineage import written


def analyze_site(pages: DataFrame, home: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Page reports of one site (pos, url, html), kept in the shared folder, and its row of features."""
    reports = written(analyze_pages(with_home(pages, home)))
    named = reports.select("home_domain").take(1)
    return reports, rollup(reports).withColumn("home_domain", F.lit(named[0]["home_domain"] if named else home or NONE))


def analyze_sites(pages: DataFrame, site: str) -> tuple[DataFrame, DataFrame]:
    """The same for many sites at once (column site): reports, and a row of features per site."""
    reports = written(analyze_pages(with_home(pages, site=site)))
    return reports, rollup(reports, site)


def site_payloads(pages: DataFrame, home: str | None = None) -> DataFrame:
    return payloads(analyze_pages(with_home(pages, home)))
