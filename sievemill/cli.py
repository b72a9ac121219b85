"""python -m sievemill.cli SEED [-o DIR] [--pages TABLE]: crawl a site and write its analysis and payloads."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, functions as F

from sievemill.operators.payloads import JSON, payloads
from sievemill.plans.analysis import analyze_site
from sievemill.sources import http
from sievemill.sources.crawl import crawl, stored
from sievemill.sources.jsonl import write_jsonl


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 if no page was found.  --pages: a Parquet table (norm_url, html) to look pages up in, not the network."""
    ap = argparse.ArgumentParser(description="Crawl a site and write evidence for reviewers.")
    ap.add_argument("seed_url")
    ap.add_argument("-o", "--out-dir", default=".")
    ap.add_argument("--pages")
    args = ap.parse_args(argv)
    spark = spark or SparkSession.builder.appName("sievemill").getOrCreate()
    source = stored(spark.read.parquet(args.pages)) if args.pages else http.fetcher()
    pages = crawl(spark, args.seed_url, source)
    if not pages.take(1):
        print("No page was found.")
        return 1
    reports, site = analyze_site(pages)
    found = payloads(reports)
    every = reports.select(F.struct("pos", "url", "home_domain", "web_code", "scripts", "text").alias("page"))
    whole = site.withColumns({"site_features": F.struct(*[F.col(c) for c in site.columns if c != "home_domain"])}).select("home_domain", "page_count", "site_features")
    write_jsonl(whole, f"{args.out_dir}/analysis.jsonl")
    write_jsonl(every.select("page.*"), f"{args.out_dir}/pages.jsonl")
    write_jsonl(found.orderBy("seq").drop("seq"), f"{args.out_dir}/payloads.jsonl", JSON)
    print(f"{reports.count()} pages, {found.count()} payloads -> {args.out_dir}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
