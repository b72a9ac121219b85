"""Page reports: one row in, one row out, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sievemill.functions import text, urls
from sievemill.functions.suffixes import NONE
from sievemill.operators import scripts, structure, texts
from sievemill.operators.dom import parse
from sievemill.plans.lineage import cut

#: So many sites are broadcast; of more, those with more than pages / HOT_SHARE pages (fewer than HOT_SHARE sites).
BROADCAST_SITES, HOT_SHARE = 50_000, 2_000


def _struct(names: list[str], prefix: str) -> Column:
    return F.struct(*[F.col(prefix + n).alias(n) for n in names])


def with_structure(parsed: DataFrame) -> DataFrame:
    """parsed (dom, home_domain) with the column web_code."""
    dom, home = F.col("dom"), F.col("home_domain")
    parts = {
        "skeleton": structure.skeleton(dom), "forms": structure.forms(dom, home), "css": structure.css(dom, home),
        "hidden_elements": structure.hidden(dom), "metadata": structure.metadata(dom), "resources": structure.resources(dom, home),
        "links": structure.links(dom, home),
    }
    df = parsed.withColumns({f"_w_{k}": c for k, c in parts.items()})
    df = df.withColumn("_w_features", structure.features({k: F.col(f"_w_{k}") for k in parts}, home))
    return df.withColumn("web_code", _struct([*parts, "features"], "_w_")).drop(*[f"_w_{k}" for k in [*parts, "features"]])


def with_scripts(parsed: DataFrame) -> DataFrame:
    """parsed (dom, home_domain) with the column scripts."""
    dom, home = F.col("dom"), F.col("home_domain")
    parts = {
        "inline_scripts": scripts.inline_scripts(dom), "external_scripts": scripts.external_scripts(dom, home),
        "event_handlers": scripts.event_handlers(dom), "javascript_urls": scripts.javascript_urls(dom),
        "json_data_block_count": scripts.data_block_count(dom),
    }
    df = parsed.withColumns({f"_s_{k}": c for k, c in parts.items()})
    df = df.withColumn("_s_features", scripts.features({k: F.col(f"_s_{k}") for k in parts}))
    return df.withColumn("scripts", _struct([*parts, "features"], "_s_")).drop(*[f"_s_{k}" for k in [*parts, "features"]])


def with_text(parsed: DataFrame) -> DataFrame:
    """parsed (dom) with the column text."""
    dom = F.col("dom")
    df = parsed.withColumns({"_t_visible_text": texts.visible_text(dom), "_t_normal": texts.normal_text(dom), "_t_structured": texts.structured(dom)})
    df = df.withColumns(
        {
            "_t_signals": text.signals(F.col("_t_normal")),
            "_t_obfuscation": text.obfuscation(F.col("_t_visible_text")),
            "_t_key_snippets": texts.key_snippets(F.col("_t_structured")),
            "_t_chunks": text.segments(F.col("_t_normal")),
        }
    )
    names = ["visible_text", "structured", "signals", "obfuscation", "key_snippets", "chunks"]
    df = df.withColumn("_t_features", texts.features({k: F.col(f"_t_{k}") for k in names}))
    return df.withColumn("text", _struct([*names, "features"], "_t_")).drop("_t_normal", *[f"_t_{k}" for k in [*names, "features"]])


def with_home(pages: DataFrame, home: str | None = None, site: str | None = None, order: str = "pos") -> DataFrame:
    """pages with the column home_domain: as given, or that of the first page (by order) of each site that has one.

    Up to BROADCAST_SITES sites are broadcast, and no HTML moves.  Of more sites, those with over pages / HOT_SHARE pages are
    broadcast, and only the pages of the others are shuffled.  Pages without a site have no home domain.
    """
    if home is not None:
        return pages.withColumn("home_domain", F.lit(home))
    found = pages.withColumn("_domain", urls.domain(F.col("url")))
    first = F.coalesce(F.min_by("_domain", F.when(F.col("_domain") != NONE, F.struct(order, "url"))), F.lit(NONE)).alias("home_domain")
    if site is None:
        return pages.withColumn("home_domain", F.lit(found.agg(first).first()["home_domain"]))
    homes = cut(found.where(F.col(site).isNotNull()).groupBy(site).agg(first, F.count(F.lit(1)).alias("_n")))
    sites, total = homes.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if sites <= BROADCAST_SITES:
        return pages.join(F.broadcast(homes.drop("_n")), site, "left").fillna(NONE, ["home_domain"])
    limit = total // HOT_SHARE
    hot, cold = (homes.where(c).drop("_n") for c in (F.col("_n") > limit, F.col("_n") <= limit))
    rest = pages.where(F.col(site).isNotNull()).join(F.broadcast(hot.select(site)), site, "left_anti")
    return (
        pages.join(F.broadcast(hot), site)
        .unionByName(rest.join(cold, site))
        .unionByName(pages.where(F.col(site).isNull()).withColumn("home_domain", F.lit(NONE)))
    )


def analyze_pages(pages: DataFrame) -> DataFrame:
    """pages (url, html, home_domain, ...) with the reports web_code, scripts and text in place of html."""
    return with_text(with_scripts(with_structure(parse(pages)))).drop("dom")
