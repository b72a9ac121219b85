"""Evidence in scripts as Columns over dom and home."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sievemill.functions import code, urls
from sievemill.functions.strings import strip
from sievemill.operators.structure import attr, elements, identifier, raw

# Script types that hold data, and the registrable domains of trackers and of content networks.
DATA_TYPES = ("application/ld+json", "application/json", "text/template", "text/html", "application/xml", "text/x-template")
TRACKERS = (
    "google-analytics.com", "googletagmanager.com", "doubleclick.net", "facebook.net", "hotjar.com", "segment.com", "mixpanel.com",
    "scorecardresearch.com", "quantserve.com",
)
NETWORKS = (
    "jsdelivr.net", "unpkg.com", "cloudflare.com", "cloudflareinsights.com", "googleapis.com", "gstatic.com", "bootstrapcdn.com",
    "jquery.com", "cdnjs.com",
)


def _inline(dom: Column) -> Column:
    return F.filter(elements(dom, "script"), lambda e: raw(e, "src").isNull())


def _is_data(e: Column) -> Column:
    return F.lower(attr(e, "type")).isin(*DATA_TYPES)


def inline_code(dom: Column) -> Column:
    """The bodies of scripts that run, without those that are blank."""
    return F.filter(F.transform(F.filter(_inline(dom), lambda e: ~_is_data(e)), lambda e: strip(e["code"])), lambda c: c != "")


def inline_scripts(dom: Column) -> Column:
    def one(body: Column) -> Column:
        return F.struct(body.alias("code"), F.length(body).alias("length"), code.features(body).alias("features"), code.chunks(body).alias("chunks"))

    return F.transform(F.transform(inline_code(dom), code.normalize), one)


def data_block_count(dom: Column) -> Column:
    return F.size(F.filter(_inline(dom), _is_data))


def external_scripts(dom: Column, home: Column) -> Column:
    def one(e: Column) -> Column:
        off = urls.off_domain(e["domain"], home)
        origin = F.when(~off, "first-party").when(e["domain"].isin(*TRACKERS), "known-tracker").when(e["domain"].isin(*NETWORKS), "known-cdn")
        return F.struct(
            attr(e, "src").alias("src"),
            e["url"].alias("url"),
            e["domain"].alias("domain"),
            off.alias("off_domain"),
            origin.otherwise("third-party").alias("origin"),
            raw(e, "async").isNotNull().alias("is_async"),
            raw(e, "defer").isNotNull().alias("is_defer"),
        )

    return F.transform(F.filter(elements(dom, "script"), lambda e: raw(e, "src").isNotNull()), one)


def event_handlers(dom: Column) -> Column:
    """Every attribute whose name begins with "on"."""
    with_any = F.filter(dom["elements"], lambda e: F.exists(F.map_keys(e["attrs"]), lambda k: F.startswith(k, F.lit("on"))))
    return F.flatten(
        F.transform(
            with_any,
            lambda e: F.transform(
                F.filter(F.map_entries(e["attrs"]), lambda a: F.startswith(a["key"], F.lit("on"))),
                lambda a: F.struct(e["tag"].alias("tag"), a["key"].alias("attribute"), a["value"].alias("code"), identifier(e).alias("identifier")),
            ),
        )
    )


def javascript_urls(dom: Column) -> Column:
    """javascript: in any href, then in any src."""
    def of(name: str) -> Column:
        values = F.transform(F.filter(dom["elements"], lambda e: raw(e, name).isNotNull()), lambda e: attr(e, name))
        return F.filter(values, lambda v: F.startswith(F.lower(v), F.lit("javascript:")))

    return F.concat(of("href"), of("src"))


def features(report: dict[str, Column]) -> Column:
    """The summary of a page's scripts."""
    inline, external = report["inline_scripts"], report["external_scripts"]
    any_of = lambda flag: F.exists(inline, lambda s: s["features"][flag])
    return F.struct(
        F.size(inline).alias("inline_script_count"),
        F.size(external).alias("external_script_count"),
        F.size(F.filter(external, lambda e: e["off_domain"])).alias("third_party_script_count"),
        F.size(F.filter(external, lambda e: e["origin"] == "known-tracker")).alias("known_tracker_count"),
        F.size(report["event_handlers"]).alias("event_handler_count"),
        F.size(report["javascript_urls"]).alias("javascript_url_count"),
        report["json_data_block_count"].alias("json_data_block_count"),
        *[
            any_of(f).alias(f)
            for f in ("uses_eval", "uses_base64", "uses_document_write", "uses_redirect", "listens_keyboard", "hooks_forms", "uses_cookie_access")
        ],
        any_of("high_entropy").alias("has_high_entropy_script"),
        F.coalesce(F.array_max(F.transform(inline, lambda s: s["features"]["suspicious_score"])), F.lit(0)).alias("max_suspicious_score"),
        F.aggregate(inline, F.lit(0), lambda acc, s: acc + s["length"]).alias("total_inline_chars"),
    )
