"""Structural evidence as Columns over dom (see operators.dom) and home, the site's registrable domain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from sievemill.functions import urls
from sievemill.functions.numbers import rounded
from sievemill.functions.strings import WS, counted, let, strip
from sievemill.functions.suffixes import NONE

# Parts of names of payment fields, link relations that load ahead, and declarations that hide.
PAYMENT = (
    "cardnumber", "card-number", "ccnumber", "cc-number", "creditcard", "credit-card", "cvv", "cvc", "cvn", "cc-csc", "cardexpiry",
    "cc-exp", "exp-date", "expiry", "iban", "sortcode", "sort-code", "routing", "accountnumber", "account-number", "ssn", "socialsecurity",
)
PRELOAD = ("preload", "prefetch", "dns-prefetch", "preconnect", "modulepreload")
_STOP = r"(?:;|!|\z)"
DECLARATIONS = {
    "display": "display:none",
    "visibility": "visibility:hidden",
    "opacity": rf"opacity:0(?:\.0+)?{_STOP}",
    "font": rf"font-size:0(?:px|em|rem|pt)?{_STOP}",
    "indent": r"text-indent:-\d",
    "clip": r"clip:rect\(0",
    "position": r"(?:left|top):-\d{3,}",
}
RESOURCES = (
    ("image", "img", "src"), ("iframe", "iframe", "src"), ("object", "object", "data"), ("embed", "embed", "src"),
    ("media", "source", "src"), ("media", "video", "src"), ("media", "audio", "src"),
)
MAX_HIDDEN, MAX_DOMAINS = 200, 20


def elements(dom: Column, *tags: str) -> Column:
    """The elements of a page, or those of some tags, in document order."""
    every = dom["elements"]
    return F.filter(every, lambda e: e["tag"].isin(*tags)) if tags else every


def raw(e: Column, name: str) -> Column:
    return e["attrs"][name]


def attr(e: Column, name: str) -> Column:
    """An attribute without white space around; a missing one is empty."""
    return F.coalesce(strip(raw(e, name)) if name == "type" or name.startswith("on") else raw(e, name), F.lit(""))


def first(values: Column, default: str = "") -> Column:
    return F.coalesce(F.try_element_at(values, F.lit(1)), F.lit(default))


def said(spoken: Column, e: Column) -> Column:
    """The text in an element.  Bytes are cut in time that doesn't depend on where they stand."""
    return F.substring(spoken, e["at"] + 1, e["size"]).cast("string")


def title(dom: Column) -> Column:
    """The text of the first title."""
    return F.coalesce(said(dom["spoken"], F.try_element_at(elements(dom, "title"), F.lit(1))), F.lit(""))


def identifier(e: Column) -> Column:
    """tag#id.class.class.class, at most 80 characters."""
    own = attr(e, "id")
    classes = F.slice(F.filter(F.split(F.coalesce(raw(e, "class"), F.lit("")), " "), lambda c: c != ""), 1, 3)
    return F.substring(
        F.concat(
            e["tag"], F.when(own != "", F.concat(F.lit("#"), own)).otherwise(""),
            F.when(F.size(classes) > 0, F.concat(F.lit("."), F.array_join(classes, "."))).otherwise(""),
        ), 1, 80,
    )


def skeleton(dom: Column, max_depth: int = 6, max_children: int = 10, max_lines: int = 120) -> Column:
    """Counts, depth and a bounded outline.  The outline has the elements below the root, by indentation; where an
    element has more than max_children children, a line after the last one shown says how many there are besides."""
    every = dom["elements"]
    shown = F.filter(every, lambda e: (e["depth"] >= 2) & (e["depth"] < max_depth + 2) & (e["chain"] < max_children))
    outline = let(shown, lambda shown: _outline(dom, shown, max_children, max_lines))
    has_html = F.exists(every, lambda e: e["depth"] == 1)
    deepest = F.coalesce(F.array_max(F.transform(every, lambda e: e["depth"])), F.lit(0))
    return F.struct(
        F.size(every).alias("element_count"),
        F.when(has_html, deepest).otherwise(F.greatest(deepest, F.lit(1))).alias("max_depth"),
        counted(F.transform(every, lambda e: e["tag"])).alias("tag_counts"),
        outline.alias("outline"),
    )


def _outline(dom: Column, shown: Column, max_children: int, max_lines: int) -> Column:
    every = dom["elements"]
    indent = lambda depth: F.repeat(F.lit("  "), depth - 2)
    lines = F.transform(
        shown, lambda e: F.struct(e["ix"].alias("at"), F.lit(0).alias("late"), F.lit(0).alias("up"), F.concat(indent(e["depth"]), e["tag"]).alias("line"))
    )

    last = F.filter(shown, lambda e: e["sib"] == max_children - 1)

    def children_of(e: Column) -> Column:
        return F.when(e["depth"] == 2, dom["root_children"]).otherwise(F.get(every, e["parent"])["n_child"])

    more = F.transform(
        F.filter(last, lambda e: children_of(e) > max_children),
        lambda e: F.struct(
            e["end"].alias("at"), F.lit(1).alias("late"), (-e["depth"]).alias("up"),
            F.concat(indent(e["depth"]), F.lit("... (+"), (children_of(e) - max_children).cast("string"), F.lit(" more)")).alias("line"),
        ),
    )
    return F.array_join(F.slice(F.transform(F.array_sort(F.concat(lines, more)), lambda x: x["line"]), 1, max_lines), "\n")


def field(e: Column) -> Column:
    kind = F.when(e["tag"] == "input", F.coalesce(F.nullif(F.lower(attr(e, "type")), F.lit("")), F.lit("text"))).otherwise(e["tag"])
    return F.struct(
        F.coalesce(F.nullif(attr(e, "name"), F.lit("")), attr(e, "id")).alias("name"),
        kind.alias("type"),
        F.lower(attr(e, "autocomplete")).alias("autocomplete"),
        attr(e, "placeholder").alias("placeholder"),
        (kind == "hidden").alias("hidden"),
    )


def _names(f: Column) -> Column:
    return F.lower(F.concat(f["name"], F.lit(" "), f["autocomplete"]))


def is_payment(f: Column) -> Column:
    return _names(f).rlike("|".join(PAYMENT))


def is_email(f: Column) -> Column:
    return (f["type"] == "email") | F.contains(_names(f), F.lit("email"))


def forms(dom: Column, home: Column) -> Column:
    """Every form with the fields inside it; fields of a form inside a form count for both."""

    def one(f: Column, inputs: Column) -> Column:
        return let(F.transform(F.filter(inputs, lambda e: (e["ix"] > f["ix"]) & (e["ix"] <= f["end"])), field), lambda fields: form(f, fields))

    def form(f: Column, fields: Column) -> Column:
        return F.struct(
            attr(f, "action").alias("action"),
            f["url"].alias("action_url"),
            f["domain"].alias("action_domain"),
            urls.off_domain(f["domain"], home).alias("action_off_domain"),
            (urls.scheme(f["url"]) == "http").alias("action_insecure"),
            F.lower(attr(f, "method")).alias("method"),
            F.size(fields).alias("input_count"),
            F.size(F.filter(fields, lambda x: x["hidden"])).alias("hidden_input_count"),
            counted(F.transform(fields, lambda x: x["type"])).alias("field_type_counts"),
            F.exists(fields, lambda x: x["type"] == "password").alias("has_password_field"),
            F.exists(fields, is_email).alias("has_email_field"),
            F.exists(fields, is_payment).alias("has_payment_field"),
            fields.alias("fields"),
        )

    return let(elements(dom, "input", "select", "textarea"), lambda inputs: F.transform(elements(dom, "form"), lambda f: one(f, inputs)))


def _squeezed(css: Column) -> Column:
    return F.regexp_replace(F.lower(css), f"{WS}+", "")


def _ref(e: Column, home: Column) -> list[Column]:
    return [e["url"].alias("url"), e["domain"].alias("domain"), urls.off_domain(e["domain"], home).alias("off_domain")]


def _rels(e: Column) -> Column:
    return F.split(F.lower(F.coalesce(raw(e, "rel"), F.lit(""))), " ")


def css(dom: Column, home: Column) -> Column:
    blocks = F.transform(elements(dom, "style"), lambda e: e["code"])
    found = F.filter(elements(dom, "link"), lambda e: raw(e, "href").isNotNull() & F.array_contains(_rels(e), "stylesheet"))
    sheets = F.transform(found, lambda e: F.struct(attr(e, "href").alias("href"), *_ref(e, home)))

    def hiding(block: Column) -> Column:
        first, *others = DECLARATIONS.values()
        return let(_squeezed(block), lambda text: sum((F.regexp_count(text, F.lit(p)) for p in others), F.regexp_count(text, F.lit(first))))

    return F.struct(
        F.size(F.filter(dom["elements"], lambda e: raw(e, "style").isNotNull())).alias("inline_style_count"),
        F.size(blocks).alias("style_block_count"),
        blocks.alias("style_blocks"),
        sheets.alias("stylesheets"),
        F.size(F.filter(sheets, lambda s: s["off_domain"])).alias("third_party_stylesheet_count"),
        F.aggregate(blocks, F.lit(0), lambda acc, b: acc + hiding(b)).alias("suspicious_declaration_count"),
    )


def technique(e: Column) -> Column:
    """How an element is hidden, or null: by the first of the inline style's ways, else by attribute."""
    return let(_squeezed(attr(e, "style")), lambda style: _technique(e, style))


def _technique(e: Column, style: Column) -> Column:
    zero = lambda side: style.rlike(rf"{side}:0(?:px)?{_STOP}")
    return (
        F.when(style.rlike(DECLARATIONS["display"]), "display:none")
        .when(style.rlike(DECLARATIONS["visibility"]), "visibility:hidden")
        .when(style.rlike(DECLARATIONS["opacity"]), "opacity:0")
        .when(style.rlike(DECLARATIONS["font"]), "tiny-font")
        .when(zero("width") & zero("height"), "zero-size")
        .when(style.rlike(DECLARATIONS["indent"]) | style.rlike(DECLARATIONS["position"]), "offscreen")
        .when(style.rlike(DECLARATIONS["clip"]), "clip")
        .when(raw(e, "hidden").isNotNull(), "hidden-attr")
        .when(F.lower(attr(e, "aria-hidden")) == "true", "aria-hidden")
    )


def hidden(dom: Column, limit: int = MAX_HIDDEN) -> Column:
    """The first elements that users don't see."""
    able = F.filter(dom["elements"], lambda e: e["preview"].isNotNull() & ~e["tag"].isin("input", "style", "script", "meta", "link"))
    found = F.transform(
        able,
        lambda e: F.struct(e["tag"].alias("tag"), technique(e).alias("technique"), identifier(e).alias("identifier"), e["preview"].alias("text_preview")),
    )
    return F.slice(F.filter(found, lambda h: h["technique"].isNotNull()), 1, limit)


def metadata(dom: Column) -> Column:
    metas, links = elements(dom, "meta"), F.filter(elements(dom, "link"), lambda e: raw(e, "href").isNotNull())
    equiv = lambda e: F.lower(attr(e, "http-equiv"))

    def named(name: str) -> Column:
        return first(F.transform(F.filter(metas, lambda e: F.lower(attr(e, "name")) == name), lambda e: attr(e, "content")))

    def related(token: str) -> Column:
        return first(F.transform(F.filter(links, lambda e: F.contains(F.lower(F.coalesce(raw(e, "rel"), F.lit(""))), F.lit(token))), lambda e: e["url"]))

    declared = F.transform(F.filter(metas, lambda e: raw(e, "charset").isNotNull()), lambda e: attr(e, "charset"))
    in_type = F.transform(
        F.filter(metas, lambda e: equiv(e) == "content-type"), lambda e: F.regexp_extract(attr(e, "content"), r"(?i)charset=([\p{L}\p{N}_-]+)", 1)
    )
    og = F.transform(
        F.filter(metas, lambda e: F.startswith(F.lower(attr(e, "property")), F.lit("og:"))),
        lambda e: F.struct(F.lower(attr(e, "property")).alias("key"), attr(e, "content").alias("value")),
    )
    og = F.transform(  # of a key that comes again the last value counts, at the place of the first
        F.array_distinct(F.transform(og, lambda x: x["key"])),
        lambda k: F.struct(k.alias("key"), F.element_at(F.filter(og, lambda x: x["key"] == k), -1)["value"].alias("value")),
    )
    refresh = F.transform(
        F.filter(metas, lambda e: equiv(e) == "refresh"),
        lambda e: F.struct(
            strip(F.substring_index(attr(e, "content"), ";", 1)).alias("delay"), refresh_url(attr(e, "content")).alias("url"), e["domain"].alias("domain")
        ),
    )
    return F.struct(
        title(dom).alias("title"),
        named("description").alias("description"),
        named("keywords").alias("keywords"),
        first(F.transform(elements(dom, "html"), lambda e: attr(e, "lang"))).alias("lang"),
        F.when(F.size(declared) > 0, first(declared)).otherwise(first(F.filter(in_type, lambda x: x != ""))).alias("charset"),
        related("icon").alias("favicon"),
        related("canonical").alias("canonical"),
        named("generator").alias("generator"),
        og.alias("og"),
        F.try_element_at(refresh, F.lit(1)).alias("meta_refresh"),
    )


def refresh_url(content: Column) -> Column:
    rest = strip(F.when(F.instr(content, ";") > 0, F.regexp_replace(content, r"(?s)\A[^;]*;", "")).otherwise(F.lit("")))
    return F.when(rest.rlike(r"(?i)\Aurl="), F.regexp_replace(strip(F.substring(rest, 5, 1 << 30)), r"\A['\"]+|['\"]+\z", "")).otherwise(F.lit(""))


def resources(dom: Column, home: Column) -> Column:
    """Images, frames, objects, media and what is loaded ahead: by kind, then in document order."""
    def of(kind: str, tag: str, name: str) -> Column:
        found = F.filter(elements(dom, tag), lambda e: attr(e, name) != "")
        return F.transform(found, lambda e: F.struct(F.lit(kind).alias("kind"), *_ref(e, home)))

    parts = [of(*spec) for spec in RESOURCES]
    ahead = F.filter(elements(dom, "link"), lambda e: raw(e, "href").isNotNull() & F.arrays_overlap(_rels(e), F.lit(list(PRELOAD)).cast("array<string>")))
    return let(F.concat(*parts, F.transform(ahead, lambda e: F.struct(F.lit("preload").alias("kind"), *_ref(e, home)))), _inventory)


def _inventory(every: Column) -> Column:
    return F.struct(
        every.alias("resources"),
        counted(F.transform(every, lambda r: r["kind"])).alias("counts"),
        F.array_sort(F.array_distinct(F.transform(F.filter(every, lambda r: r["off_domain"]), lambda r: r["domain"]))).alias("third_party_domains"),
    )


def links(dom: Column, home: Column) -> Column:
    """Anchors by where they lead."""
    anchors = F.filter(elements(dom, "a"), lambda e: raw(e, "href").isNotNull())

    def kind(e: Column) -> Column:
        low = F.lower(attr(e, "href"))
        return (
            F.when((low == "") | F.startswith(low, F.lit("#")), "other")
            .when(F.startswith(low, F.lit("mailto:")), "mailto")
            .when(F.startswith(low, F.lit("tel:")), "tel")
            .when(low.rlike(r"\A(?:javascript|data):"), "other")
            .when(urls.off_domain(e["domain"], home), "external")
            .otherwise("internal")
        )

    every = F.transform(anchors, lambda e: F.struct(kind(e).alias("kind"), attr(e, "href").alias("href"), e["url"].alias("url"), e["domain"].alias("domain")))
    return let(let(every, _buckets), _link_report)


_BUCKETS: dict[str, Callable[[Column], Column]] = {
    "internal": lambda x: x["url"],
    "external": lambda x: x["url"],
    "mailto": lambda x: F.substring_index(F.substring(x["href"], 8, 1 << 30), "?", 1),
    "tel": lambda x: F.substring(x["href"], 5, 1 << 30),
    "other": lambda x: x["href"],
}


def _buckets(anchors: Column) -> Column:
    def of(name: str, value: Callable[[Column], Column]) -> Column:
        return F.transform(F.filter(anchors, lambda x: x["kind"] == name), value)

    return F.struct(
        *[of(name, value).alias(name) for name, value in _BUCKETS.items()],
        F.array_sort(F.array_distinct(of("external", lambda x: x["domain"]))).alias("external_domains"),
    )


def _link_report(found: Column) -> Column:
    inner, outer = F.size(found["internal"]), F.size(found["external"])
    sizes = {name: F.size(found[name]) for name in _BUCKETS}
    return F.struct(
        *[found[name].alias(name) for name in _BUCKETS],
        found["external_domains"].alias("external_domains"),
        F.struct(*[c.alias(name) for name, c in sizes.items()], sum(list(sizes.values())[1:], sizes["internal"]).alias("total")).alias("counts"),
        F.when(inner + outer > 0, outer / (inner + outer)).otherwise(F.lit(0.0)).alias("outbound_ratio"),
    )


def features(report: dict[str, Column], home: Column) -> Column:
    """The summary of a page's structure."""
    found, refresh = report["forms"], report["metadata"]["meta_refresh"]
    every = report["resources"]["resources"]
    frames = F.filter(every, lambda r: r["kind"] == "iframe")
    third = report["resources"]["third_party_domains"]
    away = (refresh["url"] != "") & urls.off_domain(refresh["domain"], home)
    return F.struct(
        F.size(found).alias("form_count"),
        F.exists(found, lambda f: f["has_password_field"]).alias("has_password_form"),
        F.exists(found, lambda f: f["has_payment_field"]).alias("has_payment_form"),
        F.exists(found, lambda f: f["action_off_domain"]).alias("has_off_domain_form_action"),
        F.exists(found, lambda f: f["action_insecure"]).alias("has_insecure_form_action"),
        F.size(report["hidden_elements"]).alias("hidden_element_count"),
        F.size(frames).alias("iframe_count"),
        F.size(F.filter(frames, lambda r: r["off_domain"])).alias("third_party_iframe_count"),
        F.size(third).alias("third_party_resource_domain_count"),
        F.slice(third, 1, MAX_DOMAINS).alias("third_party_resource_domains"),
        report["css"]["third_party_stylesheet_count"].alias("third_party_stylesheet_count"),
        report["css"]["suspicious_declaration_count"].alias("suspicious_css_declaration_count"),
        report["links"]["counts"]["external"].alias("external_link_count"),
        rounded(report["links"]["outbound_ratio"]).alias("outbound_ratio"),
        refresh.isNotNull().alias("has_meta_refresh"),
        F.coalesce(away, F.lit(False)).alias("meta_refresh_off_domain"),
        report["skeleton"]["max_depth"].alias("max_dom_depth"),
        report["skeleton"]["element_count"].alias("element_count"),
        report["metadata"]["title"].alias("title"),
    )


def link_targets(dom: Column) -> Column:
    """The resolved targets of all anchors, in document order."""
    return F.transform(F.filter(elements(dom, "a"), lambda e: raw(e, "href").isNotNull()), lambda e: e["url"])


__all__ = ["NONE", "css", "elements", "features", "forms", "hidden", "link_targets", "links", "metadata", "resources", "skeleton"]
