"""Evidence in what a page says, as Columns over dom."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from sievemill.functions import text
from sievemill.functions.numbers import rounded
from sievemill.functions.strings import collapse, let
from sievemill.operators.structure import attr, elements, first, raw, said, title

#: Text directly in one of these isn't seen.
UNSEEN = ("script", "style", "noscript", "template", "head", "title", "[document]")
MAX_SNIPPETS = 10


def visible_text(dom: Column) -> Column:
    """The text that readers see; of a part that isn't seen only what is directly in it is left out."""
    return _seen(dom, lambda t: t["text"])


def normal_text(dom: Column) -> Column:
    """visible_text in NFKC form.  Texts are joined by blanks, over which nothing is composed or reordered, so each was normalised alone."""
    return _seen(dom, lambda t: F.coalesce(t["normal"], t["text"]))


def _seen(dom: Column, value: Callable[[Column], Column]) -> Column:
    seen = F.filter(dom["texts"], lambda t: (t["kind"] != "comment") & ~t["parent"].isin(*UNSEEN))
    return collapse(F.array_join(F.transform(seen, value), " "))


def _filled(values: Column) -> Column:
    return F.filter(values, lambda v: v != "")


def structured(dom: Column) -> Column:
    """Texts by the slot in which they stand."""
    def of(*tags: str) -> Column:
        return let(dom["spoken"], lambda spoken: _filled(F.transform(elements(dom, *tags), lambda e: said(spoken, e))))

    def attributes(name: str, *tags: str) -> Column:
        return _filled(F.transform(F.filter(elements(dom, *tags), lambda e: raw(e, name).isNotNull()), lambda e: attr(e, name)))

    pressed = F.filter(elements(dom, "input"), lambda e: F.lower(F.coalesce(raw(e, "type"), F.lit(""))).isin("submit", "button", "reset"))
    description = F.filter(elements(dom, "meta"), lambda e: F.lower(attr(e, "name")) == "description")
    return F.struct(
        title(dom).alias("title"),
        first(F.transform(description, lambda e: attr(e, "content"))).alias("meta_description"),
        of("h1", "h2", "h3", "h4", "h5", "h6").alias("headings"),
        of("p").alias("paragraphs"),
        of("li").alias("list_items"),
        of("a").alias("link_texts"),
        F.concat(of("button"), _filled(F.transform(pressed, lambda e: attr(e, "value")))).alias("button_texts"),
        attributes("alt", "img").alias("image_alts"),
        attributes("aria-label").alias("aria_labels"),
        attributes("placeholder").alias("placeholders"),
        of("label").alias("labels"),
    )


def key_snippets(slots: Column, limit: int = MAX_SNIPPETS) -> Column:
    """The first distinct short texts: title, headings, buttons, description."""
    every = F.concat(F.array(slots["title"]), slots["headings"], slots["button_texts"], F.array(slots["meta_description"]))
    return F.slice(F.array_distinct(_filled(every)), 1, limit)


def features(report: dict[str, Column]) -> Column:
    """The summary of a page's text."""
    found, evasion = report["signals"], report["obfuscation"]
    return F.struct(
        found["char_count"].alias("char_count"),
        found["word_count"].alias("word_count"),
        rounded(found["uppercase_ratio"]).alias("uppercase_ratio"),
        found["exclamation_count"].alias("exclamation_count"),
        *[F.size(found[f"{name}_hits"]).alias(f"{name}_hit_count") for name in text.LEXICONS],
        F.size(found["phone_numbers"]).alias("phone_number_count"),
        F.size(found["emails"]).alias("email_count"),
        F.size(found["crypto_addresses"]).alias("crypto_address_count"),
        found["currency_symbol_count"].alias("currency_symbol_count"),
        evasion["has_zero_width"].alias("has_zero_width"),
        F.size(evasion["mixed_script_words"]).alias("mixed_script_word_count"),
        evasion["has_excessive_spacing"].alias("has_excessive_spacing"),
        F.size(report["chunks"]).alias("chunk_count"),
        report["structured"]["title"].alias("title"),
    )
