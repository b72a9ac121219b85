"""Columns for script bodies."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from sievemill.functions.strings import WORD, WS, collapse, let, packed, strip

CHUNK_CHARS = 1200

_B, _E = f"(?<!{WORD})", f"(?!{WORD})"
# What a flag looks for.
FLAGS = {
    "uses_eval": rf"{_B}eval{WS}*\(",
    "uses_function_ctor": rf"{_B}new{WS}+Function{_E}|{_B}Function{WS}*\(",
    "uses_base64": rf"{_B}(?:atob|btoa){WS}*\(",
    "uses_document_write": rf"document{WS}*\.{WS}*write",
    "uses_from_char_code": "fromCharCode",
    "uses_redirect": rf"location{WS}*\.{WS}*(?:href|replace|assign)|window{WS}*\.{WS}*location",
    "listens_keyboard": rf"addEventListener{WS}*\({WS}*['\"](?:keydown|keyup|keypress)['\"]|onkey(?:down|up|press)",
    "hooks_forms": rf"addEventListener{WS}*\({WS}*['\"]submit['\"]|\.submit{WS}*\(|onsubmit",
    "uses_cookie_access": rf"document{WS}*\.{WS}*cookie",
}
#: Words of which a body that sets the flag holds one: a search for them spares most bodies the pattern.
HINTS = {
    "uses_eval": ("eval",),
    "uses_function_ctor": ("Function",),
    "uses_base64": ("atob", "btoa"),
    "uses_document_write": ("write",),
    "uses_from_char_code": ("fromCharCode",),
    "uses_redirect": ("location",),
    "listens_keyboard": ("key",),
    "hooks_forms": ("submit",),
    "uses_cookie_access": ("cookie",),
}
#: So many characters without white space are of high entropy.
ENTROPY_CHARS = 200
ESCAPES = (r"(?:\\x[0-9a-fA-F]{2}){4,}", r"(?:\\u[0-9a-fA-F]{4}){4,}", r"(?:%[0-9a-fA-F]{2}){6,}")


def normalize(code: Column) -> Column:
    """Without block comments, white space collapsed; nothing is decoded."""
    return collapse(F.regexp_replace(code, r"(?s)/\*.*?\*/", " "))


def _hinted(code: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, (F.contains(code, F.lit(w)) for w in words))


def features(code: Column) -> Column:
    """What a normalised body uses, as one struct; suspicious_score is the number of flags set."""

    def found(code: Column) -> Column:
        runs = sum((F.regexp_count(code, F.lit(p)) for p in ESCAPES[1:]), F.regexp_count(code, F.lit(ESCAPES[0])))
        return F.struct(
            F.length(code).alias("length"),
            *[(_hinted(code, HINTS[name]) & code.rlike(pattern)).alias(name) for name, pattern in FLAGS.items()],
            F.when(_hinted(code, ("\\", "%")), runs).when(code.isNotNull(), F.lit(0)).alias("long_escape_runs"),
            ((F.length(code) >= ENTROPY_CHARS) & F.exists(F.split(code, WS), lambda w: F.length(w) >= ENTROPY_CHARS)).alias("high_entropy"),
        )

    def scored(f: Column) -> Column:
        score = sum((f[name].cast("int") for name in (*FLAGS, "high_entropy")), (f["long_escape_runs"] > 0).cast("int"))
        return F.struct(*[f[name].alias(name) for name in ("length", *FLAGS, "long_escape_runs", "high_entropy")], score.alias("suspicious_score"))

    return let(let(code, found), scored)


def chunks(code: Column, limit: int = CHUNK_CHARS) -> Column:
    """Windows of whole statements of at most limit characters; a code that fits is one window."""
    body = strip(code)
    return (
        F.when(body == "", F.array().cast("array<string>"))
        .when(F.length(body) <= limit, F.array(body))
        .otherwise(packed(F.filter(F.split(body, "(?<=;)"), lambda x: x != ""), limit, ""))
    )
