"""Columns for signals in visible text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from sievemill.functions.strings import SPACE, WS, collapse, let, matches, packed, strip, tokens

SEGMENT_CHARS = 800

# Phrases whose presence is a signal, in the order in which hits are reported.
URGENCY = (
    "urgent", "immediately", "act now", "right now", "expires", "expire", "limited time", "hurry", "last chance",
    "final notice", "within 24 hours", "24 hours", "asap", "verify now", "don't delay", "deadline",
)
MONEY = (
    "free", "prize", "winner", "you won", "lottery", "cash reward", "reward", "refund", "gift card", "claim your", "bonus",
    "jackpot", "million", "inheritance", "wire transfer", "bitcoin", "cryptocurrency",
)
CREDENTIAL = (
    "password", "verify your account", "confirm your identity", "sign in", "log in", "login", "ssn", "social security",
    "account number", "credit card", "cvv", "security code", "one-time", "otp", "update your payment", "banking details",
)
THREAT = (
    "suspended", "terminated", "locked", "legal action", "arrested", "lawsuit", "penalty", "unauthorized", "fraud detected",
    "account closed", "will be deleted", "police",
)
LEXICONS = {"urgency": URGENCY, "money": MONEY, "credential": CREDENTIAL, "threat": THREAT}
# Patterns of contacts, addresses and marks.
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+"
PHONE = rf"\+?\p{{Nd}}[\p{{Nd}}().\-{WS[1:-1]}]{{7,}}\p{{Nd}}"
LINK = rf"https?://[^{WS[1:-1]}]+"
BTC = r"(?<![\p{L}\p{N}_])(?:bc1|[13])[a-zA-Z0-9]{25,39}(?![\p{L}\p{N}_])"
ETH = r"(?<![\p{L}\p{N}_])0x[a-fA-F0-9]{40}(?![\p{L}\p{N}_])"
CURRENCY = "[$€£¥]"
ZERO_WIDTH = r"[\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}]"
SCRIPTS = (r"[A-Za-z\x{212a}\x{c0}-\x{24f}]", r"[\x{400}-\x{4ff}]", r"[\x{370}-\x{3ff}]")


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def normalize(text: Column) -> Column:
    """NFKC form with white space collapsed."""
    return collapse(_nfkc(text))


def hits(lowered: Column, lexicon: tuple[str, ...]) -> Column:
    """The phrases of a lexicon that occur in a text in lower case."""
    return let(lowered, lambda low: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in lexicon])))


def char_count(text: Column) -> Column:
    return F.length(text)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+"))


def uppercase_ratio(text: Column) -> Column:
    """The share of runs of ASCII letters that have two or more, all capitals."""
    words = F.regexp_count(text, F.lit("[A-Za-z]+"))
    capitals = F.regexp_count(text, F.lit("(?<![A-Za-z])[A-Z]{2,}(?![A-Za-z])"))
    return F.when(words > 0, capitals / words).otherwise(F.lit(0.0))


def exclamation_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))


def currency_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(CURRENCY))


def signals(text: Column) -> Column:
    """All signals of a normalised text, as one struct."""
    lowered = F.lower(text)
    return F.struct(
        char_count(text).alias("char_count"),
        word_count(text).alias("word_count"),
        uppercase_ratio(text).alias("uppercase_ratio"),
        exclamation_count(text).alias("exclamation_count"),
        *[hits(lowered, lexicon).alias(f"{name}_hits") for name, lexicon in LEXICONS.items()],
        matches(text, PHONE).alias("phone_numbers"),
        matches(text, EMAIL).alias("emails"),
        matches(text, LINK).alias("urls_in_text"),
        F.concat(matches(text, BTC), matches(text, ETH)).alias("crypto_addresses"),
        currency_count(text).alias("currency_symbol_count"),
    )


def zero_width_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(ZERO_WIDTH))


def mixed_script_words(text: Column) -> Column:
    """Distinct words with letters of more than one of Latin, Cyrillic and Greek, in the order of first occurrence."""
    def kinds(word: Column) -> Column:
        return sum((word.rlike(s).cast("int") for s in SCRIPTS[1:]), word.rlike(SCRIPTS[0]).cast("int"))

    return F.array_distinct(F.filter(tokens(text), lambda w: kinds(w) > 1))


def longest_letter_run(text: Column) -> Column:
    """The most words in a row that are a single letter."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, word: Column) -> Column:
        run = F.when(word.rlike(r"\A\p{L}\z"), acc["run"] + 1).otherwise(F.lit(0))
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(tokens(text), start, step, lambda acc: acc["best"])


def obfuscation(text: Column) -> Column:
    """Signs of evasion in the raw text, as one struct."""
    count = zero_width_count(text)
    return F.struct(
        (count > 0).alias("has_zero_width"),
        count.alias("zero_width_count"),
        mixed_script_words(text).alias("mixed_script_words"),
        (longest_letter_run(text) >= 4).alias("has_excessive_spacing"),
    )


def segments(text: Column, limit: int = SEGMENT_CHARS) -> Column:
    """Chunks of whole sentences of at most limit characters; longer sentences are cut up."""
    return packed(F.filter(F.split(strip(text), rf"(?<=[.!?]){SPACE}+"), lambda x: x != ""), limit, " ")


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")
