"""Columns for strings with the semantics of Python's str methods."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Fixed value: the code points that Python counts as white space, as a Java regular expression class.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same class, for Java: one comparison tells the most frequent characters, which are none of it.
SPACE = rf"[[^!-~]&&{WS}]"
NOT_WS = WS.replace("[", "[^", 1)
#: A character of a word.
WORD = r"[\p{L}\p{N}_]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: Spark doesn't share subexpressions inside lambda functions."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+\\z", "")


def collapse(text: Column) -> Column:
    """White space runs become one space; none is left at the ends."""
    return F.btrim(F.regexp_replace(text, f"{SPACE}+", " "))


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda x: x != "")


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def truth(flag: Column) -> Column:
    """True or False, as Python prints them."""
    return F.when(flag, "True").otherwise("False")


def quoted(text: Column) -> Column:
    """The text as Python's repr prints it (control characters other than tab and line ends stay as they are)."""
    escaped = text
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def packed(parts: Column, limit: int, joiner: str) -> Column:
    """Greedy packing: neighbouring parts are joined while they fit into limit; what is longer is cut up."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, part: Column) -> Column:
        fits = F.length(acc["now"]) + len(joiner) + F.length(part) <= limit
        return (
            F.when(acc["now"] == "", F.struct(acc["done"].alias("done"), part.alias("now")))
            .when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["now"], F.lit(joiner), part).alias("now")))
            .otherwise(F.struct(F.array_append(acc["done"], acc["now"]).alias("done"), part.alias("now")))
        )

    whole = F.aggregate(parts, start, step, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])))
    return F.flatten(
        F.transform(
            whole,
            lambda c: F.transform(
                F.sequence(F.lit(0), F.floor((F.length(c) - 1) / limit).cast("int")), lambda k: F.substring(c, k * limit + 1, F.lit(limit))
            ),
        )
    )


def counted(values: Column) -> Column:
    """(value, n) of the distinct values, in the order of their first occurrence."""
    return let(
        values,
        lambda every: F.transform(
            F.array_distinct(every), lambda v: F.struct(v.alias("value"), F.size(F.filter(every, lambda x: x == v)).alias("n"))
        ),
    )
