"""Registrable domains by the public suffix list."""

from __future__ import annotations

import functools
import ipaddress
import zipfile
from collections.abc import Callable
from pathlib import Path

#: What stands for "there is none".
NONE = "None"
#: Where the operating system keeps the list.
SYSTEM_LIST = "/usr/share/publicsuffix/public_suffix_list.dat"
#: Used where neither the system nor Spark's jars have the list.
FALLBACK = ("com", "org", "net", "edu", "gov", "io", "co", "info", "biz", "dev", "app", "de", "fr", "es", "uk", "co.uk", "org.uk", "com.au", "co.jp", "com.br")


def _list_text() -> str | None:
    import pyspark

    for jar in sorted((Path(pyspark.__file__).parent / "jars").glob("httpclient-*.jar")):
        with zipfile.ZipFile(jar) as z:
            if "mozilla/public-suffix-list.txt" in z.namelist():
                return z.read("mozilla/public-suffix-list.txt").decode()
    return Path(SYSTEM_LIST).read_text(encoding="utf-8") if Path(SYSTEM_LIST).exists() else None


@functools.cache
def suffix_rules() -> frozenset[str]:
    """The rules of the list's ICANN section, in lower case, in Unicode and in ASCII form."""
    text = _list_text()
    if text is None:
        return frozenset(FALLBACK)
    rules = set()
    for line in text.split("// ===BEGIN PRIVATE DOMAINS===")[0].splitlines():
        if (rule := line.split()[0].lower() if line.strip() else "") and not rule.startswith("//"):
            rules.add(rule)
            try:
                rules.add(".".join(p if p in ("*",) or p.isascii() else p.encode("idna").decode() for p in rule.split(".")))
            except UnicodeError:
                pass
    return frozenset(rules)


def host_of(url: str) -> str:
    """The host of a URL, or of what looks like one: without scheme, user, port and closing dots, letter case kept."""
    head, slashes, rest = url.partition("//")
    if slashes and (not head or head.endswith(":") and all(c.isascii() and (c.isalnum() or c in "+-.") for c in head[:-1]) and len(head) > 1):
        url = rest
    for mark in "/?#":
        url = url.partition(mark)[0]
    return url.rpartition("@")[-1].partition(":")[0].strip().rstrip(".。．｡")


def registrable(url: str | None, rules: frozenset[str]) -> str:
    """The label before the public suffix, and the suffix; NONE for addresses, unknown suffixes and bare suffixes."""
    return _of_host(host_of(url or ""), rules)


def finder(rules: frozenset[str], most: int = 20_000) -> Callable[[str | None], str]:
    """registrable with a memory of up to most hosts."""
    known: dict[str, str] = {}

    def find(url: str | None) -> str:
        host = host_of(url or "")
        found = known.get(host)
        if found is None:
            if len(known) >= most:
                known.clear()
            found = known[host] = _of_host(host, rules)
        return found

    return find


def _of_host(host: str, rules: frozenset[str]) -> str:
    labels = host.replace("。", ".").split(".")
    low = [x.lower() for x in labels]
    try:
        ipaddress.ip_address(".".join(labels))
        return NONE
    except ValueError:
        pass
    size = 0
    for k in range(len(low)):
        name = ".".join(low[k:])
        if "!" + name in rules:
            size = len(low) - k - 1
            break
        if name in rules or ".".join(["*", *low[k + 1 :]]) in rules and k + 1 < len(low):
            size = len(low) - k
            break
    if not size or size >= len(low) or not labels[-size - 1]:
        return NONE
    return ".".join(labels[-size - 1 :])
