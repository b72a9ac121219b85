"""Fetching pages and testing URLs on the executors, with an exchangeable client."""

from __future__ import annotations

import http.client
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

PING_TIMEOUT, FETCH_TIMEOUT = 15, 30
#: A longer body counts as no answer.
MAX_BODY = 64 << 20
#: URLs are asked by so many tasks.
TASKS = 64
#: Characters of a URL that aren't escaped.
_SAFE = "!#$%&'()*+,/:;=?@[]~"


@dataclass
class Response:
    status: int
    content_type: str = ""
    body: str = ""


#: A client: takes (url, timeout) and gives a response, or raises OSError when none comes.
Client = Callable[[str, int], Response]


def get(url: str, timeout: int) -> Response:
    """The client that asks the network; redirects are followed.

    Whatever isn't a whole answer is an OSError: a URL that can't be asked, a body that ends early or has over MAX_BODY
    bytes.  A body is decoded by the charset that its header names; without one, or if nobody knows it, text/* is
    ISO-8859-1, as HTTP has it, and anything else UTF-8.
    """
    try:
        with urllib.request.urlopen(urllib.parse.quote(url, safe=_SAFE), timeout=timeout) as r:  # noqa: S310
            kind, body = r.headers.get("Content-Type", ""), r.read(MAX_BODY + 1)
            length = r.headers.get("Content-Length", "")
            if len(body) > MAX_BODY or length.isdigit() and len(body) < int(length):
                raise OSError("the body is too long, or ended early")
            usual = "iso-8859-1" if kind.lower().startswith("text/") else "utf-8"
            try:
                return Response(r.status, kind, body.decode(r.headers.get_content_charset() or usual, "replace"))
            except LookupError:
                return Response(r.status, kind, body.decode(usual, "replace"))
    except urllib.error.HTTPError as e:
        return Response(e.code)
    except (ValueError, http.client.HTTPException) as e:
        raise OSError(str(e)) from e


def ping(url: str, timeout: int = PING_TIMEOUT, client: Client = get) -> bool:
    """Whether the URL answers with status 200."""
    try:
        return client(url, timeout).status == 200
    except OSError:
        return False


def grab_html(url: str, timeout: int = FETCH_TIMEOUT, client: Client = get) -> str | None:
    """The page's HTML (it may be empty), or None for whatever isn't an HTML page that answers."""
    if not ping(url, timeout, client):
        return None
    try:
        r = client(url, timeout)
    except OSError:
        return None
    return r.body if r.status < 400 and "html" in r.content_type.lower() else None


def ping_urls(urls: DataFrame, timeout: int = PING_TIMEOUT, client: Client = get, tasks: int = TASKS) -> DataFrame:
    """(url, ok), each distinct URL once, asked by so many tasks."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"url": p["url"], "ok": [ping(u, timeout, client) for u in p["url"]]})

    return urls.select("url").dropDuplicates(["url"]).repartition(tasks, "url").mapInPandas(run, "url string, ok boolean")


def ping_main(source: DataFrame | str, timeout: int = PING_TIMEOUT, client: Client = get, spark=None) -> DataFrame:
    """(url, ok) of a table of URLs, or of a single one."""
    urls = spark.createDataFrame([(source,)], "url string") if isinstance(source, str) else source
    return ping_urls(urls, timeout, client)


def split_by_answer(pinged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that answered, and the others."""
    return pinged.where("ok"), pinged.where(~F.coalesce("ok", F.lit(False)))


def fetcher(client: Client = get, timeout: int = FETCH_TIMEOUT, tasks: int = TASKS) -> Callable[[DataFrame], DataFrame]:
    """A page source for crawl(): takes a frontier (ord, url, norm) and adds html, null where there is none.
    Rows are dealt out by host to so many tasks, so one host is asked by one task at a time."""

    def fetch(frontier: DataFrame) -> DataFrame:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                yield p.assign(html=[grab_html(u, timeout, client) for u in p["url"]])

        host = F.regexp_extract("url", "//([^/?#]*)", 1)
        return frontier.repartition(tasks, host).mapInPandas(run, "ord long, url string, norm string, html string")

    return fetch
