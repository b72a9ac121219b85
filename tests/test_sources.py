"""Crawl, HTTP, CSV, JSON lines, streams and the command line."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sievemill import cli
from sievemill.sources import csv_urls, http, jsonl
from sievemill.sources.crawl import crawl, stored
from sievemill.streaming.pages import page_features, site_counts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SITE = "https://example.com"


def graph(spark, pages):
    rows = [(k, None if v is None else "".join(f"<a href='{x}'>x</a>" for x in v)) for k, v in pages.items()]
    return stored(spark.createDataFrame(rows, "norm_url string, html string"))


def visited(spark, seed, pages):
    return [r["url"] for r in crawl(spark, seed, graph(spark, pages)).orderBy("pos").collect()]


def test_crawl_is_breadth_first_and_stays_on_the_domain(spark):
    pages = {
        SITE: ["/b", "/a#x", "https://evil.com/", "/A"], f"{SITE}/b": ["/c", "/a", "https://sub.example.com/d"], f"{SITE}/a": ["/b/", "HTTPS://EXAMPLE.com/c"],
        f"{SITE}/c": ["/"], "https://sub.example.com/d": [], "https://evil.com/": ["/z"], f"{SITE}/": [],
    }
    assert visited(spark, SITE, pages) == [SITE, f"{SITE}/b", f"{SITE}/a", f"{SITE}/c", "https://sub.example.com/d", f"{SITE}/"]


def test_crawl_of_failing_pages_and_bad_seeds(spark):
    assert visited(spark, SITE, {SITE: None}) == []
    assert visited(spark, SITE, {SITE: ["/a", "/b"], f"{SITE}/a": None, f"{SITE}/b": []}) == [SITE, f"{SITE}/b"]
    assert visited(spark, "not a url", {}) == [] and visited(spark, "", {}) == []


ANSWERS = {
    "html": http.Response(200, "text/html", "<p>"), "empty": http.Response(200, "TEXT/HTML", ""), "xhtml": http.Response(200, "application/xhtml+xml", "x"),
    "json": http.Response(200, "application/json", "{}"), "plain": http.Response(200, "", "x"), "gone": http.Response(404, "text/html"), "moved": http.Response(301), "broken": http.Response(500),
}


def client(url, timeout):
    if url not in ANSWERS:
        raise OSError("no answer")
    return ANSWERS[url]


def test_ping_and_grab():
    assert {u for u in [*ANSWERS, "nowhere"] if http.ping(u, 1, client)} == {"html", "empty", "xhtml", "json", "plain"}
    assert {u: http.grab_html(u, 1, client) for u in [*ANSWERS, "nowhere"]} == {
        "html": "<p>", "empty": "", "xhtml": "x", "json": None, "plain": None, "gone": None, "moved": None, "broken": None, "nowhere": None,
    }


def answer(url, timeout):
    if "b" in url:
        raise OSError
    return http.Response(200, "text/html", "")


def test_ping_tables(spark):
    pinged = http.ping_urls(spark.createDataFrame([("a",), ("b",), ("a",)], "url string"), client=answer)
    good, bad = http.split_by_answer(pinged)
    assert ([r["url"] for r in good.collect()], [r["url"] for r in bad.collect()]) == (["a"], ["b"])
    assert http.ping_main("a", client=answer, spark=spark).collect() == [("a", True)]


def test_fetching_crawl(spark):
    assert [r["url"] for r in crawl(spark, SITE, http.fetcher(answer)).collect()] == [SITE]


def test_csv(spark, tmp_path):
    path = tmp_path / "urls.csv"
    path.write_text("name,url,rank\na,https://a.com,1\nb,,2\nc,https://c.com,3\nd,https://a.com,4\n")
    assert [r["url"] for r in csv_urls.read_urls(spark, str(path)).collect()] == ["https://a.com", "https://c.com", "https://a.com"]
    path.write_text("url\n")
    assert csv_urls.read_urls(spark, str(path)).count() == 0
    for content in ("name\nx\n", ""):
        path.write_text(content)
        with pytest.raises(ValueError):
            csv_urls.read_urls(spark, str(path))


def test_csv_is_pythons(spark, tmp_path):
    import csv

    path = tmp_path / "urls.csv"
    path.write_text('name,url\n"a, b","https://a.com/?q=""b"""\nx,"https://b.com/\nc"\ny,https://c.com/\n"z ""q""",\n')
    with open(path, newline="") as f:
        expected = [r["url"] for r in csv.DictReader(f) if r["url"]]
    assert [r["url"] for r in csv_urls.read_urls(spark, str(path)).collect()] == expected and len(expected) == 3


def test_client_on_a_server():
    """Whatever a server or a URL does, there is an answer or none, and nothing else is raised."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            kind = {"/charset": "text/html; charset=nobody-knows", "/latin": "text/html", "/utf": "text/html; charset=utf-8", "/x": "application/xhtml+xml"}.get(self.path, "text/html")
            body = "<p>é".encode("latin-1" if self.path in ("/latin", "/charset") else "utf-8")
            self.send_response(404 if self.path == "/gone" else 200)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body) + (9 if self.path == "/short" else 0)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        for path in ("/charset", "/latin", "/utf", "/x", "/a b"):
            assert http.grab_html(base + path, 5) == "<p>é" if path != "/a b" else http.ping(base + path, 5)
        for url in (base + "/gone", base + "/short", "http://127.0.0.1:port/", "http://127.0.0.1:1/", "", "no url", "http://[::1", "unknown://x"):
            assert http.grab_html(url, 5) is None and not http.ping(url, 5)
    finally:
        server.shutdown()


def test_pings_are_spread(spark):
    urls = spark.createDataFrame([(f"u{k}",) for k in range(200)], "url string")
    assert http.ping_urls(urls, client=answer, tasks=8).select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_json_lines(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "é")], "k int, x string")
    jsonl.write_jsonl(df, str(tmp_path / "out"))
    assert sorted(json.loads(r["value"])["k"] for r in spark.read.text(str(tmp_path / "out")).collect()) == [1, 2]
    found = spark.createDataFrame([(1, '{"a":[1,null]}', None)], "k int, `f` string, g string")
    assert json.loads(jsonl.lines(found, ("f", "g")).first()["value"]) == {"k": 1, "f": {"a": [1, None]}, "g": None}
    assert jsonl.to_jsonl(df, "k").first()["jsonl"] == '{"k":1,"x":"é"}\n{"k":2,"x":null}'


def test_command_line(spark, tmp_path):
    table = str(tmp_path / "pages")
    spark.createDataFrame([(SITE, "<title>t</title><a href='/a'>a</a>"), (f"{SITE}/a", "<p>free prize</p>")], "norm_url string, html string").write.parquet(table)
    assert cli.main([SITE, "-o", str(tmp_path / "out"), "--pages", table], spark) == 0
    (site,) = (json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out/analysis.jsonl")).collect())
    assert site["page_count"] == 2 and site["site_features"]["total_money_hits"] == 2
    found = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out/payloads.jsonl")).collect()]
    assert {"payload_id", "site", "url", "committee", "artifact_type", "content", "features", "context", "question", "response_schema"} == set(found[0])
    assert all(isinstance(x[k], dict) for x in found for k in ("features", "context", "response_schema"))
    assert cli.main(["nothing", "--pages", table], spark) == 1


def test_stream(spark, tmp_path):
    schema = "url string, html string, home_domain string"
    source = str(tmp_path / "in")
    spark.createDataFrame([("https://a.com/1", "<p>free</p>", "a.com"), ("https://a.com/2", "<form></form>", "a.com")], schema).write.parquet(source)
    for build, name, mode in ((page_features, "features", "append"), (site_counts, "counts", "complete")):
        stream = build(spark.readStream.schema(schema).parquet(source))
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("features").count() == 2
    row = spark.table("counts").select("page_count", "form_count", "total_money_hits").first()
    assert tuple(row) == (2, 1, 1)
