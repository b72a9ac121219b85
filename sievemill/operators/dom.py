"""The one opaque step: HTML to a column of elements and texts, once per page."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from unicodedata import is_normalized, normalize
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from sievemill.functions.suffixes import NONE, finder, suffix_rules

DOCUMENT = "[document]"
#: Elements without content.
VOID = frozenset("area base br col embed hr img input keygen link menuitem meta param source track wbr basefont bgsound command frame image isindex nextid spacer".split())
#: Elements whose strings are of a kind of their own, and don't count as text of what is around.
CONTAINERS = {"script": "script", "style": "style", "template": "template"}
#: Attributes that are lists of words.
LISTS = frozenset(("class", "rel", "rev", "accesskey", "headers", "accept-charset", "sandbox", "archive", "sizes"))
#: Elements whose text is asked for: the stripped strings inside, in a row.  Strings of open elements follow each other, so
#: an element has a place and a size in the page's `spoken`, and no copy of what may stand in many elements at once.
SPOKEN = frozenset("title h1 h2 h3 h4 h5 h6 p li a button label".split())
#: Elements whose own strings are kept as they are.
CODE = frozenset(("script", "style"))
#: Attributes that can hide an element; the beginning of such an element's text is kept.
HIDING = {"style", "hidden", "aria-hidden"}
PREVIEW = 120
#: Attribute values are kept without white space around, but for type and handlers.
#: The attribute of an element that is resolved.
TARGETS = {"a": "href", "link": "href", "form": "action", "img": "src", "iframe": "src", "embed": "src", "source": "src", "video": "src", "audio": "src", "script": "src", "object": "data"}

ELEMENT = T.StructType(
    [
        T.StructField("ix", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("sib", T.IntegerType()),
        T.StructField("chain", T.IntegerType()),
        T.StructField("n_child", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("at", T.IntegerType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("code", T.StringType()),
        T.StructField("preview", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("domain", T.StringType()),
    ]
)
#: normal: the text in NFKC form, where that is another.
TEXT = T.StructType([T.StructField(name, T.StringType()) for name in ("parent", "kind", "text", "normal")])
DOM = T.StructType(
    [
        T.StructField("elements", T.ArrayType(ELEMENT)),
        T.StructField("texts", T.ArrayType(TEXT)),
        T.StructField("spoken", T.BinaryType()),
        T.StructField("root_children", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)
ARROW = to_arrow_type(DOM)
#: Bytes of HTML and number of pages whose DOMs are built and sent together.
CHARS, PAGES = 1 << 18, 1024


class _Builder(HTMLParser):
    """Elements of a page in document order.  Nothing is closed by itself; an end tag closes up to its element, or is ignored."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # of each element: its parent (-1: document), tag, attributes, last element inside, and strings from and to
        self.parents: list[int] = []
        self.tags: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.ends: list[int] = []
        self.firsts: list[int] = []
        self.lasts: list[int] = []
        self.strings: list[tuple[int, str, str]] = []  # element (-1: document), kind, string
        self.open: list[int] = [-1]
        self.kinds: list[str] = ["text"]  # of strings in each open element
        self.opened: dict[str, int] = {}
        self.pending: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._start(tag, attrs)
        if tag in VOID:
            self._end()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._start(tag, attrs)
        self._end()

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if tag not in VOID and self.opened.get(tag):
            while self._end() != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.pending.append(data)

    def handle_comment(self, data: str) -> None:
        self._other("comment", data)

    def handle_decl(self, decl: str) -> None:
        self._other("doctype", decl)

    def handle_pi(self, data: str) -> None:
        self._other("pi", data)

    def unknown_decl(self, data: str) -> None:
        self._other("cdata" if data.upper().startswith("CDATA[") else "declaration", data[6:] if data.upper().startswith("CDATA[") else data)

    def _start(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._flush()
        found = {}
        for name, value in attrs:
            value = value or ""
            found[name] = " ".join(value.split()) if name in LISTS else value if name == "type" or name.startswith("on") else value.strip()
        self.parents.append(self.open[-1])
        self.open.append(len(self.tags))
        self.tags.append(tag)
        self.attrs.append(found)
        self.ends.append(0)
        self.firsts.append(len(self.strings))
        self.lasts.append(0)
        self.kinds.append(CONTAINERS.get(tag, self.kinds[-1]))
        self.opened[tag] = self.opened.get(tag, 0) + 1

    def _end(self) -> str:
        self._flush()
        closed = self.open.pop()
        self.kinds.pop()
        tag = self.tags[closed]
        self.opened[tag] -= 1
        self.ends[closed] = len(self.tags) - 1
        self.lasts[closed] = len(self.strings)
        return tag

    def _flush(self) -> None:
        if self.pending:
            data = "".join(self.pending)
            self.pending = []
            self.strings.append((self.open[-1], self.kinds[-1], data))

    def _other(self, kind: str, data: str) -> None:
        self._flush()
        self.strings.append((self.open[-1], kind, data))

    def finish(self) -> None:
        self._flush()
        while len(self.open) > 1:
            self._end()


#: References that urljoin takes as they are: below an origin, or absolute.  Without dots in a path, parameters, queries and fragments.
_BELOW = re.compile(r"/(?:[A-Za-z0-9_~-]+/?)*").fullmatch
_ABSOLUTE = re.compile(r"https?:(//[A-Za-z0-9.-]+)(?:/[A-Za-z0-9_~/-]*)?").fullmatch


def resolver(base: str, domain: Callable[[str], str]) -> Callable[[str], tuple[str, str]]:
    """The absolute form of a reference and its domain.  A malformed one stays as it is, without a domain."""
    try:
        parts = urlsplit(base)
        origin = f"{parts.scheme}://{parts.netloc}" if parts.scheme in ("http", "https") and parts.netloc else None
    except ValueError:
        origin = None

    own = domain(origin)

    def resolved(ref: str) -> tuple[str, str]:
        if origin is not None and ref:
            if _BELOW(ref):
                return origin + ref, own
            if found := _ABSOLUTE(ref):
                return ref, domain(found[1])
        try:
            url = urljoin(base, ref)
            urlsplit(url)
        except ValueError:
            return ref, NONE
        return url, domain(url)

    return resolved


def refresh_target(content: str) -> str:
    """The URL of a meta refresh, or nothing."""
    rest = content.partition(";")[2].strip()
    return rest[4:].strip().strip("'\"") if rest.lower().startswith("url=") else ""


def _beginning(strings: list[str], first: int, last: int) -> str:
    """The first PREVIEW characters of strings with a blank between; no more strings are read than these need."""
    return " ".join(strings[first : min(last, first + PREVIEW)])[:PREVIEW]


class _Doms:
    """The DOMs of some pages, column by column: an element is no object, and a page costs what its columns take."""

    def __init__(self) -> None:
        self.columns: dict[str, list] = {f.name: [] for f in ELEMENT if f.name != "attrs"}
        self.attr_ends, self.names, self.values = [0], [], []
        self.element_ends, self.text_ends = [0], [0]
        self.texts: dict[str, list] = {f.name: [] for f in TEXT}
        self.spoken: list[bytes] = []
        self.root_children: list[int] = []
        self.errors: list[str | None] = []

    def add(self, html: str | None, url: str | None, domain: Callable[[str | None], str]) -> None:
        """A page.  A null page has no elements; what the tokenizer rejects ends the page there, with an error."""
        b = _Builder()
        error = None
        try:
            b.feed(html or "")
            b.close()
        except (AssertionError, ValueError, NotImplementedError) as e:
            error = f"{type(e).__name__}: {e}"
        b.finish()
        code: dict[int, list[str]] = {}
        spoken: list[str] = []
        before, places = [0], [0]  # spoken strings, and their bytes, before each string
        texts = self.texts
        for owner, kind, data in b.strings:
            if kind in ("script", "style"):
                code.setdefault(owner, []).append(data)
            if short := data.strip():
                if kind in ("text", "cdata"):
                    spoken.append(short)
                    places.append(places[-1] + (len(short) if short.isascii() else len(short.encode())))
                texts["parent"].append(b.tags[owner] if owner >= 0 else DOCUMENT)
                texts["kind"].append(kind)
                texts["text"].append(short)
                texts["normal"].append(None if short.isascii() or is_normalized("NFKC", short) else normalize("NFKC", short))
            before.append(len(spoken))
        root_children = self._elements(b, url or "", domain, code, spoken, before, places)
        self.element_ends.append(len(self.columns["ix"]))
        self.text_ends.append(len(texts["kind"]))
        self.spoken.append("".join(spoken).encode())
        self.root_children.append(root_children)
        self.errors.append(error)

    def _elements(
        self, b: _Builder, base: str, domain: Callable[[str | None], str], code: dict[int, list[str]], spoken: list[str], before: list[int], places: list[int]
    ) -> int:
        n, parents = len(b.tags), b.parents
        root = b.tags.index("html") if "html" in b.tags else -1
        last = b.ends[root] if root >= 0 else n - 1
        children, siblings = [0] * (n + 1), []  # of the document at the end
        for parent in parents:
            siblings.append(children[parent])
            children[parent] += 1
        depths, chains = [], []
        add = {name: column.append for name, column in self.columns.items()}
        add_at, add_size, add_code, add_preview, add_url, add_domain = (add[k] for k in ("at", "size", "code", "preview", "url", "domain"))
        names, values, attr_ends = self.names, self.values, self.attr_ends
        resolved = resolver(base, domain)
        for ix, (tag, attrs, parent) in enumerate(zip(b.tags, b.attrs, parents, strict=True)):
            within = root < ix <= last
            depths.append(1 if ix == root else 0 if not within else 2 if parent == root else depths[parent] + 1)
            sib = siblings[ix]
            chains.append(sib if not within or parent == root else max(chains[parent], sib))
            if tag in SPOKEN:
                at = places[before[b.firsts[ix]]]
                add_at(at)
                add_size(places[before[b.lasts[ix]]] - at)
            else:
                add_at(None)
                add_size(None)
            add_code("".join(code.get(ix, ())) if tag in CODE else None)
            add_preview(_beginning(spoken, before[b.firsts[ix]], before[b.lasts[ix]]) if not HIDING.isdisjoint(attrs) else None)
            names.extend(attrs)
            values.extend(attrs.values())
            attr_ends.append(len(names))
            ref = attrs.get(TARGETS.get(tag, ""))
            if tag == "meta" and attrs.get("http-equiv", "").strip().lower() == "refresh":
                ref = refresh_target(attrs.get("content", "").strip()) or None
            if tag == "form" and not (ref or "").strip():
                add_url(base)
                add_domain(domain(base))
            elif ref is None:
                add_url(None)
                add_domain(None)
            else:
                target, of = resolved(ref.strip())
                add_url(target)
                add_domain(of)
        whole = {"ix": range(n), "end": b.ends, "parent": parents, "depth": depths, "sib": siblings, "chain": chains, "n_child": children[:n], "tag": b.tags}
        for name, column in whole.items():
            self.columns[name].extend(column)
        return children[root]

    def array(self) -> pa.StructArray:
        """The pages as a column of type DOM."""
        element, text = ARROW.field("elements").type, ARROW.field("texts").type
        attrs = element.value_type.field("attrs").type
        pairs = pa.MapArray.from_arrays(pa.array(self.attr_ends, pa.int32()), pa.array(self.names, pa.string()), pa.array(self.values, pa.string())).cast(attrs)
        columns = [pairs if f.name == "attrs" else pa.array(self.columns[f.name], f.type) for f in element.value_type]
        texts = [pa.array(self.texts[f.name], f.type) for f in text.value_type]
        parts = [
            pa.ListArray.from_arrays(pa.array(self.element_ends, pa.int32()), _struct(columns, element.value_type), type=element),
            pa.ListArray.from_arrays(pa.array(self.text_ends, pa.int32()), _struct(texts, text.value_type), type=text),
            pa.array(self.spoken, pa.binary()), pa.array(self.root_children, pa.int32()), pa.array(self.errors, pa.string()),
        ]
        return _struct(parts, ARROW)


def _struct(columns: list[pa.Array], kind: pa.StructType) -> pa.StructArray:
    return pa.StructArray.from_arrays(columns, fields=list(kind))


def tree(html: str | None, url: str | None, rules: frozenset[str]) -> dict:
    """One page as DOM."""
    found = _Doms()
    found.add(html, url, finder(rules))
    return found.array().to_pylist()[0]


def _cuts(sizes: list[int | None]) -> Iterator[tuple[int, int]]:
    """Pages from and to: CHARS of HTML or one page, and PAGES at most."""
    start = seen = 0
    for k, size in enumerate(sizes):
        if k > start and (seen + (size or 0) > CHARS or k - start == PAGES):
            yield start, k
            start, seen = k, 0
        seen += size or 0
    if sizes:
        yield start, len(sizes)


def parse(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages without the HTML, with the column dom.  This is the only place where pages go through Python.

    A batch of DOMs is cut by the size of its HTML, so that what a worker holds depends neither on the number of pages nor,
    but for a single page, on how long they are.
    """
    rules = suffix_rules()
    kept = [c for c in pages.columns if c not in (html, "dom")]
    source = pages.select(*kept, F.col(url).alias("_url"), F.col(html).alias("_html"))
    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField("dom", DOM)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        domain = finder(rules)
        for whole in batches:
            for start, stop in _cuts(pc.binary_length(whole.column(len(kept) + 1)).to_pylist()):
                batch = whole.slice(start, stop - start)
                found = _Doms()
                for u, h in zip(*(batch.column(len(kept) + k).to_pylist() for k in (0, 1)), strict=True):
                    found.add(h, u, domain)
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(kept))] + [found.array()], names=kept + ["dom"])

    return source.mapInArrow(run, schema)
