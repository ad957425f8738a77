"""Web pages as tables: visible text, links, person cards.

pages(page_id, url, html). One small HTML reader runs per page inside
`mapInPandas`; extraction, vetting and choosing are column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACES, email_fits_name, fold, name_key, name_tokens
from .contacts import addresses, institution_domains, join_email_domain, title_of, vet_emails

_HIDDEN = {"script", "style", "noscript", "svg"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CARDS = {"article", "section", "div", "li", "tr", "td", "dd"}
_HEADINGS = {"h2", "h3", "h4", "h5", "strong", "b"}
_NOT_PROFILE = ("mailto:", "tel:", "#", "javascript:")


class _Element:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        stack = list(reversed(self.children))
        while stack:
            node = stack.pop()
            yield node
            if isinstance(node, _Element):
                stack.extend(reversed(node.children))

    def elements(self):
        return (n for n in self.walk() if isinstance(n, _Element))

    def text(self, glue="\n"):
        return glue.join(s for s in (n.strip() for n in self.walk() if isinstance(n, str)) if s)

    def hrefs(self):
        return [(e.attrs["href"].strip(), e) for e in self.elements() if e.tag == "a" and e.attrs.get("href") is not None]


class _Reader(HTMLParser):
    """Page source to a tree without hidden elements. An end tag closes the nearest open element of its name."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Element("", {}, None)
        self.hidden = []

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.hidden.append(tag)
        if self.hidden:
            return
        element = _Element(tag, dict(attrs), self.at)
        self.at.children.append(element)
        if tag not in _VOID:
            self.at = element

    def handle_startendtag(self, tag, attrs):
        if tag not in _HIDDEN:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.hidden:
            if tag in self.hidden:
                del self.hidden[self.hidden.index(tag):]
            return
        open_ = self.at
        while open_ is not None and open_.tag != tag:
            open_ = open_.parent
        if open_ is not None and open_.parent is not None:
            self.at = open_.parent

    def handle_data(self, data):
        if not self.hidden:
            self.at.children.append(data)


def _read(html: str) -> _Element:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader.root


def _join(base: str, href: str) -> str | None:
    try:
        return urljoin(base or "", href)
    except ValueError:
        return None


def _flat(root: _Element, url: str) -> list[dict]:
    """All nodes in page order: elements, and texts that are not blank. `last` is the number of a node's last descendant."""
    out, stack = [], [(child, 0) for child in reversed(root.children)]
    while stack:
        node, parent = stack.pop()
        number = len(out) + 1
        row = {"number": number, "last": number, "parent": parent, "tag": None, "attrs": None, "href": None, "link": None, "text": None}
        if isinstance(node, _Element):
            href = node.attrs.get("href") if node.tag == "a" else None
            row |= {"tag": node.tag, "attrs": {k: v or "" for k, v in node.attrs.items()}}
            if href is not None:
                row |= {"href": href.strip(), "link": _join(url, href.strip())}
            stack.extend((child, number) for child in reversed(node.children))
        elif text := node.strip():
            row["text"] = text
        else:
            continue
        out.append(row)
    for row in reversed(out):
        if row["parent"]:
            above = out[row["parent"] - 1]
            above["last"] = max(above["last"], row["last"])
    return out


def _mailtos(element: _Element) -> list[str]:
    return [h[7:].split("?", 1)[0] for h, _ in element.hrefs() if h.lower().startswith("mailto:")]


def _page_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for page_id, url, html in zip(batch["page_id"], batch["url"], batch["html"]):
            root = _read(html)
            links = [
                {"url": joined, "text": a.text(" ")}
                for href, a in root.hrefs()
                if href.startswith(("http", "/")) and not href.lower().startswith("mailto:") and (joined := _join(url, href))
            ]
            out.append((page_id, url, root.text(), _mailtos(root), links))
        yield pd.DataFrame(out, columns=["page_id", "url", "text", "mailtos", "links"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """Visible text, mailto targets and resolved links of every page; malformed links are left out."""
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, mailtos array<string>, links array<struct<url:string,text:string>>"
    return pages.select("page_id", "url", "html").mapInPandas(_page_rows, schema)


def page_contacts(pages: DataFrame, people: DataFrame, institutions: DataFrame) -> DataFrame:
    """Address and title from a person's own page.

    people(person_id, name, institution_id, page_id). The first address that
    fits the name and, when the institution's domains are known, is on one;
    mailto targets come before the text. The title is read from the whole visible text.
    """
    read = extract_pages(pages.join(people.select("page_id").distinct(), "page_id", "left_semi"))
    mine = read.join(people.select("page_id", "person_id", "institution_id"), "page_id")
    found = mine.select(
        "person_id", "institution_id",
        F.posexplode(F.concat(addresses(F.array_join("mailtos", "\n")), addresses(F.col("text")))).alias("pos", "email"),
    )
    domains = institution_domains(institutions)
    fitting = vet_emails(found, people)
    on_domain = join_email_domain(fitting, domains).unionByName(
        fitting.join(domains, "institution_id", "left_anti"), allowMissingColumns=True
    )
    best = on_domain.groupBy("person_id").agg(F.min_by("email", "pos").alias("email"))
    titles = mine.select("person_id", title_of(F.col("text")).alias("title"))
    return titles.join(best, "person_id", "left").select("person_id", "email", "title")


# --- directories ------------------------------------------------------------------------------------

_TOKEN = re.compile(r"(?:\[[^\]]*\]|[^\s>,\[])+|[>,]")
_TEST = re.compile(r"""([.#]?)([\w-]+)|\[\s*([\w-]+)\s*(?:([*^$~|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]*))\s*)?\]|(\*)""")
def _compound(text: str) -> list[tuple]:
    """Tests of one element: (kind, name, comparison, value)."""
    tests, at = [], 0
    while at < len(text):
        m = _TEST.match(text, at)
        if not m:
            raise ValueError(f"selector is not supported: {text!r}")
        mark, word, attr, op, *values, _any = m.groups()
        if attr:
            tests.append(("attr", attr, op, next((v for v in values if v is not None), "")))
        elif word:
            tests.append(({".": "class", "#": "id", "": "tag"}[mark], word if mark else word.lower(), None, None))
        at = m.end()
    return tests


def parse_selector(selector: str) -> list[list[tuple[str, list[tuple]]]]:
    """Alternatives of steps (" " inside, ">" child of, tests). Anything but types, classes, ids and attributes raises."""
    paths: list[list] = [[]]
    link = " "
    for token in _TOKEN.findall(selector):
        if token == ",":
            paths.append([])
            link = " "
        elif token == ">":
            if link == ">" or not paths[-1]:
                raise ValueError(f"selector is not supported: {selector!r}")
            link = ">"
        else:
            paths[-1].append((link, _compound(token)))
            link = " "
    if link == ">" or not all(paths):
        raise ValueError(f"selector is not supported: {selector!r}")
    return paths


def _fits(tests: list[tuple]) -> Column:
    """The tests of one step on a row of an element."""
    have = lambda name: F.coalesce(F.col("attrs")[name], F.lit(""))
    words = lambda c: F.split(c, SPACES)
    fits = F.col("tag").isNotNull()
    for kind, name, op, want in tests:
        if kind == "class":
            fits &= F.array_contains(words(have("class")), name)
        elif kind == "id":
            fits &= have("id") == name
        elif kind == "tag":
            fits &= F.col("tag") == name
        else:
            fits &= F.col("attrs")[name].isNotNull()
            if op == "=":
                fits &= have(name) == want
            elif op == "|=":
                fits &= (have(name) == want) | have(name).startswith(want + "-")
            elif op is not None and want == "":
                fits &= F.lit(False)
            elif op == "*=":
                fits &= have(name).contains(want)
            elif op == "^=":
                fits &= have(name).startswith(want)
            elif op == "$=":
                fits &= have(name).endswith(want)
            elif op == "~=":
                fits &= F.array_contains(words(have(name)), want)
    return F.coalesce(fits, F.lit(False))


def _inside(matched: str) -> Column:
    """A node lies in an earlier node that matched: those that began before it and have not ended contain it."""
    before = Window.partitionBy("_page").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(F.when(F.col(matched), F.col("last"))).over(before) >= F.col("number"), F.lit(False))


def _child_of(nodes: DataFrame, matched: str) -> DataFrame:
    """`_below`: the node's parent matched. Every node stands once with its children and once with its siblings."""
    roles = F.array(F.struct(F.col("number").alias("family"), F.lit(True).alias("head")), F.struct(F.col("parent").alias("family"), F.lit(False).alias("head")))
    both = nodes.withColumn("_r", F.explode(roles)).select(*nodes.columns, "_r.family", "_r.head")
    family = Window.partitionBy("_page", "family")
    return both.withColumn("_below", F.max(F.col("head") & F.col(matched)).over(family)).where(~F.col("head")).drop("family", "head")


def _with_selected(nodes: DataFrame, selector: str) -> DataFrame:
    """Rows of nodes with `selected`: the element ends a chain of the selector's steps."""
    columns = nodes.columns
    chosen = []
    for n, steps in enumerate(parse_selector(selector)):
        for i, (link, tests) in enumerate(steps):
            step, before = f"_s{n}_{i}", f"_s{n}_{i - 1}"
            if i == 0:
                nodes = nodes.withColumn(step, _fits(tests))
            elif link == ">":
                nodes = _child_of(nodes, before).withColumn(step, _fits(tests) & F.col("_below")).drop("_below")
            else:
                nodes = nodes.withColumn(step, _fits(tests) & _inside(before))
        chosen.append(F.col(step))
    return nodes.select(*columns, reduce(Column.__or__, chosen).alias("selected"))


_NODE = "struct<number:int,last:int,parent:int,tag:string,attrs:map<string,string>,href:string,link:string,text:string>"


def _nodes_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        nodes = [_flat(_read(html), url) for url, html in zip(batch["url"], batch["html"])]
        yield pd.DataFrame({"_page": batch["_page"], "page_id": batch["page_id"], "nodes": nodes})


def page_nodes(pages: DataFrame) -> DataFrame:
    """Every page as an array of its nodes in order: _page, page_id, nodes. Equal pages are one; `_page` tells the others apart."""
    id_type = pages.schema["page_id"].dataType.simpleString()
    keyed = pages.select(F.sha2(F.to_json(F.struct("page_id", "url", "html")), 256).alias("_page"), "page_id", "url", "html")
    read = keyed.mapInPandas(_nodes_of, f"_page string, page_id {id_type}, nodes array<{_NODE}>")
    return read.groupBy("_page").agg(F.first("page_id").alias("page_id"), F.first("nodes").alias("nodes"))


def select_elements(pages: DataFrame, selector: str) -> DataFrame:
    """Elements of the pages that a selector of types, classes, ids and attributes names, in page order (D3). -> page_id, number, last, tag, attrs"""
    rows = page_nodes(pages).select("_page", "page_id", F.inline("nodes"))
    return _with_selected(rows, selector).where("selected").select("page_id", "number", "last", "tag", "attrs")


def _cards(nodes: DataFrame, card) -> DataFrame:
    """A row per element that `card` (a test of a node) takes, with the content below it: texts, mailto targets, name, links."""

    def below(n):
        return F.slice(F.col("nodes"), n["number"] + 1, n["last"] - n["number"])

    def content(c):
        part = below(c)
        text = F.array_join(part["text"], "\n")
        mails = F.filter(part, lambda n: F.lower(n["href"]).startswith("mailto:"))
        heading = F.get(F.filter(part, lambda n: F.coalesce(n["tag"].isin(*_HEADINGS), F.lit(False))), F.lit(0))
        links = F.filter(part, lambda n: n["link"].isNotNull() & ~reduce(Column.__or__, [F.lower(n["href"]).startswith(x) for x in _NOT_PROFILE]))
        return F.struct(
            c["number"].alias("element"), c["last"].alias("last"), text.alias("text"),
            F.transform(mails, lambda n: F.substring_index(n["href"].substr(F.lit(8), F.length(n["href"])), "?", 1)).alias("mailtos"),
            F.when(heading.isNotNull(), F.array_join(below(heading)["text"], " ")).otherwise(F.substring_index(text, "\n", 1)).alias("name"),
            F.transform(links, lambda n: F.struct(n["link"].alias("url"), F.array_join(below(n)["text"], " ").alias("text"))).alias("links"),
        )

    return nodes.select("_page", "page_id", F.inline(F.transform(F.filter("nodes", card), content)))


def directory_entries(pages: DataFrame, item_selector: str | None = None) -> DataFrame:
    """One row per person card of a directory page (D3).

    With a selector every matching element is a card; without one, the
    outermost block that holds exactly one distinct address. Python reads the markup into rows; selectors are tests of
    columns and running maxima over a page's nodes. A page that is there twice counts once.
    -> page_id, entry_pos (place in the page), name, email, profile_url, title
    """
    nodes = page_nodes(pages)
    if item_selector is None:
        blocks = _cards(nodes, lambda n: F.coalesce(n["tag"].isin(*_CARDS), F.lit(False)))
        blocks = blocks.where((F.size("mailtos") > 0) | F.col("text").rlike(r"(?i)@|\bat\b"))  # others cannot hold an address
    else:
        rows = _with_selected(nodes.select("_page", "page_id", F.inline("nodes")), item_selector)
        fields = F.struct("number", "last", "tag", "href", "link", "text", "selected")
        nodes = rows.groupBy("_page").agg(F.first("page_id").alias("page_id"), F.array_sort(F.collect_list(fields)).alias("nodes"))
        blocks = _cards(nodes, lambda n: n["selected"])
    both = F.concat_ws("\n", F.array_join("mailtos", "\n"), "text")
    blocks = blocks.withColumn("emails", addresses(both))
    if item_selector is None:
        # Blocks that began earlier and have not ended contain this one; the window is bounded by the page.
        singles = blocks.where(F.size("emails") == 1)
        before = Window.partitionBy("_page").orderBy("element").rowsBetween(Window.unboundedPreceding, -1)
        blocks = singles.withColumn("_open", F.max("last").over(before)).where(F.coalesce(F.col("_open") < F.col("element"), F.lit(True)))
    named = blocks.where((F.length("name") > 0) & (F.length("name") <= 80)).withColumn("_tokens", name_tokens(fold(F.col("name"))))
    # Link texts are folded together: one call per card, split again on a mark no link text holds.
    mark = "\u0001"
    folded = F.split(fold(F.array_join(F.transform("links", lambda a: F.replace(a["text"], F.lit(mark), F.lit(" "))), mark)), mark)
    keys = F.transform(folded, lambda s: F.coalesce(name_key(name_tokens(s)), F.lit("")))
    named = named.withColumn("_keys", keys).withColumn("_key", F.coalesce(name_key(F.col("_tokens")), F.lit("")))
    own = F.filter(F.arrays_zip("links", "_keys"), lambda a: a["_keys"] == F.col("_key"))
    return named.select(
        "page_id",
        F.col("element").alias("entry_pos"),
        "name",
        F.get(F.filter("emails", lambda e: email_fits_name(e, F.col("_tokens"))), F.lit(0)).alias("email"),
        F.coalesce(F.try_element_at(own, F.lit(-1))["links"]["url"], F.get("links", F.lit(0))["url"]).alias("profile_url"),
        title_of(F.col("text")).alias("title"),
    )
