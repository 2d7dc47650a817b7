"""Raw pages to main content, on the standard library's parser, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import navigation_like, text_verdict, visible_text

# What never is content, what is none outside the root, and the shares that decide.
DROPPED = ("script", "style", "noscript", "template", "svg", "iframe", "nav", "aside")
ROLES = ("navigation", "banner", "contentinfo", "search")
FORM_SHARE, ROOT_SHARE = 0.5, 0.25
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
BLOCKS = ("p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "blockquote", "pre", "header", "footer", "form", "figure", "body", "html", "dl", "dt", "dd")
MOUNTS = ("root", "app", "__next")
RAW = ("script", "style")


class Node:
    __slots__ = ("tag", "attrs", "parts", "up")

    def __init__(self, tag: str, attrs: dict, up: Node | None):
        self.tag, self.attrs, self.parts, self.up = tag, attrs, [], up

    def walk(self) -> Iterator[Node]:
        """All nodes below in document order, without recursion, as pages nest deeply."""
        stack = [x for x in reversed(self.parts) if isinstance(x, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [x for x in reversed(n.parts) if isinstance(x, Node)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack += reversed(x.parts)
        return " ".join(" ".join(out).split())

    def inside(self, other: Node) -> bool:
        n = self.up
        while n is not None and n is not other:
            n = n.up
        return n is other

    def drop(self) -> None:
        if self.up is not None:
            self.up.parts = [x for x in self.up.parts if x is not self]
            self.up = None


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.parts.append(n)
        if tag not in VOID:
            self.at = n

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n is not None and n.tag != tag:
            n = n.up
        if n is not None and n.up is not None:
            self.at = n.up

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)


def tree(html: str) -> Node:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.top


def main_content(html: str) -> Node:
    """The node that holds a page's content, chrome removed: the first of main, article and role=main, else the body; also the body if the root holds little of its text."""
    return content_of(tree(html))


def content_of(top: Node) -> Node:
    """The same of a parsed page, which is changed."""
    for n in list(top.walk()):
        if n.tag in DROPPED or n.attrs.get("role") in ROLES or n.attrs.get("aria-hidden") == "true":
            n.drop()
    nodes = list(top.walk())
    body = next((n for n in nodes if n.tag == "body"), top)
    tests = (lambda n: n.tag == "main", lambda n: n.tag == "article", lambda n: n.attrs.get("role") == "main")
    root = next((n for test in tests for n in nodes if test(n)), None)
    for n in nodes:
        if n.tag in ("header", "footer") and n is not root and not (root and (n.inside(root) or root.inside(n))):
            n.drop()
    whole = len(body.text())
    for n in nodes:
        if n.tag == "form" and n.up is not None and n is not root and not (root and root.inside(n)) and not (whole and len(n.text()) >= FORM_SHARE * whole):
            n.drop()
    if root is None or (root is not body and len(root.text()) < ROOT_SHARE * len(body.text())):
        return body
    return root


def markdown(node: Node) -> str:
    """A node as markdown: headings, lists, links, images, emphasis; blocks apart by blank lines."""
    out: list[str] = []
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, str):
            out.append(re.sub(r"\s+", " ", x))
        else:
            before, after = "", ""
            if re.fullmatch("h[1-6]", x.tag):
                before, after = "\n\n" + "#" * int(x.tag[1]) + " ", "\n\n"
            elif x.tag == "li":
                before, after = "\n- ", "\n"
            elif x.tag == "br":
                before = "\n"
            elif x.tag in ("b", "strong"):
                before = after = "**"
            elif x.tag in ("i", "em"):
                before = after = "*"
            elif x.tag == "a" and x.attrs.get("href"):
                before, after = "[", f"]({x.attrs['href']})"
            elif x.tag == "img" and x.attrs.get("src"):
                before = f"![{x.attrs.get('alt', '')}]({x.attrs['src']})"
            elif x.tag in BLOCKS:
                before = after = "\n\n"
            stack += [(after,), *reversed(x.parts), (before,)]
    text = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(out))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def _shell(nodes: list[Node]) -> bool:
    return any(n.attrs.get("id") in MOUNTS and not n.text() for n in nodes) and any(n.tag == "script" for n in nodes)


def js_shell(html: str) -> bool:
    """Whether a page is an empty mount point that scripts fill."""
    return _shell(list(tree(html).walk()))


def read(html: str) -> tuple[str, str, bool]:
    """(markdown, title, js_shell) of a page, parsed once: what is told of the whole page is told before its chrome goes."""
    top = tree(html)
    nodes = list(top.walk())
    title = next((n.text() for n in nodes if n.tag == "title"), "")
    shell = _shell(nodes)
    return markdown(content_of(top)), title, shell


def titled(markdown: Column, title: Column) -> Column:
    """markdown under its title, unless it has none or begins with a heading of that title."""
    def words(c: Column) -> Column:
        return F.array_join(F.regexp_extract_all(F.lower(visible_text(c)), F.lit(r"(?U)\w+"), F.lit(0)), " ")

    first = F.regexp_extract(markdown, r"^\s*#\s+([^\n]+)", 1)
    return F.when((F.coalesce(title, F.lit("")) == "") | ((first != "") & (words(first) == words(title))), markdown).otherwise(F.concat(F.lit("# "), title, F.lit("\n\n"), markdown))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with markdown, title, js_shell and verdict (null: usable). A null page gives an empty text and the verdict empty."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = b[html].fillna("")
            made = raw.map(read)
            yield b.assign(markdown=made.str[0], title=made.str[1], js_shell=made.map(lambda x: x[2]).astype(bool))

    schema = ", ".join(f"`{c}` {t}" for c, t in pages.dtypes) + ", markdown string, title string, js_shell boolean"
    made = pages.mapInPandas(run, schema).withColumn("_seen", F.length(visible_text(F.col("markdown"))))
    made = made.withColumn("_verdict", text_verdict(F.col(html), F.col("markdown"), seen=F.col("_seen")))  # a column each, so that no plan repeats them
    verdict = F.col("_verdict")
    short = F.coalesce(verdict.startswith("too_little") | (verdict == "empty"), F.lit(False)) & F.col("js_shell")
    told = F.when(F.coalesce(F.trim(F.col(html)), F.lit("")) == "", "empty").when(short, "js_shell").otherwise(verdict)
    return made.withColumn("verdict", told).drop("_seen", "_verdict")


def recover_lines(primary: DataFrame, baseline: DataFrame, by: str = "page_id") -> DataFrame:
    """(by, line_no, line) of baseline lines whose words, in order, the primary text lacks; first occurrences, in order."""
    def words(c):
        return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0)), " "), F.lit(" "))

    lines = baseline.select(by, F.posexplode(F.split("markdown", "\n")).alias("line_no", "line")).withColumn("w", words(F.col("line"))).filter("trim(w) <> ''")
    lines = lines.filter(~navigation_like(F.col("line")))
    once = lines.groupBy(by, "w").agg(F.min("line_no").alias("line_no"), F.min_by("line", "line_no").alias("line"))
    return once.join(primary.select(by, words(F.col("markdown")).alias("have")), by).filter(~F.col("have").contains(F.col("w"))).select(by, "line_no", "line")
