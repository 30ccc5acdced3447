"""HTML scans: list rows, details, block text and attachment links, by the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

LEAVES = frozenset("p div li td h1 h2 h3 h4 h5 h6 article section body".split())
ATTACHMENT = (".pdf", ".doc", ".docx", ".wps", ".xls", ".xlsx", ".zip", ".rar", ".ofd")

LINKS = "array<struct<name:string,url:string>>"


class _Reader(HTMLParser):
    """Texts of leaf blocks, and links with their text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.parts: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.href: str | None = None
        self.label: list[str] = []
        self.silent = 0
        self.title: str | None = None
        self.in_title = False

    def _flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript"):
            self.silent += 1
        elif tag == "title":
            self.in_title = True
        elif tag in LEAVES:
            self._flush()
        elif tag == "br":
            self.parts.append(" ")
        elif tag == "a":
            self._link()
            self.href = dict(attrs).get("href")

    def _link(self):
        if self.href:
            self.links.append((" ".join("".join(self.label).split()), self.href))
        self.href, self.label = None, []

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript"):
            self.silent = max(0, self.silent - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in LEAVES:
            self._flush()
        elif tag == "a":
            self._link()

    def handle_data(self, data):
        if self.in_title:
            self.title = (self.title or "") + data
        elif not self.silent:
            self.parts.append(data)
            if self.href is not None:
                self.label.append(data)


def read(html: str | None) -> _Reader:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader._link()
    reader._flush()
    return reader


def _over(html: Column, fn, schema: str) -> Column:
    return F.pandas_udf(lambda s: pd.Series([fn(h) for h in s], dtype=object), schema)(html)


def block_text(html: Column) -> Column:
    return _over(html, lambda h: "\n".join(read(h).blocks), "string")


def page_title(html: Column) -> Column:
    return _over(html, lambda h: " ".join((read(h).title or "").split()) or None, "string")


def _links(html: str | None, base: str | None, wanted) -> list[dict]:
    seen, out = set(), []
    for label, href in read(html).links:
        try:
            url = urljoin(base or "", href.strip())
            parts = urlsplit(url)
        except ValueError:
            continue
        if parts.scheme in ("http", "https") and wanted(parts.path.lower()) and url not in seen:
            seen.add(url)
            out.append({"name": label or unquote(parts.path.rsplit("/", 1)[-1]), "url": url})
    return out


def links(html: Column, base: Column) -> Column:
    """Web links of a page, each address once, in order."""
    return F.pandas_udf(lambda h, b: pd.Series([_links(x, y, lambda p: True) for x, y in zip(h, b)]), LINKS)(html, base)


def attachments(html: Column, base: Column) -> Column:
    """Links to files by their extension; a link without text goes by its file's name."""
    return F.pandas_udf(lambda h, b: pd.Series([_links(x, y, lambda p: p.endswith(ATTACHMENT)) for x, y in zip(h, b)]), LINKS)(html, base)


def list_rows(pages: DataFrame) -> DataFrame:
    """(page_id, pos, title, url): a row per link of list pages (page_id, url, html), addresses once per page."""
    found = pages.select("page_id", F.posexplode(links(F.col("html"), F.col("url"))).alias("pos", "link"))
    return found.select("page_id", "pos", F.col("link.name").alias("title"), "link.url")


def details(pages: DataFrame) -> DataFrame:
    """(page_id, title, body, n_blocks); null title and body where a page gave nothing. A page is parsed once."""

    def run(html: pd.Series) -> pd.DataFrame:
        found = [read(h) for h in html]
        return pd.DataFrame({"title": [" ".join((r.title or "").split()) or None for r in found], "body": ["\n".join(r.blocks) or None for r in found], "n_blocks": [max(1, len(r.blocks)) for r in found]})

    return pages.select("page_id", F.pandas_udf(run, "title string, body string, n_blocks int")("html").alias("d")).select("page_id", "d.*")
