"""Adapters of notice sites: where a source's list rows and details stand in its pages.

An adapter is data: selectors, and what makes a row a notice. A page is parsed once, in a task, into
the texts that the selectors pick; what they mean (dates, states, agencies, deadlines) is told by
column functions. ``NoticePages`` is the same as a Python data source over stored pages, a partition
per row group, and ``list_rows`` and ``details`` work on any table of pages (source_id, url, html).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.dates import CHINESE_DATE, NUMERIC_DATE, date_in, deadline_in

LEAST_TITLE = 4
#: Characters of a list page that are parsed at once, rows that are handed on at once, and bytes of pages that a worker gets at once.
PIECE, ROWS_AT_ONCE, PAGES_AT_ONCE = 1 << 16, 1000, "4m"
#: Tasks that list pages are dealt to.
TASKS_A_CORE = 8


@dataclass(frozen=True)
class Adapter:
    """Selectors of a source; those of rows are looked up within a row."""

    id: str
    name: str
    agency: str
    rows: str
    link: str = "a[href]"
    title: str | None = None  # where it isn't the link's text
    attribute_first: bool = False  # the link's title attribute stands before its text, not only for one cut short
    day: str | None = None
    period: bool = False  # the day's text is that of a period: published and deadline
    closing: str | None = None
    closing_millis: str | None = None
    status: str | None = None
    keep: str = ""  # a pattern that titles must hold
    dated: bool = False  # rows without a day are no notices
    headings: tuple[str, ...] = ("h1",)
    published: str | None = None
    published_pattern: str = ""
    bodies: tuple[str, ...] = ()
    files: tuple[str, ...] = ()
    downloads: tuple[str, ...] = field(default=())  # paths that serve files without an extension


# The sites' own markup.
ADAPTERS = {
    a.id: a
    for a in (
        Adapter("cac", "国家网信办·征求意见", "国家互联网信息办公室", "#loadingInfoPage li", attribute_first=True, day=".times", keep="征求[\\s\\S]{0,60}?意见", headings=(".main-title h1.title",), published="#pubtime", bodies=("#BodyLabel",), files=("#BodyLabel",), downloads=("/cms/pub/interact/downloadfile.jsp",)),
        Adapter("mee", "生态环境部·征求意见", "生态环境部办公厅", "li", day="span.date", dated=True, headings=("h2.neiright_Title", "h1"), published=".xqLyPc", bodies=(".neiright_JPZ_GK_CP", ".content_body_box", ".content_body"), files=(".neiright_JPZ_GK_CP", ".content_body_box", ".content_body")),
        Adapter("miit", "工业和信息化部·意见征集", "工业和信息化部", "li", day="span.fr", dated=True, closing_millis="span.endtime", headings=(), published='meta[name="PubDate"]', bodies=("#con_con",), files=("#con_con",)),
        Adapter("moe", "教育部·征求意见", "教育部", "#list li", attribute_first=True, day="span", headings=(".moe-detail-box h1",), published=".moe-detail-shuxing", bodies=(".moe-detail-box .TRS_Editor",), files=(".moe-detail-box .TRS_Editor",)),
        Adapter("mohurd", "住房城乡建设部·意见征集", "住房城乡建设部", "li.long-deta", title=".title-info", closing=".date-info", headings=(), published='meta[name="PubDate"]', bodies=(".editor-content",), files=(".editorContent-download",), downloads=("/document/download",)),
        Adapter("moj", "司法部·征求意见", "司法部", "ul.newsMsgList_zzy li", day=".rightData", published=".sT", published_pattern="发布时间[:：]?\\s*(\\d{4}-\\d{1,2}-\\d{1,2}|\\d{4}年\\d{1,2}月\\d{1,2}日)", bodies=(".news_content_style .TRS_Editor", ".news_content_style"), files=("#isShowFile",)),
        Adapter("mot", "交通运输部·意见征集", "交通运输部", "ul.news-list li.news-item", link="a.news-link[href]", title=".news-title", day=".news-date", headings=("h1.article-title",), published=".article-meta .publish-date", bodies=("#article-content", "#Zoom", "div.content"), files=("#article-content", "#Zoom", "div.content")),
        Adapter("samr", "市场监管总局·征求意见", "市场监管总局", "li.zjnav04Left02_content", link=".doctitle a[href]", day=".doctime", period=True, status=".docstatus", headings=(), published='meta[name="PubDate"]', bodies=(".Three_xilan_07",), files=("ul.contentLeft0102box",)),
    )
}
STATES = {"进行中": "open", "征集中": "open", "已结束": "closed", "已截止": "closed"}
DATE = r"(?:\d{4}年\d{1,2}月\d{1,2}日|\d{4}[-/.]\d{1,2}[-/.]\d{1,2})"
DEADLINES = [rf"截止(?:日期|时间)?\s*[为:：]*\s*{DATE}", rf"[至到]\s*{DATE}", rf"[请应]?于\s*{DATE}\s*(?:前|之前)"]
EXTENSIONS = re.compile(r"\.(?:pdf|docx?|wps|xls[xm]?|zip|rar)$", re.I)
_OPEN, _CLOSE, _WORDS = "[【\\[（(]", "[】\\]）)]", "|".join(STATES)
MARKER = rf"^{_OPEN}\s*({_WORDS})\s*{_CLOSE}\s*[-—－]?\s*|\s*{_OPEN}\s*({_WORDS})\s*{_CLOSE}$"

# Elements as the standard's parser gives them.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = ("p", "div", "li", "td")
UNSEEN = ("script", "style", "noscript")
_ENDS = {"li": ("li",), "p": ("p",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
_IN_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def all(self):
        """The elements below, in the page's order."""
        stack = self.children[::-1]
        while stack:
            node = stack.pop()
            if isinstance(node, Node):
                yield node
                stack += node.children[::-1]

    def text(self, unseen: tuple = UNSEEN) -> str:
        parts, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                parts.append(node)
            elif node is self or node.tag not in unseen:
                stack += node.children[::-1]
        return " ".join("".join(parts).split())


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def _close(self, tags: tuple, within: tuple = ("ul", "ol", "table", "select", "div")) -> None:
        node = self.at
        while node.parent is not None and node.tag not in within:
            if node.tag in tags:
                self._leave(node)
                return
            node = node.parent

    def _leave(self, node: Node) -> None:
        """An element is closed, and with it those in it."""
        self.at = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS:
            self._close(_ENDS[tag])
        elif tag in _IN_P:
            self._close(("p",))
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self._leave(node)
                return
            node = node.parent

    def handle_data(self, data):
        self.at.children.append(data)

    def updatepos(self, i, j):
        return j  # nobody asks for lines


def tree(html: str | None) -> Node:
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    return parser.root


@lru_cache(maxsize=1024)
def _steps(selector: str) -> tuple:
    """A chain of descendants: each step a tag, classes, an id, attributes."""
    out = []
    for step in selector.split():
        tag = re.match(r"[\w-]*", step)[0]
        attrs = tuple((k, v) for k, v in re.findall(r'\[([\w-]+)(?:="([^"]*)")?\]', step))
        bare = re.sub(r"\[[^\]]*\]", "", step)
        out.append((tag, frozenset(re.findall(r"\.([\w-]+)", bare)), next(iter(re.findall(r"#([\w-]+)", bare)), None), attrs))
    return tuple(out)


def _fits(node: Node, step: tuple) -> bool:
    tag, classes, name, attrs = step
    return (not tag or node.tag == tag) and (name is None or node.attrs.get("id") == name) and (not classes or classes <= set(node.attrs.get("class", "").split())) and all(k in node.attrs and (not v or node.attrs[k] == v) for k, v in attrs)


def _stands(node: Node, above: list, root: Node) -> bool:
    """Whether the steps stand above an element, up to ``root``."""
    up, k = node.parent, len(above)
    while k and up is not None and up is not root.parent:
        k -= _fits(up, above[k - 1])
        up = up.parent
    return not k


def select(root: Node, selector: str):
    """The elements below ``root`` that a selector picks, in order."""
    *above, last = _steps(selector)
    for node in root.all():
        if _fits(node, last) and _stands(node, above, root):
            yield node


class _Rows(_Tree):
    """The elements that a selector picks, told as they are closed; what stands around them isn't kept."""

    def __init__(self, selector: str):
        super().__init__()
        *self.above, self.last = _steps(selector)
        self.row, self.told = None, []

    def _is_row(self, node: Node) -> bool:
        return _fits(node, self.last) and _stands(node, self.above, self.root)

    def tell(self) -> None:
        """The outermost open row, and the rows in it, are whole."""
        if self.row is not None:
            self.told += [self.row, *(n for n in self.row.all() if self._is_row(n))]
            self.row = None

    def _leave(self, node):
        super()._leave(node)
        up = self.row
        while up is not None and up is not node:
            up = up.parent
        if up is not None:
            self.tell()
        self._forget()

    def _forget(self) -> None:
        if self.row is None:
            self.at.children.clear()

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(tag, attrs)
        if tag in VOID:
            self._forget()
        elif self.row is None and self._is_row(self.at):
            self.row = self.at

    def handle_startendtag(self, tag, attrs):
        super().handle_startendtag(tag, attrs)
        self._forget()

    def handle_data(self, data):
        if self.row is not None:
            super().handle_data(data)


def rows_of(html: str | None, selector: str):
    """The elements of ``select``, in order, of a page that is read piece by piece; only rows that are open are held."""
    parser, html = _Rows(selector), html or ""
    for k in range(0, len(html), PIECE):
        parser.feed(html[k : k + PIECE])
        yield from parser.told
        parser.told.clear()
    parser.close()
    parser.tell()
    yield from parser.told


def _first(root: Node, selector: str | None) -> Node | None:
    return next(select(root, selector), None) if selector else None


def _text(root: Node, selector: str | None) -> str:
    """The first pick's text; a meta element's content."""
    node = _first(root, selector)
    return "" if node is None else " ".join(node.attrs.get("content", "").split()) if node.tag == "meta" else node.text()


def body_text(root: Node, selector: str | None = None) -> str | None:
    """The innermost blocks' texts, a line each; the whole text where there is no block."""
    node = _first(root, selector) if selector else root
    if node is None:
        return None
    inner = [n for n in node.all() if n.tag in BLOCKS and not any(isinstance(c, Node) and c.tag in BLOCKS for c in n.children) and not _within(n, UNSEEN, node)]
    return "\n".join(t for t in (n.text() for n in inner) if t) or node.text() or None


def _within(node: Node, tags: tuple, top: Node) -> bool:
    while node is not None and node is not top:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def _address(href: str, base: str | None) -> str | None:
    try:
        url = urljoin(base or "", href.strip())
        return url if urlsplit(url).scheme in ("http", "https") else None
    except ValueError:
        return None


TEXTS = ("title", "url", "day", "closing", "millis", "status")
LIST = f"array<struct<{','.join(n + ':string' for n in TEXTS)}>>"
DETAIL = "struct<title:string,published:string,body:string,files:array<struct<name:string,url:string>>>"


def _is_day(text: str) -> bool:
    for pattern in (NUMERIC_DATE, CHINESE_DATE):
        if m := re.search(pattern, text):
            try:
                return int(m[1]) >= 100 and bool(date(*map(int, m.groups())))
            except ValueError:
                return False
    return False


def picked_rows(adapter: Adapter, html: str | None, url: str | None):
    """The texts of a list page's notices, one by one.

    Rows with too short a title, or without a day where the source dates its notices, are none; an
    address counts once.
    """
    seen = set()
    for row in rows_of(html, adapter.rows):
        link = _first(row, adapter.link)
        address = link and link.attrs["href"] and _address(link.attrs["href"], url)
        if not address:
            continue
        shown, named = _text(row, adapter.title) if adapter.title else link.text(), " ".join(link.attrs.get("title", "").split())
        whole = shown if shown and "…" not in shown and "..." not in shown else named
        title = (named or shown) if adapter.attribute_first else whole
        if adapter.keep and not re.search(adapter.keep, title):
            continue
        day, _, closing = re.sub("[至到~～]", "\0", _text(row, adapter.day), count=1).partition("\0") if adapter.period else (_text(row, adapter.day), "", _text(row, adapter.closing))
        if address in seen or len(re.sub(MARKER, "", title).strip()) < LEAST_TITLE or adapter.dated and not _is_day(day):
            continue
        seen.add(address)
        yield {"title": title, "url": address, "day": day, "closing": closing, "millis": _text(row, adapter.closing_millis), "status": _text(row, adapter.status)}


def picked_detail(adapter: Adapter, html: str | None, url: str | None) -> dict:
    """The texts of a notice's page; what isn't there is null."""
    root = tree(html)
    published = _text(root, adapter.published)
    if adapter.published_pattern:
        published = next(iter(re.findall(adapter.published_pattern, published)), "")
    files: dict[str, str] = {}
    for scope in adapter.files:
        for part in select(root, scope):
            for a in select(part, "a[href]"):
                address = _address(a.attrs["href"], url)
                path = urlsplit(address).path if address else ""
                if path and (EXTENSIONS.search(path) or path.startswith(adapter.downloads or ("\0",))):
                    files.setdefault(address, a.text() or unquote(path.rsplit("/", 1)[-1]))
        if files:
            break
    body = next((text for s in adapter.bodies if (text := body_text(root, s))), None)
    title = next((text for s in adapter.headings if (text := _text(root, s))), None)
    return {"title": title, "published": published[:20] or None, "body": body, "files": [{"name": n, "url": u} for u, n in files.items()]}


def _picked_details(adapters: dict[str, Adapter]) -> Column:
    """One parse a page; a page of no known source gives nothing."""

    def fields(source: pd.Series, html: pd.Series, url: pd.Series) -> pd.DataFrame:
        nothing = dict.fromkeys(("title", "published", "body", "files"))
        found = (picked_detail(adapters[s], h, u) if s in adapters else None for s, h, u in zip(source, html, url))
        return pd.DataFrame([d or nothing for d in found], columns=list(nothing))

    return F.pandas_udf(fields, DETAIL)("source_id", "html", "url")


def _listed(pages: DataFrame, adapters: dict[str, Adapter], keep: tuple[str, ...]) -> DataFrame:
    """(keep, source_id, page_url, pos, a row's texts): one parse a page, whose rows leave the task as they are told."""
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", PAGES_AT_ONCE)
    of_page = [*keep, "source_id", "url"]
    kinds = pages.select(*of_page).withColumnRenamed("url", "page_url").schema
    schema = T.StructType([*kinds, T.StructField("pos", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in TEXTS]])

    def told(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        at, pos, texts = zip(*rows)
        own = [batch.column(c).take(pa.array(at, pa.int64())) for c in of_page]
        return pa.RecordBatch.from_arrays([*own, pa.array(pos, pa.int32()), *[pa.array([x[n] for x in texts], pa.string()) for n in TEXTS]], schema.names)

    def run(it):
        for batch in it:
            rows: list[tuple] = []
            for k in range(batch.num_rows):
                source, html, url = (batch.column(c)[k].as_py() for c in ("source_id", "html", "url"))
                for pos, texts in enumerate(picked_rows(adapters[source], html, url) if source in adapters else ()):
                    rows.append((k, pos, texts))
                    if len(rows) == ROWS_AT_ONCE:
                        yield told(batch, rows)
                        rows = []
            if rows:
                yield told(batch, rows)

    # a page is few bytes for the time its parse takes, so tasks can't go by bytes
    tasks = TASKS_A_CORE * pages.sparkSession.sparkContext.defaultParallelism
    return pages.select(*of_page, "html").repartition(tasks, *of_page).mapInArrow(run, schema)


def agency_before(title: Column) -> Column:
    """What stands before the first 关于 of a title that goes on with a bracket, if it looks like an agency's name."""
    head = F.trim(F.regexp_extract(title, "^((?:(?!关于).){2,60})关于[《〔（]", 1))
    return F.when(head.rlike("[部委局院署办厅]|政府|人大|银行|监管"), head)


def _agency(title: Column, adapters: dict[str, Adapter]) -> Column:
    default = F.element_at(F.create_map(*[F.lit(x) for a in adapters.values() for x in (a.id, a.agency)]), F.col("source_id")) if adapters else F.lit(None).cast("string")
    return F.coalesce(agency_before(title), default)


def told_rows(x: DataFrame, adapters: dict[str, Adapter] = ADAPTERS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(source_id, page_url, pos, title, url, agency, published, deadline, status) of the texts of list rows.

    Titles lose a mark of state, which is the row's.
    """
    mark = F.coalesce(F.nullif(F.regexp_extract("title", MARKER, 1), F.lit("")), F.regexp_extract("title", MARKER, 2))
    word = F.when(mark != "", mark).otherwise(F.regexp_replace("status", rf"^(?:{_OPEN}|\s)+|(?:{_CLOSE}|\s)+$", ""))
    state = F.coalesce(*[F.when(word == w, F.lit(s)) for w, s in STATES.items()])
    closing = F.coalesce(deadline_in(F.col("closing"), DEADLINES), date_in(F.col("closing")), F.when(F.col("millis").rlike(r"^\d{1,14}$"), F.to_date(F.timestamp_millis(F.col("millis").try_cast("long")))))
    told = x.select(*keep, "source_id", "page_url", "pos", F.trim(F.regexp_replace("title", MARKER, "")).alias("title"), "url", date_in(F.col("day")).alias("published"), closing.alias("deadline"), state.alias("status"))
    return told.select(*keep, "source_id", "page_url", "pos", "title", "url", _agency(F.col("title"), adapters).alias("agency"), "published", "deadline", "status")


def told_details(picked: DataFrame, adapters: dict[str, Adapter] = ADAPTERS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(source_id, url, title, agency, published, deadline, body, files) of picked details (``d``); all null where a page gave nothing."""
    files = F.when(F.size("d.files") > 0, F.col("d.files"))
    out = picked.select(*keep, "source_id", "url", F.col("d.title").alias("title"), agency_before(F.col("d.title")).alias("agency"), date_in(F.col("d.published")).alias("published"), deadline_in(F.col("d.body"), DEADLINES).alias("deadline"), F.col("d.body").alias("body"), files.alias("files"))
    return out


def list_rows(pages: DataFrame, adapters: dict[str, Adapter] = ADAPTERS, keep: tuple[str, ...] = ()) -> DataFrame:
    """The notices that list pages (source_id, url, html) name."""
    return told_rows(_listed(pages, adapters, keep), adapters, keep)


def details(pages: DataFrame, adapters: dict[str, Adapter] = ADAPTERS, keep: tuple[str, ...] = ()) -> DataFrame:
    """What notices' own pages (source_id, url, html) give."""
    return told_details(pages.withColumn("d", _picked_details(adapters)), adapters, keep)


def with_details(rows: DataFrame, found: DataFrame) -> DataFrame:
    """List rows with what their pages gave in place of their own; what a page didn't give stays."""
    own = found.select(F.col("url").alias("_url"), *[F.col(c).alias(f"_{c}") for c in ("title", "agency", "published", "deadline", "body", "files")])
    both = rows.join(own, F.col("url") == F.col("_url"), "left")
    return both.select(*[F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in own.columns and c != "url" else F.col(c) for c in rows.columns], F.col("_body").alias("body"), F.col("_files").alias("files"))


class NoticePages(DataSource):
    """Stored pages (source_id, url, html; Parquet) read through their adapters: ``part`` is "list" or "details".

    ``spark.dataSource.register(NoticePages)``, then ``spark.read.format("notice_pages")`` with ``path``;
    ``sources`` names the sources wanted, all by default.
    """

    @classmethod
    def name(cls) -> str:
        return "notice_pages"

    def schema(self) -> str:
        return f"source_id string, url string, {'rows ' + LIST if self._part() == 'list' else 'd ' + DETAIL}"

    def _part(self) -> str:
        part = self.options.get("part", "list")
        if part not in ("list", "details"):
            raise ValueError("part must be list or details")
        return part

    def reader(self, schema) -> DataSourceReader:
        wanted = [s for s in self.options.get("sources", "").split(",") if s] or list(ADAPTERS)
        return _PageReader(self.options["path"], self._part(), wanted)


@dataclass
class _Group(InputPartition):
    file: str
    group: int


class _PageReader(DataSourceReader):
    def __init__(self, path: str, part: str, sources: list[str]):
        self.path, self.part, self.sources = path, part, sources

    def _files(self):
        from pyarrow import dataset, fs

        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return system, dataset.dataset(path, filesystem=system, format="parquet")

    def partitions(self) -> list[_Group]:
        return [_Group(f.path, g.id) for f in self._files()[1].get_fragments() for g in f.row_groups]

    def read(self, partition: _Group):
        from pyarrow import parquet

        fn, name = (picked_rows, "rows") if self.part == "list" else (picked_detail, "d")
        system, _ = self._files()
        with system.open_input_file(partition.file) as f:
            for batch in parquet.ParquetFile(f).iter_batches(256, row_groups=[partition.group], columns=["source_id", "url", "html"]):
                for source, url, html in zip(*(batch.column(c).to_pylist() for c in ("source_id", "url", "html"))):
                    if source in self.sources and source in ADAPTERS:
                        found = fn(ADAPTERS[source], html, url)
                        yield source, url, [tuple(r.values()) for r in found] if name == "rows" else (found["title"], found["published"], found["body"], [tuple(x.values()) for x in found["files"]])


def read_pages(spark: SparkSession, path: str, part: str = "list", sources: tuple[str, ...] = ()) -> DataFrame:
    """The notices of stored pages, by the data source and the same column functions."""
    spark.dataSource.register(NoticePages)
    picked = spark.read.format("notice_pages").option("path", path).option("part", part).option("sources", ",".join(sources)).load()
    if part == "details":
        return told_details(picked)
    return told_rows(picked.select("source_id", F.col("url").alias("page_url"), F.posexplode("rows").alias("pos", "x")).select("source_id", "page_url", "pos", "x.*"))
