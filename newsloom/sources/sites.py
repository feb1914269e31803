"""Pages of sites: an adapter a site turns a page into items; an adapter that does not find its structure fails for that page only."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import day_first
from ..functions.text import whitespace
from ..functions.urls import absolute

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    def __init__(self, tag: str, attributes: dict, parent: Node | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []

    def walk(self) -> Iterator[Node]:
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def has(self, *classes: str) -> bool:
        return set(classes) <= set((self.attributes.get("class") or "").split())

    def find(self, tag: str = "", *classes: str, id: str | None = None) -> list[Node]:
        return [n for n in self.walk() if (not tag or n.tag == tag) and n.has(*classes) and (id is None or n.attributes.get("id") == id)]


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node and node.tag != tag:
            node = node.parent
        if node and node.parent:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(page: str) -> Node:
    parser = _Tree()
    parser.feed(page)
    return parser.root


def decoded(body: bytes, encoding: str | None, content_type: str | None) -> str:
    """By the site's encoding, else the answer's, else UTF-8; an unknown name counts as UTF-8."""
    named = re.search(r"charset=([^;\s]+)", content_type or "", re.I)
    try:
        return body.decode(encoding or (named[1].strip("\"'") if named else "utf-8"), "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def _first(nodes: list[Node]) -> str:
    return nodes[0].text() if nodes else ""


def cards(root: Node) -> list[tuple]:
    found = root.find("", "post-item")
    if not found:
        raise ValueError("cards .post-item not found")
    out = []
    for card in found:
        links = [a for t in card.find("", "entry-title") for a in t.find("a")]
        texts = [n for n in card.walk() if n.has("post-excerpt") or n.has("post-desc")]
        out.append((_first(links), links[0].attributes.get("href") if links else None, _first(card.find("", "post-date")), _first(texts)))
    return out


def embedded(root: Node) -> list[tuple]:
    app = root.find("", id="app")
    if not app or not app[0].attributes.get("data-page"):
        raise ValueError("embedded data-page not found")
    rows = json.loads(app[0].attributes["data-page"])
    for step in ("props", "dados", "data"):
        rows = rows.get(step) if isinstance(rows, dict) else None
    if not isinstance(rows, list):
        raise ValueError("list props.dados.data not found")
    return [(r.get("titulo"), f"/comunicacao/noticias/{r.get('slug')}", r.get("datetime"), r.get("conteudo")) for r in rows]


def dated_headings(root: Node) -> list[tuple]:
    found = [h for h in root.find("h2") if h.find("", "data-noticia-internas")]
    if not found:
        raise ValueError("dated headings not found")
    out = []
    for h in found:
        links = [a for a in h.find("a") if "/Noticia/" in (a.attributes.get("href") or "")]
        after = h.parent.children[h.parent.children.index(h) + 1 :]
        if links:
            dates = "".join(n.text() for n in h.find("", "data-noticia-internas"))
            out.append((links[0].text(), links[0].attributes["href"], dates, _first([n for n in after if isinstance(n, Node) and n.tag == "p"])))
    return out


#: Fixed values of the edition index.
EDITION, NOT_READ = "Edição oficial mais recente — ", "Monitoramento do índice da edição. O PDF ainda não é analisado por este coletor."


def edition_index(root: Node) -> list[tuple]:
    link = next((n.attributes.get(a) for i, a in (("downloadPdf", "href"), ("urlPdf", "value")) for n in root.find("", id=i) if n.attributes.get(a)), None)
    dates = [s for n in root.find("", id="ultima-edicao") for s in n.find("span")]
    if not link or not re.search(r"\d{1,2}/\d{1,2}/\d{4}", _first(dates)):
        raise ValueError("index of the latest edition not found")
    return [(None, link, _first(dates), NOT_READ)]


ADAPTERS = {"rncp": cards, "cnm": embedded, "tce-mg": dated_headings, "diario-municipal-index": edition_index}
PARSED = "name string, adapter string, site_url string, publish boolean, query_ord int, item_ord bigint, title string, href string, dated string, summary string, error string"


FOUND = "item_ord bigint, title string, href string, dated string, summary string, error string"
FOUND_NAMES = [x.split()[0] for x in FOUND.split(", ")]
FOUND_TYPES = {c: pa.int64() if c == "item_ord" else pa.string() for c in FOUND_NAMES}
#: Rows of an Arrow batch that is handed back.
BATCH = 10_000


def items_in(adapter: str | None, body: bytes | None, encoding: str | None = None, content_type: str | None = None, error: str | None = None) -> Iterator[tuple]:
    """FOUND of one page: a row an item; one row with item_ord -1 where there is none, or with the error of a page that could not be fetched or read."""
    try:
        if error:
            raise ValueError(error)
        if adapter not in ADAPTERS:
            raise ValueError(f"unknown adapter: {adapter}")
        items = ADAPTERS[adapter](tree(decoded(bytes(body), encoding or None, content_type)))
        yield from [(i, *item, None) for i, item in enumerate(items)] or [(-1, None, None, None, None, None)]
    except (ValueError, KeyError, AttributeError, TypeError) as e:
        yield -1, None, None, None, None, str(e)


@F.udtf(returnType=FOUND, useArrow=True)
class PageItems:
    """The table function page_items(adapter, body, encoding, content_type, error), to be called laterally for each page."""

    def eval(self, adapter: str, body: bytes, encoding: str, content_type: str, error: str):
        yield from items_in(adapter, body, encoding, content_type, error)


def register(spark: SparkSession) -> None:
    """Make page_items known to SQL."""
    spark.udtf.register("page_items", PageItems)


def parsed_pages(pages: DataFrame) -> DataFrame:
    """pages: name, adapter, url, publish, encoding, ord, content_type, body, error. One row an item, one row a failure.

    Pages go through items_in by Arrow batches: a call of the table function costs milliseconds a page.
    """
    own = {"site_url": F.col("url"), "publish": F.coalesce("publish", F.lit(False)), "query_ord": F.col("ord")}
    told = [x.split()[0] for x in PARSED.split(", ")]
    kept = [c for c in told if c not in FOUND_NAMES]
    read = ["adapter", "body", "encoding", "content_type", "_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(i, *item) for i, page in enumerate(zip(*(batch.column(f"_in{c}").to_pylist() for c in read))) for item in items_in(*page)]
            at, *found = zip(*made) if made else ((),) * (1 + len(FOUND_NAMES))
            rows = batch.select(kept).take(pa.array(at, pa.int64()))
            columns = {c: rows.column(c) for c in kept} | {c: pa.array(v, t) for (c, t), v in zip(FOUND_TYPES.items(), found)}
            for start in range(0, len(at), BATCH):
                yield pa.RecordBatch.from_pydict({c: columns[c].slice(start, BATCH) for c in told})

    pages = pages.withColumnRenamed("error", "_error")
    pages = pages.select([own.get(c, F.col(c)).alias(c) for c in kept] + [F.col(c).alias(f"_in{c}") for c in read])
    return pages.mapInArrow(run, PARSED)


def site_items(parsed: DataFrame, family_ord: int = 3) -> DataFrame:
    index = F.col("adapter") == "diario-municipal-index"
    text = whitespace(F.col("summary"))
    return parsed.filter("item_ord >= 0").select(
        F.when(index, "gazette-index").otherwise("news").alias("kind"), F.when(index, F.concat(F.lit(EDITION), "name")).otherwise(whitespace(F.col("title"))).alias("title"),
        absolute(F.col("href"), F.col("site_url")).alias("url"), F.col("site_url").alias("source_url"), day_first(F.col("dated")).alias("published_at"), F.col("name").alias("source"), text.alias("summary"),
        F.when(index, "").otherwise(text).alias("raw_text"), F.col("adapter").alias("scraper"), (~F.col("publish")).alias("preview_only"), F.lit(family_ord).alias("family_ord"), "query_ord", "item_ord",
    ).filter("published_at is not null and title <> '' and url <> ''")


def diagnostics(parsed: DataFrame, items: DataFrame, disabled: list[dict]) -> DataFrame:
    """Disabled sites first, then each site's status with its items inside the window."""
    spark = parsed.sparkSession
    off = [(d["name"], d["adapter"], "disabled", 0, f"cobertura alternativa: {d['fallback']}" if d.get("fallback") else "coletor desativado", -1, i) for i, d in enumerate(disabled)]
    counts = items.groupBy(F.col("source").alias("name"), F.col("scraper").alias("adapter")).agg(F.count(F.lit(1)).alias("n"))
    own = parsed.groupBy("name", "adapter", "query_ord").agg(F.max("error").alias("message")).join(counts, ["name", "adapter"], "left")
    own = own.select("name", "adapter", F.when(F.col("message").isNull(), "ok").otherwise("error").alias("status"), F.when(F.col("message").isNull(), F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("item_count"), "message", F.lit(0).alias("part"), F.col("query_ord").alias("place"))
    return spark.createDataFrame(off, "name string, adapter string, status string, item_count long, message string, part int, place int").union(own)
