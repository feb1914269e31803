"""RSS and Atom feeds: payload rows to item rows, parsed by Spark's XML functions with a fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import instant
from ..functions.text import filled, whitespace

RSS = (
    "channel struct<item: array<struct<title: string, link: array<struct<_VALUE: string, _rel: string, _href: string>>, pubDate: string, published: string, updated: string, date: string, description: string, "
    "summary: string, content: string, `content:encoded`: string, source: struct<_VALUE: string, _url: string>>>>"
)
ATOM = (
    "entry array<struct<title: string, link: array<struct<_VALUE: string, _rel: string, _href: string>>, pubDate: string, published: string, updated: string, date: string, description: string, "
    "summary: string, content: string, `content:encoded`: string, source: struct<_VALUE: string, _url: string>>>"
)
SEARCH_NAME = "Google News"


def _entries(xml: Column) -> Column:
    """Items of a feed, else entries."""
    options = {"mode": "PERMISSIVE", "ignoreNamespace": "false"}
    return F.coalesce(F.from_xml(xml, RSS, options)["channel"]["item"], F.from_xml(xml, ATOM, options)["entry"])


def _link(links: Column) -> Column:
    """The alternate link, else the first: its address, else its text."""
    preferred = F.coalesce(F.try_element_at(F.filter(links, lambda x: x["_rel"] == "alternate"), F.lit(1)), F.try_element_at(links, F.lit(1)))
    return filled(preferred["_href"], preferred["_VALUE"])


def feed_items(payloads: DataFrame, family_ord: int = 2) -> DataFrame:
    """Items of feeds. payloads: name, ord, xml. Rows without date, title or address are dropped."""
    rows = payloads.select("name", F.col("ord").alias("query_ord"), F.posexplode(_entries(F.col("xml"))).alias("item_ord", "e"))
    e = F.col("e")
    text = whitespace(filled(e["description"], e["summary"], e["content"], e["content:encoded"]))
    return rows.select(
        F.lit("news").alias("kind"), whitespace(e["title"]).alias("title"), _link(e["link"]).alias("url"), instant(filled(e["pubDate"], e["published"], e["updated"], e["date"])).alias("published_at"),
        F.col("name").alias("source"), text.alias("summary"), text.alias("raw_text"), F.lit(family_ord).alias("family_ord"), "query_ord", F.col("item_ord").cast("bigint").alias("item_ord"),
    ).filter("published_at is not null and title <> '' and url <> ''")


def search_items(payloads: DataFrame, family_ord: int = 0) -> DataFrame:
    """Items of news searches: like feeds, with the publisher and its address from the entry's source element."""
    rows = payloads.select(F.col("ord").alias("query_ord"), F.posexplode(_entries(F.col("xml"))).alias("item_ord", "e"))
    e = F.col("e")
    text = whitespace(e["description"])
    return rows.select(
        F.lit("news").alias("kind"), whitespace(e["title"]).alias("title"), _link(e["link"]).alias("url"), F.coalesce(e["source"]["_url"], F.lit("")).alias("source_url"), instant(e["pubDate"]).alias("published_at"),
        filled(whitespace(e["source"]["_VALUE"]), F.lit(SEARCH_NAME)).alias("source"), text.alias("summary"), text.alias("raw_text"), F.lit(family_ord).alias("family_ord"), "query_ord",
        F.col("item_ord").cast("bigint").alias("item_ord"),
    ).filter("published_at is not null and title <> '' and url <> ''")
