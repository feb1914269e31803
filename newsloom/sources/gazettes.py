"""Official gazettes: JSON answers to items, merged over request groups."""

from __future__ import annotations

from datetime import datetime
from urllib.parse import urlencode

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import noon
from ..operators.merge import merged

ANSWER = "gazettes array<struct<url: string, territory_id: string, territory_name: string, state_code: string, date: string, edition: string, excerpts: array<string>>>"
#: The name of the source and the title of its items.
SOURCE, TITLE = "Querido Diário", "Diário Oficial de %s (%s)"


def request_groups(config: dict) -> list[list[str]]:
    return config.get("queryGroups") or ([config["queryTerms"]] if config.get("queryTerms") else [])


def request(base: str, terms: list[str], since: datetime, config: dict) -> dict:
    """A request of one term group; the window is pushed to the service by day, and so is its size."""
    asked = {
        "querystring": " | ".join(f'"{t}"' for t in terms), "published_since": since.date().isoformat(), "excerpt_size": config.get("excerptSize") or 900,
        "number_of_excerpts": config.get("numberOfExcerpts") or 3, "size": config.get("pageSize") or 100, "sort_by": "descending_date",
    }
    return {"name": SOURCE, "url": f"{base}?{urlencode(asked)}", "timeout": (config.get("timeoutMs") or 15000) / 1000, "retries": config.get("retries", 1)}


def gazette_items(payloads: DataFrame, family_ord: int = 1) -> DataFrame:
    """Items of answers. payloads: ord, json. One row for each address, territory and date, with all its excerpts."""
    rows = payloads.select(F.col("ord").alias("query_ord"), F.posexplode(F.from_json("json", ANSWER)["gazettes"]).alias("item_ord", "g"))
    return items_of(rows.select("query_ord", F.col("item_ord").cast("bigint").alias("item_ord"), "g.*"), family_ord)


def items_of(entries: DataFrame, family_ord: int = 1) -> DataFrame:
    """Items of entries (query_ord, item_ord and the fields of an answer's gazettes)."""
    one = merged(entries, ["url", "territory_id", "date"], ["query_ord", "item_ord"], "excerpts")
    text = F.array_join("excerpts", " ")
    return one.select(
        F.lit("gazette").alias("kind"), F.format_string(TITLE, "territory_name", "state_code").alias("title"), "url", noon(F.col("date")).alias("published_at"), F.lit(SOURCE).alias("source"),
        text.alias("summary"), text.alias("raw_text"), "excerpts", "territory_id", "territory_name", "state_code", "edition", F.lit(family_ord).alias("family_ord"), "query_ord", "item_ord",
    )
