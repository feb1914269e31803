"""Collecting: requests of all source families from the settings, their answers, items, health and diagnostics.

Each request is one partition of the HTTP source. A family answers with what its good requests gave; it fails if it is switched
on and none of its requests (or no term at all, for searches and gazettes) succeeded. Sites never fail as a family: if all of
them do, it is degraded.
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timedelta
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import require_success, source_health, union_families
from ..operators.select import recent
from ..schema import DIAGNOSTIC, ITEM
from ..sources import feeds, gazettes, sites
from ..sources.http import answers
from ..sources.tables import written

# The services, the locale of searches and the names of the families, in their order.
SEARCH, GAZETTES = "https://news.google.com/rss/search", "https://api.queridodiario.ok.org.br/gazettes"
LOCALE = {"hl": "pt-BR", "gl": "BR", "ceid": "BR:pt-419"}
FAMILIES = ["Google News", "Querido Diário", "Feeds RSS", "Scrapers web"]


@dataclass
class Collected:
    items: DataFrame
    health: DataFrame
    diagnostics: DataFrame


def _limits(settings: dict, own: dict | None = None) -> dict:
    own, agent = own or {}, settings.get("userAgent")
    retries = own.get("retries", settings.get("retries", 1))
    return {"timeout": (own.get("timeoutMs") or settings.get("timeoutMs") or 12_000) / 1000, "retries": retries, "headers": {"user-agent": agent} if agent else {}}


def requests_of(config: dict, since: datetime, search: str = SEARCH, gazette: str = GAZETTES) -> list[list[dict] | None]:
    """The requests of each family; None where it is switched off."""
    news, acts, rss, web = (config.get(k) or {} for k in ("googleNews", "queridoDiario", "rssFeeds", "webScrapers"))
    return [
        [{"name": q, "url": f"{search}?{urlencode({'q': q} | LOCALE)}", **_limits(news)} for q in news.get("queries", [])] if news.get("enabled") else None,
        [gazettes.request(gazette, terms, since, acts) for terms in gazettes.request_groups(acts)] if acts.get("enabled") else None,
        [{"name": f["name"], "url": f["url"], **_limits(rss, f)} for f in rss.get("feeds", [])] if rss.get("enabled") and rss.get("feeds") else None,
        [{"name": s["name"], "url": s["url"], **_limits(web, s)} for s in web.get("sites", []) if s.get("enabled") is not False] if web.get("enabled") and web.get("sites") else None,
    ]


def collect(spark: SparkSession, config: dict, run_at: datetime, **services: str) -> Collected:
    """Items of all families in the order of FAMILIES; raises if no family succeeded."""
    since = run_at - timedelta(hours=config["lookbackHours"])
    # with the order in which sites are reported
    found, told, diagnostics = [], [], spark.createDataFrame([], DIAGNOSTIC).withColumns({"part": F.lit(0), "place": F.lit(0)})
    asked = list(zip(FAMILIES, requests_of(config, since, **services)))

    def fetched(requests: list[dict] | None) -> tuple[DataFrame | None, float]:
        began = time.time()
        return (None if requests is None else written(answers(spark, requests))), time.time() - began

    # all families are fetched at once, each a job of its own
    with ThreadPoolExecutor(len(FAMILIES)) as pool:
        fetches = list(pool.map(fetched, [requests for _, requests in asked]))
    for (family, requests), (got, seconds) in zip(asked, fetches):
        if requests is None:
            told.append((family, False, False, 0, None))
            continue
        began = time.time()
        text = got.filter("error is null").withColumn("payload", F.col("body").cast("string"))
        if family == FAMILIES[1]:  # an answer that is no JSON is a failed request
            text = text.filter(F.get_json_object("payload", "$").isNotNull())
        some = bool(text.head(1))
        if family == FAMILIES[0]:
            items = recent(feeds.search_items(text.select("ord", F.col("payload").alias("xml"))), run_at, config["lookbackHours"])
        elif family == FAMILIES[1]:
            items = gazettes.gazette_items(text.select("ord", F.col("payload").alias("json")))
        elif family == FAMILIES[2]:
            items = recent(feeds.feed_items(text.select("name", "ord", F.col("payload").alias("xml"))), run_at, config["lookbackHours"])
        else:
            all_sites = config["webScrapers"]["sites"]
            active = [s for s in all_sites if s.get("enabled") is not False]
            # one row a configured site
            meta = spark.createDataFrame([(i, s["adapter"], s.get("publish") is True, s.get("encoding")) for i, s in enumerate(active)], "ord int, adapter string, publish boolean, encoding string")
            parsed = written(sites.parsed_pages(got.join(F.broadcast(meta), "ord")))
            items = recent(sites.site_items(parsed), run_at, config["lookbackHours"])
            diagnostics = sites.diagnostics(parsed, items, [s for s in all_sites if s.get("enabled") is False]).orderBy("part", "place").select([f.name for f in DIAGNOSTIC.fields] + ["part", "place"])
            some = not active or bool(parsed.filter("error is null").head(1))
        millis = int((seconds + time.time() - began) * 1000)
        site = family == FAMILIES[3]
        failed = None if some or site else f"{family}: no request succeeded"
        told.append((family, failed is not None, site and not some, millis, failed))
        if some:
            found.append(items.withColumn("family", F.lit(family)))
    items = written(union_families(spark.createDataFrame([], ITEM).withColumn("family", F.lit("")), *found))
    health = source_health(items, spark.createDataFrame(told, "name string, failed boolean, all_parts_failed boolean, duration_ms long, message string"))
    require_success(health)
    return Collected(items.drop("family"), health, diagnostics)
