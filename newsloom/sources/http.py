"""Requests as a Spark data source: one partition a request, with retries inside the task. Answers land as rows.

spark.read.format("radar_http").option("requests", json) gives name, ord, url, status, content_type, body, error. A failed request
is a row with its error, so it does not end the others.
"""

from __future__ import annotations

import http.client
import json
import time
import urllib.error
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Answers worth another attempt, and limits of the pause before it, in seconds.
RETRY, FIRST, MOST, MOST_ASKED = {408, 425, 429, 500, 502, 503, 504}, 0.5, 3.0, 5.0
#: What a request that gives no answer raises: no connection, no whole answer, or an address that is none.
FAILURES = (OSError, http.client.HTTPException, ValueError)
SCHEMA = "name string, ord int, url string, status int, content_type string, body binary, error string"


def pause(retry_after: str | None, attempt: int) -> float:
    """Seconds to wait: as asked, up to MOST_ASKED, else doubling from FIRST up to MOST."""
    try:
        return min(float(int(retry_after)), MOST_ASKED)
    except (TypeError, ValueError):
        return min(FIRST * 2**attempt, MOST)


def fetched(url: str, timeout: float = 12.0, retries: int = 1, headers: dict | None = None, opener=urllib.request.urlopen, sleep=time.sleep) -> tuple[int, str, bytes]:
    """Status, content type and body; the last answer counts even if it is bad, the last exception is raised."""
    for attempt in range(retries + 1):
        asked = None
        try:
            with opener(urllib.request.Request(url, headers=headers or {}), timeout=timeout) as r:
                return r.status or 200, r.headers.get("content-type", ""), r.read()
        except urllib.error.HTTPError as e:
            if e.code not in RETRY or attempt == retries:
                return e.code, e.headers.get("content-type", "") if e.headers else "", e.read() if e.fp else b""
            asked = e.headers.get("retry-after") if e.headers else None
        except (OSError, http.client.HTTPException):
            if attempt == retries:
                raise
        sleep(pause(asked, attempt))
    raise ValueError("retries must not be negative")


class _Request(InputPartition):
    def __init__(self, ord: int, request: dict):
        self.ord, self.request = ord, request


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.requests = json.loads(options.get("requests", "[]"))

    def partitions(self):
        return [_Request(i, r) for i, r in enumerate(self.requests)]

    def read(self, partition):
        r = partition.request
        try:
            status, kind, body = fetched(r["url"], r.get("timeout", 12.0), r.get("retries", 1), r.get("headers"))
            yield r.get("name"), partition.ord, r["url"], status, kind, body, None if 200 <= status < 300 else f"{r.get('name')}: status {status}"
        except FAILURES as e:
            yield r.get("name"), partition.ord, r["url"], None, None, None, str(e) or type(e).__name__


class HttpSource(DataSource):
    @classmethod
    def name(cls):
        return "radar_http"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(dict(self.options))


def answers(spark, requests: list[dict]):
    """The answers to requests ({name, url, timeout, retries, headers})."""
    spark.dataSource.register(HttpSource)
    if not requests:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.format("radar_http").option("requests", json.dumps(requests)).load()
