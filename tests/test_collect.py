import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from newsloom import registry
from newsloom.plans import queries
from newsloom.plans.collect import collect, requests_of
from newsloom.sources.http import answers

NOW = datetime(2026, 8, 15, tzinfo=timezone.utc)


def settings(folder, **more):
    site = lambda name, **x: {"name": name, "adapter": "rncp", "url": f"file://{folder}/{name}.html", "retries": 0} | x
    return {
        "lookbackHours": 96, "googleNews": {"enabled": False, "queries": ["q"]}, "queridoDiario": {"enabled": True, "queryGroups": [["a", "b"], ["c"]]},
        "rssFeeds": {"enabled": True, "retries": 0, "feeds": [{"name": "F", "url": f"file://{folder}/feed.xml"}, {"name": "G", "url": f"file://{folder}/none.xml"}]},
        "webScrapers": {"enabled": True, "sites": [site("good", publish=True), site("gone"), site("off", enabled=False, fallback="busca")]},
    } | more


def test_requests():
    news, acts, rss, web = requests_of(settings("/x", googleNews={"enabled": True, "queries": ['"a b"']}), NOW)
    assert news[0]["url"].endswith("search?q=%22a+b%22&hl=pt-BR&gl=BR&ceid=BR%3Apt-419") and len(acts) == 2 and len(rss) == 2 and [r["name"] for r in web] == ["good", "gone"]


def test_collect(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>T</title><link>https://a.br/1</link><pubDate>Fri, 14 Aug 2026 12:00:00 GMT</pubDate></item><item><title>Old</title><link>https://a.br/2</link><pubDate>Fri, 14 Aug 2020 12:00:00 GMT</pubDate></item></channel></rss>")
    (tmp_path / "good.html").write_text('<div class="post-item"><h3 class="entry-title"><a href="/n">N</a></h3><span class="post-date">14/08/2026</span></div><div class="post-item"><h3 class="entry-title"><a href="/o">O</a></h3><span class="post-date">01/01/2026</span></div>')
    got = collect(spark, settings(tmp_path), NOW, gazette="file:///nowhere/api")
    assert sorted((r.title, r.scraper, r.preview_only) for r in got.items.collect()) == [("N", "rncp", False), ("T", None, None)]
    assert {r.name: (r.status, r.item_count) for r in got.health.collect()} == {"Google News": ("ok", 0), "Querido Diário": ("error", 0), "Feeds RSS": ("ok", 1), "Scrapers web": ("ok", 1)}
    assert [(r.name, r.status, r.item_count) for r in got.diagnostics.collect()] == [("off", "disabled", 0), ("good", "ok", 1), ("gone", "error", 0)]


def test_all_failing_ends_the_run(spark, tmp_path):
    off = {"enabled": True, "queries": []}
    with pytest.raises(RuntimeError):
        collect(spark, settings(tmp_path, googleNews=off, rssFeeds={"enabled": True, "retries": 0, "feeds": [{"name": "G", "url": f"file://{tmp_path}/none.xml"}]}), NOW, gazette="file:///nowhere/api")
    assert json.dumps(off)


def test_an_answer_that_is_no_json_is_a_failure(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><channel></channel></rss>")
    (tmp_path / "api").write_text("<html>busy</html>")
    got = collect(spark, settings(tmp_path, webScrapers={"enabled": False}), NOW, gazette=f"file://{tmp_path}/api#")
    assert {r.name: r.status for r in got.health.collect()}["Querido Diário"] == "error"


def test_an_address_that_is_none_is_a_failure(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><channel></channel></rss>")
    feeds = [{"name": n, "url": u, "retries": 0} for n, u in (("F", f"file://{tmp_path}/feed.xml"), ("bare", f"{tmp_path}/gone.xml"), ("port", "http://a.example:x/"), ("blank", "http://a b/"), ("host", "http://[a/"))]
    got = answers(spark, feeds).select("name", F.col("error").isNull().alias("good"), (F.col("error") != "").alias("told")).collect()
    assert {tuple(r) for r in got} == {("F", True, None), *((n, False, True) for n in ("bare", "port", "blank", "host"))}


@pytest.mark.parametrize("name", ["collected_items", "source_health"])
def test_queries_with_a_work_folder_without_scheme(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(queries, "work_folder", lambda spark: str(tmp_path / "shared"))
    assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() == (4 if name == "source_health" else 200)
