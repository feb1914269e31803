import io
import json
import urllib.error
from datetime import datetime, timezone

from pyspark.sql import functions as F

from newsloom.operators import merge
from newsloom.sources import config, feeds, gazettes, http, sites, state

NOW = datetime(2026, 8, 20, tzinfo=timezone.utc)


def shown(df, *columns):
    return [tuple(r) for r in df.withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm")).select(*columns).collect()]


def test_rss_and_atom(spark):
    rss = """<rss><channel><title>c</title><item><title>Um &amp; dois</title><link>https://a.br/1</link><pubDate>Fri, 14 Aug 2026 12:00:00 GMT</pubDate><description><![CDATA[<b>texto</b> longo]]></description>
    <source url="https://pub.br">Publicador</source></item><item><title>Sem data</title><link>https://a.br/2</link></item></channel></rss>"""
    atom = """<feed><entry><title>E</title><link rel="self" href="https://b.br/self"/><link rel="alternate" href="https://b.br/alt"/><updated>2026-08-14T09:00:00-03:00</updated><summary>s</summary></entry></feed>"""
    payloads = spark.createDataFrame([("A", 0, rss), ("B", 1, atom), ("C", 2, "broken")], "name string, ord int, xml string")
    assert sorted(shown(feeds.feed_items(payloads), "title", "url", "published_at", "source", "summary")) == [("E", "https://b.br/alt", "2026-08-14 12:00", "B", "s"), ("Um & dois", "https://a.br/1", "2026-08-14 12:00", "A", "texto longo")]
    assert shown(feeds.search_items(payloads.filter("ord = 0")), "source", "source_url", "title") == [("Publicador", "https://pub.br", "Um & dois")]


def test_gazettes_merge(spark):
    g = lambda *e: {"url": "u", "territory_id": "1", "territory_name": "Belo", "state_code": "MG", "date": "2026-08-14", "edition": "7", "excerpts": list(e)}
    rows = [(0, json.dumps({"gazettes": [g("um", "<i>dois</i>")]})), (1, json.dumps({"gazettes": [g("dois", "", "três")]})), (2, "{}")]
    got = gazettes.gazette_items(spark.createDataFrame(rows, "ord int, json string"))
    assert shown(got, "title", "excerpts", "summary", "published_at", "territory_name") == [("Diário Oficial de Belo (MG)", ["um", "dois", "três"], "um dois três", "2026-08-14 15:00", "Belo")]
    r = gazettes.request("https://x", ["a b", "c"], NOW, {})
    assert "querystring=%22a+b%22+%7C+%22c%22" in r["url"] and "published_since=2026-08-20" in r["url"]
    assert gazettes.request_groups({"queryTerms": ["a"]}) == [["a"]] and gazettes.request_groups({}) == []


def test_sites(spark):
    card = '<div class="post-item x"><h3 class="entry-title"><a href="/n/1">Título</a></h3><span class="post-date updated">17/08/2026</span><p class="post-excerpt">Resumo</p></div>'
    heading = '<h2><span class="data-noticia-internas">16/08/2026</span> <a href="/Noticia/5">Corte &ccedil;</a></h2><div></div><p>Texto</p><h2><span class="data-noticia-internas">-</span><a href="/Noticia/6">x</a></h2>'
    data = json.dumps({"props": {"dados": {"data": [{"titulo": "T", "slug": "s", "datetime": "15/08/2026 10:00", "conteudo": "<p>c</p>"}]}}}).replace('"', "&quot;")
    index = '<a id="downloadPdf" href="/e.pdf"></a><div id="ultima-edicao"><span>14/08/2026</span></div>'
    pages = [("A", "rncp", card), ("B", "tce-mg", heading), ("C", "cnm", f'<div id="app" data-page="{data}"></div>'), ("D", "diario-municipal-index", index), ("E", "rncp", "<p>"), ("F", "nope", "x")]
    rows = [(n, a, f"https://{n.lower()}.br/x", n == "B", "windows-1252" if n == "B" else None, i, "text/html", bytearray(h.encode("cp1252")), None) for i, (n, a, h) in enumerate(pages)]
    frame = spark.createDataFrame(rows, "name string, adapter string, url string, publish boolean, encoding string, ord int, content_type string, body binary, error string")
    parsed = sites.parsed_pages(frame).cache()
    items = sites.site_items(parsed)
    assert sorted(shown(items, "source", "kind", "title", "url", "published_at", "summary", "preview_only")) == [
        ("A", "news", "T\ufffdtulo", "https://a.br/n/1", "2026-08-17 15:00", "Resumo", True), ("B", "news", "Corte ç", "https://b.br/Noticia/5", "2026-08-16 15:00", "Texto", False),
        ("C", "news", "T", "https://c.br/comunicacao/noticias/s", "2026-08-15 15:00", "c", True), ("D", "gazette-index", "Edição oficial mais recente — D", "https://d.br/e.pdf", "2026-08-14 15:00", sites.NOT_READ, True),
    ]
    told = {r.name: (r.status, r.item_count) for r in sites.diagnostics(parsed, items, [{"name": "G", "adapter": "x", "fallback": "busca"}]).collect()}
    assert told == {"A": ("ok", 1), "B": ("ok", 1), "C": ("ok", 1), "D": ("ok", 1), "E": ("error", 0), "F": ("error", 0), "G": ("disabled", 0)}


def test_retries():
    assert [http.pause(*x) for x in (("60", 0), (None, 0), (None, 1), (None, 3), ("x", 0))] == [5.0, 0.5, 1.0, 3.0, 0.5]
    waits, answers = [], [urllib.error.HTTPError("u", 503, "", {"retry-after": "2"}, None), OSError("down"), None]

    class Ok(io.BytesIO):
        status, headers = 200, {"content-type": "text/plain"}

    def opener(request, timeout):
        x = answers.pop(0)
        if x:
            raise x
        return Ok(b"body")

    assert http.fetched("http://x", retries=2, opener=opener, sleep=waits.append) == (200, "text/plain", b"body") and waits == [2.0, 1.0]
    answers[:] = [urllib.error.HTTPError("u", 404, "", {}, None)]
    assert http.fetched("http://x", retries=2, opener=opener, sleep=waits.append)[0] == 404


def test_http_source_isolates_failures(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    rows = http.answers(spark, [{"name": "a", "url": f"file://{tmp_path}/a.txt"}, {"name": "b", "url": "file:///nowhere/b", "retries": 0}]).orderBy("ord").collect()
    assert bytes(rows[0].body) == b"hello" and rows[1].error and rows[1].body is None
    assert http.answers(spark, []).count() == 0


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"maxPostsPerRun": 3, "maxPostsPerDay": 72, "lookbackHours": 96}))
    got = config.load(str(path), {"SEND_ENABLED": "Sim", "MAX_POSTS_PER_RUN": "0", "MAX_POSTS_PER_DAY": "12x", "LOOKBACK_HOURS": ""})
    assert (got["sendEnabled"], got["maxPostsPerRun"], got["maxPostsPerDay"], got["lookbackHours"]) == (True, 3, 12, 96)


def test_state_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/state"
    assert state.load_history(spark, folder).count() == 0
    row = lambda i, at: (i, at, "u", "t", "f", ["a"], "CRISE")
    old = spark.createDataFrame([row("1", datetime(2020, 1, 1)), row("2", datetime(2026, 8, 1)), row("3", None)], state.SEEN)
    kept = state.pruned(old, NOW)
    assert sorted(r.id for r in kept.collect()) == ["2", "3"]
    state.save_history(state.upserted(kept, spark.createDataFrame([row("2", datetime(2026, 8, 9)), row("4", NOW)], state.SEEN)), folder)
    state.save_history(state.load_history(spark, folder), folder)
    assert sorted((r.id, str(r.sent_at)[:10]) for r in state.load_history(spark, folder).collect()) == [("2", "2026-08-09"), ("3", "None"), ("4", "2026-08-20")]


def test_delivery_stops_at_an_error(spark, tmp_path):
    from newsloom.operators.dedupe import with_keys

    items = spark.createDataFrame([(i, f"https://a.br/{i}", f"title {i}", "s", "CRISE", f"m{i}") for i in range(3)], "n int, url string, title string, summary string, category string, text string")
    sent = []

    def send(text):
        if text == "m1":
            raise OSError("down")
        sent.append(text)

    keyed, empty = with_keys(items), spark.createDataFrame([], state.SEEN)
    try:
        state.delivered(keyed, "n", send, f"file://{tmp_path}/out", NOW, empty)
    except OSError:
        pass
    assert sent == ["m0"]
    assert state.delivered(keyed.filter("n <> 1"), "n", send, f"file://{tmp_path}/out", NOW, state.with_outbox(empty, f"file://{tmp_path}/out")).count() == 2


def test_health(spark):
    families = spark.createDataFrame([("a",), ("a",), ("b",)], "family string")
    requests = spark.createDataFrame([("a", False, False, 5, None), ("b", True, False, 5, "m"), ("c", False, True, 5, None)], "name string, failed boolean, all_parts_failed boolean, duration_ms long, message string")
    health = merge.source_health(families, requests)
    assert {tuple(r) for r in health.collect()} == {("a", "ok", 2, 5, None), ("b", "error", 0, None, "m"), ("c", "degraded", 0, 5, None)}
    merge.require_success(health)
    try:
        merge.require_success(health.filter("name <> 'a'"))
        raise AssertionError("should end the run")
    except RuntimeError:
        pass


def test_destination():
    assert state.require_destination("123-456@g.us") == "123-456@g.us"
    for bad in ("", None, "123@c.us", "x123@g.us"):
        try:
            state.require_destination(bad)
            raise AssertionError(bad)
        except ValueError:
            pass


def test_pages_as_a_table_function(spark):
    from newsloom.sources import sites

    sites.register(spark)
    good = '<div class="post-item"><h3 class="entry-title"><a href="/{0}">{0}</a></h3><span class="post-date">14/08/2026</span></div>'
    spark.createDataFrame([("a", "rncp", (good.format("x") + good.format("y")).encode(), None), ("b", "none", b"", None), ("c", "rncp", None, "gone")], "name string, adapter string, body binary, error string").createOrReplaceTempView("fetched_pages")
    got = spark.sql("SELECT p.name, i.item_ord, i.href, i.error FROM fetched_pages p, LATERAL page_items(p.adapter, p.body, NULL, NULL, p.error) i ORDER BY 1, 2").collect()
    assert [tuple(r) for r in got] == [("a", 0, "/x", None), ("a", 1, "/y", None), ("b", -1, None, "unknown adapter: none"), ("c", -1, None, "gone")]


def test_pages_are_read_by_batches_over_all_cores(spark):
    from newsloom.plans import towns

    good = '<div class="post-item"><h3 class="entry-title"><a href="/{0}">{0}</a></h3></div>'
    rows = [(str(i), "rncp" if i % 3 else "none", "https://s", None, None, i, None, "".join(good.format(j) for j in range(i % 4)).encode() if i % 5 else None, "gone" if i % 7 == 0 else None) for i in range(40)]
    pages = spark.createDataFrame(rows, "name string, adapter string, url string, publish boolean, encoding string, ord int, content_type string, body binary, error string")
    got = sites.parsed_pages(pages)
    want = [(n, a, u, False, o, *found) for n, a, u, _, e, o, t, b, x in rows for found in sites.items_in(a, b, e, t, x)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert "UDTF" not in got._jdf.queryExecution().executedPlan().toString()
    assert towns._pages(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_messages_are_made_of_one_pass_over_the_items(spark):
    from newsloom.plans import towns

    plan = towns.message_render(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("customer") <= 1 and plan.count("Join") == 1  # with the nations
