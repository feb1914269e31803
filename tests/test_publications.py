import json
import threading
from datetime import date, datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from newsloom.sources.gazettes import items_of
from newsloom.sources.publications import first_day, gazette_stream, gazettes

CONFIG = {"queryGroups": [["a", "b"], ["c"]], "retries": 0}


@pytest.fixture
def service():
    """A service that holds entries of days and remembers what it was asked."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
            self.server.asked.append(asked)
            found = [e for e in self.server.held if e["date"] is None or e["date"] >= asked["published_since"]]
            body = json.dumps({"gazettes": found}).encode()
            self.send_response(self.server.status)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    server.asked, server.held, server.status = [], [], 200
    threading.Thread(target=server.serve_forever, daemon=True).start()
    server.base = f"http://127.0.0.1:{server.server_address[1]}/gazettes"
    yield server
    server.shutdown()


def entry(n, day):
    return {"url": f"https://a.br/{n}.pdf", "territory_id": str(n), "territory_name": f"T{n}", "state_code": "SP", "date": day, "edition": None, "excerpts": [f"text {n}"]}


def test_days_of_instants():
    noon = datetime(2026, 8, 14, 15, tzinfo=timezone.utc)
    assert first_day(noon, True) == date(2026, 8, 14) and first_day(noon, False) == date(2026, 8, 15)
    assert first_day(noon.replace(minute=1), True) == date(2026, 8, 15) and first_day(datetime(2026, 8, 14), True) == date(2026, 8, 14)


def test_a_bound_goes_into_the_request(spark, service):
    service.held = [entry(i, f"2026-08-{10 + i}") for i in range(6)] + [entry(9, None)]
    rows = gazettes(spark, service.base, CONFIG)
    assert rows.count() == 14 and {a["published_since"] for a in service.asked} == {"1970-01-01"}
    service.asked.clear()
    bound = F.lit(datetime(2026, 8, 12, 15, tzinfo=timezone.utc)).cast("timestamp")
    some = rows.filter((F.col("published_at") >= bound) & (F.col("territory_name") != "T4"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    post = [line for line in plan.split("\n") if "Filter" in line and "BatchScan" not in line]
    assert not any(">=" in line for line in post) and any("T4" in line for line in post)
    assert sorted(r["territory_name"] for r in some.collect()) == ["T2", "T2", "T3", "T3", "T5", "T5"]
    assert {a["published_since"] for a in service.asked} == {"2026-08-12"} and {a["querystring"] for a in service.asked} == {'"a" | "b"', '"c"'}
    assert sorted(r["title"] for r in items_of(some).collect()) == [f"Diário Oficial de T{i} (SP)" for i in (2, 3, 5)]


def test_failures(spark, service):
    service.status = 500
    with pytest.raises(Exception, match="500"):
        gazettes(spark, service.base, CONFIG).collect()
    assert gazettes(spark, service.base, CONFIG, failures="skip").collect() == []


def test_a_stream_goes_on_where_it_stopped(spark, service, tmp_path):
    seen = []

    def batch(rows, number):
        seen.append(sorted({r["territory_id"] for r in rows.collect()}))
        if fail:
            raise RuntimeError("crash")

    def step():
        stream = gazette_stream(spark, service.base, {"queryTerms": ["a"], "retries": 0}, since="2026-08-10", overlap=1)
        stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()

    fail = False
    service.held = [entry(0, "2026-08-09"), entry(1, "2026-08-10"), entry(2, "2026-08-11")]
    step()
    step()  # nothing new: no batch
    assert seen == [["1", "2"]]
    service.held += [entry(3, "2026-08-11"), entry(4, "2026-08-12")]  # one comes late
    fail = True
    with pytest.raises(Exception, match="crash"):
        step()
    fail = False
    step()  # the same batch again, then nothing
    step()
    assert seen[1:] == [["1", "2", "3", "4"]] * 2
    service.held += [entry(5, "2026-08-12")]
    step()
    assert seen[-1] == ["2", "3", "4", "5"] and set().union(*seen) == {"1", "2", "3", "4", "5"}
