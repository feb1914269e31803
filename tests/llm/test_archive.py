import base64
from collections import defaultdict
from hashlib import sha1

import pytest
from pyspark.sql import functions as F

from newsloom.llm import archive as A
from newsloom.llm.common import shared_folder, written

DATA = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string"
ODD = [
    (1, "http://a/1", "same"), (2, "http://a/2", "same"), (2, "http://a/2", "same"), (None, "http://a/n", "same"), (3, None, None), (4, "http://a/4", ""), (None, "x", "nameless"), (None, None, "nameless"),
    (5, "http://a/%0A\r\nWARC-Type: revisit", "WARC/1.1\r\n\r\n\r\nWARC-Type: x\r\nContent-Length: 9\r\n\r\n"), (6, "http://ü/é?q=% 1", "ü" * 50_000 + "\r\n\r\n"), (-7, "", "\n"), (0, " lead and trail ", "\r\n"),
]


def b32(payload):
    return base64.b32encode(sha1((payload or "").encode()).digest()).decode()


def plain(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) of every page, sorted as text."""
    groups, out = defaultdict(list), []
    for r in rows:
        groups[r[2] or ""].append(r[0])
    for body, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        size = len(body.encode())
        out += [(i, size, b32(body), "revisit" if k and size >= least else "response", ids[0] if k and size >= least else None) for k, i in enumerate(ids)]
    return sorted(map(str, out))


def archived(spark, pages, name, **how):
    folder = f"{shared_folder(spark)}/{name}"
    store = A.stored(pages, folder, **how)
    A.to_warc(spark, store, f"{folder}/warc")
    return store, written(A.read_warc(spark, f"{folder}/warc"))


def result(records):
    out = A.restored(records, ["payload_bytes"]).select(F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "type", F.col("refers_page").cast("long"))
    return sorted(str(tuple(r)) for r in out.collect())


def test_whole_table(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    out = A.op12_warc(spark, DATA)
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(str(tuple(r)) for r in out.collect()) == plain(pages)


@pytest.mark.parametrize("least", [0, 5, 1000])
def test_odd_pages_come_back_as_they_were(spark, least):
    extra = {"digest": F.lit(1), "_row": F.lit(2), "payload": F.lit("x"), "id": F.lit(3)}
    pages = spark.createDataFrame(ODD, SCHEMA).withColumns(extra)
    store, records = archived(spark, pages, f"odd{least}", least=least)
    assert result(records) == plain(ODD, least)
    whole = A.restored(records, ["payload"])
    want = sorted(str((r[0], r[1], (r[2] or "").encode())) for r in ODD)
    assert sorted(str((r[0] and int(r[0]) if r[0] != "0" else 0, r[1], bytes(r[2]))) for r in whole.select("page_id", "url", "payload").collect()) == want
    kept = [bytes(r[0]) for r in spark.read.parquet(store.payloads).select("payload").collect()]
    assert sorted(kept) == sorted({(r[2] or "").encode() for r in ODD if len((r[2] or "").encode()) >= least})


def test_a_hot_payload_is_stored_once(spark):
    rows = [(i, f"http://h/{i}", "hot page" if i % 3 else f"own {i // 6}") for i in range(3000)]
    store, records = archived(spark, spark.createDataFrame(rows, SCHEMA).repartition(6), "hot", archive=20_000)
    assert store.buckets > 1 and result(records) == plain(rows)
    assert spark.read.parquet(store.payloads).count() == len({r[2] for r in rows})


def test_no_pages(spark):
    assert result(archived(spark, spark.createDataFrame([], SCHEMA), "none")[1]) == []


def test_headers_are_exact_and_the_format_is_kept(spark):
    store, records = archived(spark, spark.createDataFrame(ODD[:2], SCHEMA), "exact")
    with A.payloads_of(spark, store) as payloads:
        rebuilt = {r["record_id"]: r["record"] for r in A.rebuilt(spark, store, payloads).collect()}
    for r in spark.read.parquet(store.heads).collect():
        text = rebuilt[r["record_id"]]
        assert text == r["header"] + r["http"] + ("same" if r["type"] == "response" else "") and r["header"].startswith(f"WARC/1.1\r\nWARC-Type: {r['type']}\r\n")
        (fields, block), = A.records_in(text.encode() + b"\r\n\r\n")
        assert int(fields["content-length"]) == len(block) and fields["warc-payload-digest"] == f"sha1:{b32('same')}"
    assert {r["type"] for r in records.collect()} == {"response", "revisit"}


def test_archives_of_others(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\n\r\nh\xffi"
    said = f"sha1:{base64.b32encode(sha1(b'h' + bytes([255]) + b'i').digest()).decode()}"
    record = lambda digest: f"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <u:1>\r\nWARC-Payload-Digest: {digest}\r\nContent-Type: application/http\r\nContent-Length:{len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    import gzip

    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(record(said)))  # a member a record
    rows = A.read_warc(spark, f"file://{tmp_path}/a.warc.gz").collect()
    assert [r["type"] for r in rows] == ["warcinfo", "response"] and bytes(rows[1]["payload"]) == b"h\xffi" and rows[1]["payload_digest"] == said[5:]
    (tmp_path / "b.warc").write_bytes(record("sha1:" + "A" * 32))
    with pytest.raises(Exception, match="has not the digest"):
        A.read_warc(spark, f"file://{tmp_path}/b.warc").collect()
    with pytest.raises(ValueError):
        list(A.records_in(info[:-2]))


def test_a_damaged_store_is_not_written_out(spark):
    folder = f"{shared_folder(spark)}/damaged"
    store = A.stored(spark.createDataFrame(ODD, SCHEMA), folder)
    bad = spark.read.parquet(store.payloads).withColumn("payload", F.lit(b"other"))
    with pytest.raises(Exception, match="missing or damaged"):
        A.rebuilt(spark, store, bad).collect()
    with pytest.raises(Exception, match="missing or damaged"):
        A.rebuilt(spark, store, bad.limit(1)).collect()


def test_buckets_follow_the_shuffle():
    assert [A.buckets_of(n, 12) for n in (1, 5, 7, 12, 13, 30)] == [1, 6, 12, 12, 24, 36]
