"""Content-addressed WARC archive: payloads once by a verified strong digest, record headers apart, records rebuilt by joins.

A first scan takes each page's SHA-256, SHA-1 and size only. Of pages with one SHA-256 (sizes and SHA-1 must agree, else the run fails) the one with
the smallest id becomes a response, the others revisit it. The store has two tables: `heads` with the exact WARC and HTTP header of every
record, and `payloads` with each payload once, in buckets by digest. Payloads below `least` bytes stay with their heads; their records are
all responses. WARC files are joins of the two, bucket by bucket, so no payload is shuffled a second time, and each payload must have the digest
it is kept under. Reading parses records by their lengths, takes the digest of every payload anew, and finds what a revisit stands for by a
join on the record it refers to.

Null html is the empty payload; empty payloads are copies of each other like any others. Null id: the response only where all ids of its group are
null, and then refers_to is null. Repeated ids and repeated rows: records of their own; one of them is the response. Null url: no target field;
line ends in a url are escaped. Very long pages are records like any other; an archive is read whole, so it holds ARCHIVE bytes or one record
more. Empty table: no records. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import gzip
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import deleted, hot_join, shared_folder, table, written

LEAST = 0
#: Bytes of an archive, before compression.
ARCHIVE = 64 << 20
#: Bytes that a record's headers take, about.
HEAD = 1000
DATE = "1970-01-01T00:00:00Z"
END = "\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Fixed value of the format: what a revisit record is.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hexadecimal: Column, digits: int = 40) -> Column:
    """Upper-case base 32 of a number of hex digits that five divides."""
    fives = [F.conv(F.substring(hexadecimal, i, 5), 16, 10).cast("long") for i in range(1, digits, 5)]
    return F.concat(*[F.lit(ALPHABET).substr((F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for v in fives for s in (15, 10, 5, 0)])


def digested(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int = LEAST) -> DataFrame:
    """A written table: _row, id, url, digest, sha1, bytes, and the payload itself only where it is below `least` bytes."""
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    return written(
        pages.select(
            F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.sha2(body, 256).alias("digest"), base32(F.sha1(body)).alias("sha1"),
            F.octet_length(body).cast("long").alias("bytes"), F.when(F.octet_length(body) < least, body).alias("small"),
        )
    )


def typed(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """Rows with record_id, type (response or revisit) and refers_to (a record_id)."""
    name = F.md5(F.concat_ws(" ", F.col("_row").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("-")), "digest"))
    rows = rows.withColumn("record_id", F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>"))
    same = (F.min("sha1") == F.max("sha1")) & (F.min("bytes") == F.max("bytes"))
    # one row a payload, pre-aggregated in each task
    first = rows.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull(), "id", "_row", "record_id")).alias("_first"), same.alias("_same"))
    first = first.select("digest", F.when(F.col("_same"), F.col("_first")).otherwise(F.raise_error(F.lit("different payloads of one digest"))).alias("_first"))
    out = hot_join(rows, first, "digest")
    own = (F.col("_first._row") == F.col("_row")) | (F.col("bytes") < least)
    return out.select(*rows.columns, F.when(own, "response").otherwise("revisit").alias("type"), F.when(~own, F.col("_first.record_id")).alias("refers_to"))


def _line(name: str, value: Column) -> Column:
    """A header line; none for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def headed(rows: DataFrame, date: str = DATE) -> DataFrame:
    """Rows with `header`, the WARC header up to its empty line, and `http`, the HTTP header that begins the record's block."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END + END))
    length = F.octet_length("http") + F.when(F.col("type") == "response", F.col("bytes")).otherwise(0)
    broken = F.col("url").rlike(r"[\r\n]")
    escaped = F.replace(F.replace(F.replace("url", F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [
        _line("WARC-Type", F.col("type")), _line("WARC-Record-ID", F.col("record_id")), _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.when(~broken, F.col("url"))), _line("WARC-Target-URI-Escaped", F.when(broken, escaped)), _line("WARC-Page-ID", F.col("id").cast("string")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")), _line("WARC-Refers-To", F.col("refers_to")), _line("WARC-Profile", F.when(F.col("type") == "revisit", PROFILE)),
        _line("Content-Type", F.lit("application/http; msgtype=response")), _line("Content-Length", length.cast("string")),
    ]
    return rows.withColumn("http", http).withColumn("header", F.concat(F.lit(f"WARC/1.1{END}"), *lines, F.lit(END)))


@dataclass
class Store:
    """Folders of the two tables, and the number of the payloads' buckets."""

    heads: str
    payloads: str
    buckets: int


def buckets_of(needed: int, partitions: int) -> int:
    """As many buckets as needed or somewhat more, so that rows shuffled to `partitions` by digest lie bucket by bucket."""
    return partitions * -(-needed // partitions) if needed >= partitions else next(d for d in range(needed, partitions + 1) if partitions % d == 0)


def stored(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, date: str = DATE, archive: int = ARCHIVE) -> Store:
    """Write the two tables of a new store below `folder`."""
    spark = pages.sparkSession
    slim = digested(pages, id_col, url_col, payload_col, least)
    size = slim.agg(F.coalesce(F.sum(F.col("bytes") + HEAD), F.lit(0))).first()[0]
    cores, partitions = spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets_of(min(50_000, max(1, -(-size // archive), min(cores, size >> 20))), partitions)
    heads = headed(typed(slim, least), date).select("_row", "record_id", "id", "type", "refers_to", "digest", "sha1", "bytes", "header", "http", "small")
    heads.write.option("compression", "zstd").parquet(f"{folder}/heads")
    body = pages.select(F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload")).filter(F.octet_length("payload") >= least)
    # copies are dropped in each task before they are dealt to their buckets, which one shuffle does
    once = body.groupBy(F.sha2("payload", 256).alias("digest")).agg(F.first("payload").alias("payload"))
    name = f"payloads_{uuid.uuid4().hex}"
    once.write.option("compression", "zstd").option("path", f"{folder}/payloads").bucketBy(buckets, "digest").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    return Store(f"{folder}/heads", f"{folder}/payloads", buckets)


@contextmanager
def payloads_of(spark: SparkSession, store: Store) -> Iterator[DataFrame]:
    """The payloads as a table in buckets."""
    name = f"payloads_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (digest STRING, payload BINARY) USING parquet CLUSTERED BY (digest) INTO {store.buckets} BUCKETS LOCATION '{store.payloads}'")
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def rebuilt(spark: SparkSession, store: Store, payloads: DataFrame) -> DataFrame:
    """record_id and the exact bytes of every record of a store, without the two line ends that close it; fails where a payload has not its digest."""
    heads = spark.read.parquet(store.heads).select("record_id", "type", "digest", F.concat("header", "http").alias("head"), "small")
    whole = heads.filter("type = 'response' and small is null").hint("shuffle_hash").join(payloads, "digest", "left")
    right = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("a payload of the store is missing or damaged")))
    rest = heads.filter("type = 'revisit' or small is not null")
    return whole.select("record_id", F.concat("head", right.cast("string")).alias("record")).unionByName(rest.select("record_id", F.concat("head", F.coalesce(F.col("small").cast("string"), F.lit(""))).alias("record")))


def to_warc(spark: SparkSession, store: Store, path: str) -> None:
    """Write the records of a store as compressed WARC files."""
    with payloads_of(spark, store) as payloads:
        rebuilt(spark, store, payloads).select("record").write.option("lineSep", END + END).option("compression", "gzip").text(path)


def records_in(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """Header fields (names in lower case) and block of each record of an archive; fails where it does not follow the format."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].split(b"\r\n")
        fields = {name.decode().lower(): value.removeprefix(b" ").decode() for name, _, value in (line.partition(b":") for line in lines)}
        stop = end + 4 + int(fields["content-length"])
        if not first.startswith(b"WARC/") or data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("not a WARC record")
        yield fields, data[end + 4 : stop]
        at = stop + 4


READ = "record_id string, type string, page_id string, url string, refers_to string, payload_digest string, payload_bytes long, http string, payload binary"


def _parsed(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in (x.as_py() for b in batches for x in b.column(0)):
            out = []
            for fields, block in records_in(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                http, gap, body = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
                said, full = fields.get("warc-payload-digest"), fields.get("warc-type") == "response"
                if full:
                    own = "sha1:" + base64.b32encode(sha1(body).digest()).decode()
                    if said and said.startswith("sha1:") and own != said:
                        raise ValueError("a payload has not the digest of its record")
                    said = own
                url = fields.get("warc-target-uri")
                if "warc-target-uri-escaped" in fields:
                    url = fields["warc-target-uri-escaped"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                out.append((fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-page-id"), url, fields.get("warc-refers-to"), said and said.removeprefix("sha1:"), len(body) if full else None, (http + gap).decode(errors="replace"), body if full and payloads else None))
            types = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(types), types)], [f.split()[0] for f in READ.split(", ")])

    return run


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of WARC files, compressed or not: READ. payload_bytes and payload_digest of a response are taken from its payload, which `payloads` leaves out."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parsed(payloads), READ)


def restored(records: DataFrame, columns: list[str]) -> DataFrame:
    """Records with `columns` of what a revisit stands for in place of its own, and its page as `refers_page`. records: a written table."""
    full = records.filter("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("refers_page"), *[F.col(c).alias(f"_{c}") for c in columns])
    again = hot_join(records.filter("type = 'revisit'"), full, "refers_to", "left").withColumns({c: F.col(f"_{c}") for c in columns})
    return records.filter("type <> 'revisit'").withColumn("refers_page", F.lit(None).cast("string")).unionByName(again.select(*records.columns, "refers_page"))


def op12_warc(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    to_warc(spark, stored(pages, folder), f"{folder}/warc")
    slim = written(read_warc(spark, f"{folder}/warc", payloads=False).drop("http", "payload"))
    deleted(spark, folder)
    kind = dict(pages.dtypes)["page_id"]
    out = restored(slim, ["payload_bytes"])
    return out.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_page").cast(kind).alias("refers_to"))


ORACLE_SQL = f"""
WITH bodies AS (SELECT page_id, coalesce(html, '') AS body, row_number() OVER () AS r FROM pages
), digests AS (
  SELECT page_id, r, strlen(body) AS payload_bytes, sha1(body) AS h, first_value(r) OVER own AS first_r, first_value(page_id) OVER own AS first_id
  FROM bodies WINDOW own AS (PARTITION BY sha256(body) ORDER BY page_id NULLS LAST, r)
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('{ALPHABET}', CAST(('0x' || substr(h, 5 * (k // 4) + 1, 5))::BIGINT // CAST(power(32, 3 - k % 4) AS BIGINT) % 32 + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN r = first_r THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r <> first_r THEN first_id END AS refers_to
FROM digests
"""
