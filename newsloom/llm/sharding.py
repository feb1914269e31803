"""Contiguous shards of near-equal bytes, cut by global prefix sums of per-partition totals.

Law `bytes`: documents stand in the order of (hash of the text, doc_id), so equal texts are neighbours; the running byte
sum is cut at equal targets. Equal texts keep together unless their bytes are over 1/SMALL of a shard's target: such a
group is cut like any other rows, so no shard is more than 1/SMALL of the target plus one document from even.

Very long texts are read once, for size and checksums, and count like any other. Null text: 16 bytes, grouped with other nulls (crc of the empty text). Null doc_id: sorted first within its text.
Repeated rows: each row gets its own slot. Empty table: no rows. Fewer rows than shards: some shards stay empty.
Extra columns, whatever their names, are not read: the result holds only the id, size, checksum, shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, prefix_sums, table, written

SHARDS = 40
SMALL = 100
OVERHEAD = 16


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """id, size, text_crc32, shard and slot of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # one scan of the texts; all that follows reads 40 bytes a row
    rows = slim = written(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + overhead).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_h"), F.monotonically_increasing_id().alias("_row")))
    groups = rows.groupBy("_h", "text_crc32").agg(F.sum("size").alias("_bytes"))
    total = groups.agg(F.coalesce(F.sum("_bytes"), F.lit(0))).first()[0]
    target = max(1, total // shards)
    # at most shards * SMALL groups can be this large
    large = groups.filter(F.col("_bytes") * SMALL > target).select("_h", "text_crc32", F.lit(True).alias("_large"))
    rows = rows.join(F.broadcast(large), ["_h", "text_crc32"], "left")
    # the number of a row, written once, parts also rows without id or of one id
    rows = rows.withColumn("_cut", F.when(F.col("_large"), F.struct("doc_id", "_row")))
    placed = prefix_sums(rows, ["_h", "text_crc32", "_cut", "doc_id", "size"], "size", whole=["_h", "text_crc32", "_cut"])
    dropped(slim)
    # a small group stands where its first row stands; its rows came through one partition
    at = F.when(F.col("_large"), F.col("sum_before")).otherwise(F.min("sum_before").over(Window.partitionBy("_h", "text_crc32", "_cut")))
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(at * shards / F.lit(max(1, total))).cast("int")))
    first = placed.groupBy("shard").agg(F.min("row_no").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row_no") - F.col("_first")).alias("slot"))


def op5_sharding(spark, sf_dir) -> DataFrame:
    out = sharded(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
