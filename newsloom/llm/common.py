"""Shared pieces: written tables in the cluster's shared folder, global prefix sums, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the op contracts: maximal runs of anything but space, tab, newline, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


#: Edges at which the rounds of `components` end to broadcast.
FEW = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only where that is unset: a temporary folder on a local master, the warehouse elsewhere."""
    said = spark.conf.get("spark.checkpoint.dir", None)
    if said:
        return said.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        own = os.path.join(tempfile.gettempdir(), f"newsloom-{spark.sparkContext.applicationId}")
        return f"file://{own}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/newsloom-work"


#: Paths of the tables written inside each `staged` that is running.
_WRITTEN: list[list[str]] = []


def written(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _WRITTEN:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by written() that no later step reads."""
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        deleted(df.sparkSession, path)


def staged(spark: SparkSession, make) -> DataFrame:
    """written(make()), after which the tables that were written on the way are deleted."""
    made: list[str] = []
    _WRITTEN.append(made)
    try:
        out = written(make())
        keep = made.pop()
    finally:
        _WRITTEN.pop()
        for path in made:
            deleted(spark, path)
    for outer in _WRITTEN:  # an enclosing stage has only this one left to delete
        outer[:] = [p for p in outer if p not in made or p == keep]
    return out


def spaced(text) -> F.Column:
    """The words of a text joined by single spaces; null is the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " "))


def word_count(text) -> F.Column:
    """Number of words of the contracts; null and blank texts have none."""
    plain = spaced(text)
    return F.when(plain == "", F.lit(0)).otherwise(F.length(plain) - F.length(F.translate(plain, " ", "")) + 1).cast("long")


def prefix_sums(df: DataFrame, order: list[str], value: str, whole: list[str] | None = None) -> DataFrame:
    """Add `row_no` (0-based) and `sum_before` (sum of `value` over earlier rows) in the total order `order`.

    Range partitions are sorted alone; their totals (one row a partition) are summed and handed back, so no task holds
    more than its own range. Rows equal in `whole` (leading columns of `order`, default: all) share a partition. The local
    sums are a written table, so partition numbers stay what they were.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in whole or order]).withColumn("_pid", F.spark_partition_id())
    own = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = written(ranged.withColumns({"_prefix_rows": F.row_number().over(own).cast("long"), "_prefix_sum": F.sum(value).over(own)}))
    totals = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_rows"), F.sum(value).alias("_sum"))
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_r0"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_s0"))
    out = local.join(offsets, "_pid")
    return out.withColumns({"row_no": F.col("_r0") + F.col("_prefix_rows") - 1, "sum_before": F.col("_s0") + F.col("_prefix_sum") - F.col(value)}).drop("_pid", "_prefix_rows", "_prefix_sum", "_r0", "_s0")


def small_enough(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if a count shows at most `rows` rows, else df as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: int = 1000) -> DataFrame:
    """left, a written table, joined to right, which has each key once. Keys that over 1 / `share` of the rows of left have, so at most `share`
    keys, meet their row by broadcast where they lie; only the others are shuffled."""
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = written(counts.filter(F.col("_n") * share > left.count()).select(key, F.lit(True).alias("_hot")))
    parted = left.join(F.broadcast(hot), key, "left")
    often = parted.filter("_hot").drop("_hot").join(F.broadcast(right.join(F.broadcast(hot.select(key)), key, "left_semi")), key, how)
    return often.unionByName(parted.filter("_hot is null").drop("_hot").join(right, key, how))


def apart(spark: SparkSession, n: int, parts: int) -> np.ndarray:
    """n different numbers of groups that repartition(parts, number) deals evenly to its partitions, where plain numbers would meet by chance."""
    tries = spark.range(n * 4 + parts * 40).select(F.pmod(F.hash("id"), F.lit(parts)).alias("part"), "id")
    every = tries.toArrow()
    part, number = every.column("part").to_numpy(), every.column("id").to_numpy()
    order = np.argsort(part, kind="stable")
    place = np.arange(len(part)) - np.repeat(np.flatnonzero(np.diff(part[order], prepend=-1)), np.unique(part, return_counts=True)[1])
    return number[order][np.argsort(place, kind="stable")[:n]]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (smallest node reachable) of every node that stands in an edge, by alternating large and small stars.

    Each round is two grouped minima joined back on their key. The minima are broadcast while there are at most FEW edges; beyond, a
    node with many neighbours is a skewed join that adaptive execution splits, never one group in one task. Rounds are written tables; they end when the edges, which by
    then all point at roots, stay as they are.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    while state[0]:
        both = e.union(e.select("v", "u"))
        near = F.broadcast if state[0] <= FEW else lambda df: df  # at most two nodes an edge
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(near(low), "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near(low), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = new.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        dropped(e)
        e, state, before = new, now, state
        if now == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _crc_steps() -> list[int]:
    """What four zero bits do to each low half byte of a CRC-32, from its polynomial."""
    steps = list(range(16))
    for _ in range(4):
        steps = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in steps]
    return steps


def crc32_sql(text: str) -> str:
    """SQL of the unsigned CRC-32 of a text of the characters that have one byte or two, half byte by half byte."""
    half = f"[{', '.join(map(str, _crc_steps()))}]::BIGINT[]"
    byte = "CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END"
    halves = f"flatten(list_transform(flatten(list_transform(string_split({text}, ''), lambda c: {byte})), lambda b: [CAST(b % 16 AS BIGINT), CAST(b // 16 AS BIGINT)]))"
    return f"xor(list_reduce({halves}, lambda a, h: xor(a // 16, ({half})[CAST(xor(a % 16, h) + 1 AS BIGINT)]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"
