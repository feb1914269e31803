"""Best-fit packing of documents into training bins under conflicts.

A document is cut to pieces of at most CAPACITY words (only the last is shorter). Pieces are dealt at random to groups of
about PACK pieces, and each group packs its own bins, longest piece first. Open bins stand in lists by residual; the search
starts at the tightest residual that holds the piece and goes on to its successors until a compatible bin is found, else a
bin is opened. A bin carries bitmaps: one bit for each duplicate cluster of the group (a cluster stands in a bin once), and
PER_SOURCE planes of a bit for each source (a source stands in a bin at most PER_SOURCE times). Without that bound, the
one source that holds a third of all rows would fill whole bins; with planes it is spread over all of them.

Duplicate clusters are texts equal but for case and white space, unless a cluster column is named. Hot clusters and sources
are dealt over all groups, so no group or task grows with them.

Ties: of equally long pieces that of the smaller row number goes first; of equally tight bins the first compatible one of their list. Very long documents are cut like any other.
Documents without words get one row with no bin. Null source: a source of its own. Null doc_id and repeated rows: packed row by
row. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spaced, table, written

CAPACITY, PACK, PER_SOURCE = 2048, 8192, 4


def best_fit(pieces: list[tuple], capacity: int, per_source: int = PER_SOURCE) -> list[tuple[int, int]]:
    """(bin, offset) of each (length, source, cluster), in their order; pass the longest first for a tight packing."""
    seen: dict = {}
    for _, _, cluster in pieces:
        seen[cluster] = seen.get(cluster, 0) + 1
    cluster_bit = {c: 1 << i for i, c in enumerate(c for c, n in seen.items() if n > 1)}
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for _, s, _ in pieces))}
    residual, clusters, planes = [], [], []
    at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by residual
    some = 0  # bit r: at[r] has bins
    out = []
    for length, source, cluster in pieces:
        c, s, found, r = cluster_bit.get(cluster, 0), source_bit[source], -1, length
        while found < 0 and (higher := some >> r):
            r += (higher & -higher).bit_length() - 1
            for k, b in enumerate(at[r]):
                if not clusters[b] & c and not planes[b][-1] & s:
                    found = b
                    at[r][k] = at[r][-1]
                    at[r].pop()
                    break
            else:
                r += 1
        if found < 0:
            found, r = len(residual), capacity
            residual.append(capacity)
            clusters.append(0)
            planes.append([0] * per_source)
        elif not at[r]:
            some &= ~(1 << r)
        out.append((found, capacity - r))
        residual[found] = r - length
        clusters[found] |= c
        for j in range(per_source):
            if not planes[found][j] & s:
                planes[found][j] |= s
                break
        at[r - length].append(found)
        some |= 1 << (r - length)
    return out


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, capacity: int = CAPACITY, pack: int = PACK, per_source: int = PER_SOURCE) -> DataFrame:
    """doc_id, source, piece, start, length (words), bin_id, bin_offset of every piece of every document."""
    plain = spaced(F.col(text_col))
    cluster = F.col(cluster_col).cast("string") if cluster_col else F.xxhash64(F.lower("_plain")).cast("string")
    rows = docs.withColumn("_plain", plain).withColumn("size", F.when(F.col("_plain") == "", 0).otherwise(F.length("_plain") - F.length(F.translate("_plain", " ", "")) + 1).cast("long"))
    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(cluster, F.lit("")).alias("cluster"), "size")
    last = F.greatest(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / capacity).cast("long"))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("start", F.col("piece") * capacity)
    rows = written(rows.select("doc_id", "source", "cluster", "piece", "start", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("start")).alias("length")).withColumn("row", F.monotonically_increasing_id()))
    groups = max(1, math.ceil(rows.count() / pack))

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("length", "descending"), ("row", "ascending")])
        placed = best_fit(list(zip(part.column("length").to_pylist(), part.column("source").to_pylist(), part.column("cluster").to_pylist())), capacity, per_source)
        group = part.column("grp")[0].as_py()
        return part.drop_columns(["row", "cluster", "grp"]).append_column("bin_id", pa.array([(group << 20) + b for b, _ in placed], pa.int64())).append_column("bin_offset", pa.array([o for _, o in placed], pa.int64()))

    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, source string, piece long, start long, length long, bin_id long, bin_offset long"
    dealt = rows.withColumn("source", F.col("source").cast("string")).filter("length > 0").withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)))
    bins = dealt.groupBy("grp").applyInArrow(run, schema)
    empty = rows.filter("length = 0").select("doc_id", F.col("source").cast("string"), "piece", "start", "length", F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("long").alias("bin_offset"))
    return bins.unionByName(empty)


def op10_packing(spark, sf_dir) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
