"""Digests of folders: one a file, combined folder by folder from the deepest up, so equal digests mean equal trees and unchanged parts can be skipped.

Files are read where they lie, one binary scan; only names and digests are shuffled, grouped by folder. A folder's digest is the SHA-256 of its
entries in the order of their names, each as kind, name and digest. With names=False it is that of the sorted digests of its entries, so it does not
depend on the names that a writer gives to files. Names that begin with "_" or "." are left out, and so are files without a byte, as Spark's readers do. A file is read whole by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import scratch, written


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """path (relative), bytes, digest of every file below a folder."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    base = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    bare = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    path = F.substring(bare(F.col("path")), len(base.replace("file:///", "file:/")) + 1, 1 << 30)
    return files.select(path.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest")).filter(~F.col("path").rlike(r"(^|/)[_.][^/]*$"))


def folder_digests(files: DataFrame, names: bool = True) -> DataFrame:
    """path, files, bytes, digest of every folder that holds files (path "" for the top). files: path, bytes, digest.

    A folder's entries are one group: names and digests only.
    """
    with scratch() as keep:
        parts = F.split("path", "/")
        entries = written(files.select(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("folder"), F.element_at(parts, -1).alias("name"), F.lit("file").alias("kind"), F.lit(1).cast("long").alias("files"), "bytes", "digest", (F.size(parts) - 1).alias("depth")))
        deepest, out = entries.agg(F.max("depth")).first()[0] or 0, []
        above = entries.limit(0)
        for depth in range(deepest, -1, -1):
            own = entries.filter(F.col("depth") == depth).unionByName(above)
            line = F.struct("name", F.concat_ws(" ", "kind", "name", "digest").alias("line")) if names else F.struct(F.col("digest").alias("name"), F.col("digest").alias("line"))
            lines = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n")
            made = keep(written(own.groupBy("folder").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.sha2(lines, 256).alias("digest"))))
            out.append(made.select(F.col("folder").alias("path"), "files", "bytes", "digest"))
            parts = F.split("folder", "/")
            above = made.filter(F.lit(depth > 0)).select(
                F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("folder"), F.element_at(parts, -1).alias("name"), F.lit("folder").alias("kind"), "files", "bytes", "digest", F.lit(depth - 1).alias("depth")
            )
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change (added, removed, changed or same) of folders or files of two digests tables."""
    a, b = before.select("path", F.col("digest").alias("_a")), after.select("path", F.col("digest").alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed").otherwise("same")
    return a.join(b, "path", "full").select("path", change.alias("change"))
