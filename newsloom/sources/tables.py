"""Written intermediate tables and checked broadcasts."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Of each thread, the paths of tables written inside each scratch() that is open.
_OPEN = threading.local()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables; timestamps without zone are read as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def work_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, the warehouse, or a temporary folder on a local master."""
    said = spark.conf.get("spark.checkpoint.dir", None)
    if said:
        return said.rstrip("/")
    if spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local["):
        return f"file://{tempfile.gettempdir()}/radar-{spark.sparkContext.applicationId}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/radar-work"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared work folder, read again: its lineage ends here."""
    path = f"{work_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if getattr(_OPEN, "made", None):
        _OPEN.made[-1].append(path)
        out.work_path = path
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that written() makes inside are deleted in the end, but those given to the function that this yields, which pass to an enclosing scratch()."""
    _OPEN.made = [*getattr(_OPEN, "made", []), []]
    kept, spark = [], SparkSession.active()

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.work_path)
        return df

    try:
        yield keep
    finally:
        *outer, own = _OPEN.made
        _OPEN.made = outer
        if outer:
            outer[-1].extend(kept)
        for path in set(own) - set(kept):
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_enough(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Marked for broadcast if it has at most `rows` rows, else for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it comes in fewer partitions (a small file that cannot be split) and costly work follows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
