"""Documents to packed training bins: five stages, each written as Parquet and read again before the next.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and, but for the last, returns the columns of
documents. Near-duplicates are told apart by row, never by doc_id alone: one row of every group stays, of the smallest doc_id, a
row without id only where no row of the group has one. Rows that repeat an id or an id and a text are copies of each other only
within a group; different texts under one id all stay.

Null and empty texts pass every stage but the classifier's judgement of them; very long texts are handled whole; ties go to the smaller id,
then to the row's hash. Empty tables: no rows. Columns beyond those of documents pass through, whatever their names; the last stage's
result holds only its own columns.
"""

from __future__ import annotations

from functools import partial, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import small_enough, staged, table, written
from newsloom.llm.mixing import mixed
from newsloom.llm.packing import packed
from newsloom.llm.quality_knn import scored
from newsloom.llm.simhash import near_duplicates
from newsloom.llm.substring import deduplicated

#: Numbers of kept rows that are broadcast at most: some 30 MB.
KEPT = 500_000
#: Near-duplicates: shingles of five words; two independent fingerprints, of which one must agree in all but 6 bits.
NEAR = {"words": 5, "prints": 2, "limit": 6}


OWN = ["doc_id", "text", "lang", "source", "n_chars"]


def with_any_columns(stage):
    """The stage with the names of further columns put aside, so none of them meets a name that an operator uses."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        aside = {c: f"_extra{i}" for i, c in enumerate(docs.columns) if c not in OWN}
        out = stage(spark, docs.select([F.col(f"`{c}`").alias(aside.get(c, c)) for c in docs.columns]), sf_dir)
        back = {a: c for c, a in aside.items()}
        return out.select([F.col(c).alias(back.get(c, c)) for c in out.columns])

    return run


@with_any_columns
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts."""
    return scored(docs, table(spark, sf_dir, "labels")).filter("predicted = 1").select(docs.columns)


@with_any_columns
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of every group of near-duplicates; among equal ids, by the row's hash."""
    # the row number is written once with the texts, so it stays what it was; it decides only between wholly equal rows
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()))
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", F.xxhash64(*docs.columns).alias("hash"), F.col("_row").alias("row"))
    found = near_duplicates(rows.select(key.alias("_key"), "text"), "_key", **NEAR)
    kept = written(found.filter("doc_id.row = component_id.row").select(F.col("doc_id.row").alias("_row")))
    # up to KEPT numbers are broadcast, which saves the texts a shuffle; more are joined by a shuffle
    return rows.join(small_enough(kept, KEPT), "_row", "left_semi").select(docs.columns)


@with_any_columns
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that a smaller id holds; n_chars follows."""
    out = deduplicated(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(docs.columns)


@with_any_columns
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix uses it."""
    out = mixed(docs).filter("copies > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(docs.columns)


@with_any_columns
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in bins."""
    return packed(docs)


STAGES = [("quality classifier", quality), ("near-duplicates", one_of_each), ("substring dedup", passages), ("mixing", mix), ("packing", pack)]
#: Hashes, seeded orders and a trained model: not for SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        # what a stage wrote on the way goes; its result stays for the next
        docs = staged(spark, partial(stage, spark, docs, sf_dir))
    return docs
