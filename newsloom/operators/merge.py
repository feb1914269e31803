"""Bringing sources together: bag union of families, group-merge of repeated publications, health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import whitespace


def union_families(*families: DataFrame) -> DataFrame:
    """All rows of all families by column name; missing columns are null, repeated hits stay."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), families)


def merged(rows: DataFrame, keys: list[str], order: list[str], array: str, clean=whitespace) -> DataFrame:
    """One row a key: the scalar fields of the first row by `order`, and the distinct cleaned texts of `array` in order of appearance.

    Texts are reduced to their first place by partial aggregation before a key gathers them, so a key of very many rows costs what its
    distinct texts cost.
    """
    own = [c for c in rows.columns if c not in {*keys, array, *order}]
    texts = F.array_distinct(F.filter(F.transform(F.coalesce(F.col(array), F.array().cast("array<string>")), clean), lambda x: x != ""))
    at = F.struct(*[F.col(c) for c in order])
    one = rows.groupBy(*keys).agg(F.min_by(F.struct(*own, *order), at).alias("_first"))
    first = rows.select(*keys, at.alias("_at"), F.posexplode(texts).alias("_no", "_text")).groupBy(*keys, "_text").agg(F.min(F.struct("_at", "_no")).alias("_place"))
    gathered = F.transform(F.array_sort(F.collect_list(F.struct("_place", "_text"))), lambda x: x["_text"])
    found = first.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(gathered.alias(array))
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    return one.join(found, same, "left").select(*keys, "_first.*", F.coalesce(array, F.array().cast("array<string>")).alias(array))


def source_health(families: DataFrame, requests: DataFrame) -> DataFrame:
    """Per family: ok, degraded (it answered, but all of its active parts failed) or error, with its item count.

    requests: name, failed (boolean), all_parts_failed (boolean), duration_ms, message.
    """
    counts = families.groupBy(F.col("family").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    status: Column = F.when(F.col("failed"), "error").when(F.coalesce("all_parts_failed", F.lit(False)), "degraded").otherwise("ok")
    return requests.join(counts, "name", "left").select(
        "name", status.alias("status"), F.when(F.col("failed"), F.lit(0)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("item_count"),
        F.when(~F.col("failed"), F.col("duration_ms")).alias("duration_ms"), F.when(F.col("failed"), F.col("message")).alias("message"),
    )


def require_success(health: DataFrame) -> None:
    """Ends the run if no source family answered."""
    if not health.agg(F.bool_or(F.col("status") == "ok")).first()[0]:
        raise RuntimeError("all sources failed; the run does not go on")
