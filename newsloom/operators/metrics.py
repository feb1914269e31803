"""Quality funnel by source and the reasons of discarding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled
from .rules import GENERAL, REJECTED

#: Fixed value: the name of a source that is not known.
UNKNOWN_SOURCE = "Origem não identificada"
COUNTERS = ["collected", "classified", "rejected", "below_minimum", "relevant", "preview_only", "publishable", "unseen", "selected"]


def source_name(source: Column, scraper: Column) -> Column:
    return filled(source, scraper, F.lit(UNKNOWN_SOURCE))


def funnel(items: DataFrame, minimum: int = 5) -> DataFrame:
    """One row a source: counters and a map of discard reasons.

    items: source, scraper, category, score, reasons and the flags is_classified, is_relevant, is_preview, is_unseen,
    is_selected. Counters and reasons come from one grouped pass each, both with partial aggregation.
    """
    named = items.withColumn("source", source_name(F.col("source"), F.col("scraper")))
    general, done = F.col("category") == GENERAL, F.coalesce("is_classified", F.lit(True))
    relevant, preview = F.coalesce("is_relevant", F.lit(False)), F.coalesce("is_preview", F.lit(False))
    counts = named.groupBy("source").agg(
        F.count(F.lit(1)).alias("collected"), F.count_if(done).alias("classified"), F.count_if(done & general).alias("rejected"),
        F.count_if(done & ~general & (F.col("score") < minimum)).alias("below_minimum"), F.count_if(relevant).alias("relevant"), F.count_if(relevant & preview).alias("preview_only"),
        F.count_if(relevant & ~preview).alias("publishable"), F.count_if("is_unseen").alias("unseen"), F.count_if("is_selected").alias("selected"),
    )
    reasons = discard_reasons(named).groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("discard_reasons"))
    return counts.join(reasons, "source", "left").withColumn("discard_reasons", F.coalesce("discard_reasons", F.create_map().cast("map<string,bigint>")))


def discard_reasons(items: DataFrame) -> DataFrame:
    """source, reason, n: how often each reason discarded an item of the general category."""
    bad = F.filter("reasons", lambda r: r.startswith(REJECTED.strip()))
    return items.filter(F.col("category") == GENERAL).select("source", F.explode(bad).alias("reason")).groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"))


def joined_lines(rows: DataFrame, order: str, line: str, by: list[str] | None = None, separator: str = "\n") -> DataFrame:
    """Lines of a report in order, as one text a group. For reports only: a group becomes one value."""
    gathered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(line).alias("line"))))
    return rows.groupBy(*(by or [])).agg(F.array_join(F.transform(gathered, lambda x: x["line"]), separator).alias("text"))
