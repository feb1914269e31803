"""A whole run: items to classified, ranked, de-duplicated and capped selections, with funnel and artifacts."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import render
from ..operators.classify import classified, is_publishable
from ..operators.dedupe import first_unseen, unlike_history
from ..operators.metrics import funnel
from ..operators.rules import CONSORTIA, RuleSet
from ..operators.select import allowed, rank_order, recent, sent_on_day
from ..schema import ITEM, ORDINALS
from ..sources.index import TokenIndex
from ..sources.state import pruned
from ..sources.tables import scratch, written

PREVIEWS = 50


@dataclass
class Run:
    """The frames of a run; classified and selections are written tables."""

    classified: DataFrame
    relevant: DataFrame
    selected: DataFrame
    previews: DataFrame
    funnel: DataFrame
    history: DataFrame
    sent_today: int


def as_items(df: DataFrame) -> DataFrame:
    """df with all columns of an item, missing ones null, missing ordinals 0."""
    have = set(df.columns)
    missing = {f.name: F.lit(0 if f.name in ORDINALS else None).cast(f.dataType) for f in ITEM.fields if f.name not in have}
    return df.withColumns(missing)


def run(items: DataFrame, history: DataFrame, run_at: datetime, config: dict, rules: RuleSet = CONSORTIA, index: TokenIndex | None = None) -> Run:
    """config: lookbackHours, stateRetentionDays, minimumScore, maxPostsPerRun, maxPostsPerDay. Gazettes pass the window by day at
    their source, all others here. index: of the token sets of the history; without it they are compared anew."""
    with scratch() as keep:
        items = as_items(items)
        window = recent(items.filter("kind <> 'gazette' or kind is null"), run_at, config["lookbackHours"]).unionByName(items.filter("kind = 'gazette'"))
        # read several times below; written once, whatever it was made from
        history = keep(written(pruned(history, run_at, config["stateRetentionDays"])))
        done = keep(written(classified(window, rules)))
        relevant = done.filter(is_publishable(config["minimumScore"]))
        preview = F.coalesce("preview_only", F.lit(False))
        order = rank_order()
        sent = sent_on_day(history, run_at)
        unlike = index.against(run_at, config["stateRetentionDays"]) if index else unlike_history
        most = allowed(config["maxPostsPerRun"], config["maxPostsPerDay"], sent)
        selected = keep(written(first_unseen(relevant.filter(~preview), history, order, most, unlike=unlike)))
        previews = keep(written(first_unseen(relevant.filter(preview), history, order, PREVIEWS, unlike=unlike)))
        # the selection is few rows: its quota bounds it
        chosen = F.broadcast(selected.select(*ORDINALS, "url", "title", F.lit(True).alias("_chosen")).distinct())
        flagged = done.join(chosen, [done[c].eqNullSafe(chosen[c]) for c in (*ORDINALS, "url", "title")], "left")
        flags = flagged.select(
            done["source"], done["scraper"], F.col("classification.category").alias("category"), F.col("classification.score").alias("score"), F.col("classification.reasons").alias("reasons"),
            is_publishable(config["minimumScore"]).alias("is_relevant"), preview.alias("is_preview"), F.coalesce("_chosen", F.lit(False)).alias("is_unseen"), F.coalesce("_chosen", F.lit(False)).alias("is_selected"),
            F.lit(True).alias("is_classified"),
        )
        return Run(done, relevant, selected, previews, funnel(flags, config["minimumScore"]), history, sent)


def write_artifacts(result: Run, folder: str, minimum: int = 5, health: DataFrame | None = None, diagnostics: DataFrame | None = None) -> None:
    """The audit artifacts of a run: candidates, observations, previews, messages, funnel, classification audit and, of a collection, the health
    of its source families and sites."""
    order = F.row_number().over(_by_rank())
    result.selected.write.mode("overwrite").json(f"{folder}/candidates")
    result.previews.write.mode("overwrite").json(f"{folder}/preview-candidates")
    result.classified.filter("scraper <> ''").drop("classification").write.mode("overwrite").json(f"{folder}/observations")
    for name, rows in (("messages", result.selected), ("preview-messages", result.previews)):
        render.messages(rows, "value").select("value", order.alias("place")).orderBy("place").select(F.concat("value", F.lit("\n\n──────────\n"))).coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")
    result.funnel.write.mode("overwrite").json(f"{folder}/source-funnel")
    render.funnel_table(result.funnel, minimum).write.mode("overwrite").text(f"{folder}/source-funnel-table")
    for name, rows in (("source-health", health), ("scraper-health", diagnostics)):
        if rows is not None:
            rows.drop("part", "place").coalesce(1).write.mode("overwrite").json(f"{folder}/{name}")
    result.classified.select("title", "url", "source", "source_url", "kind", "preview_only", "classification").write.mode("overwrite").parquet(f"{folder}/classification-audit")


def _by_rank():
    from pyspark.sql import Window

    return Window.orderBy(*rank_order())


def append_summary(path: str | None, *reports: DataFrame) -> None:
    """Append the text of one-row reports to a file of the driver; nothing where no path is set."""
    if path:
        with open(path, "a", encoding="utf-8") as f:
            f.write("\n".join(r.first()["text"] for r in reports))
