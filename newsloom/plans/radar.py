"""The radar from its settings to a saved history: collect, run, write artifacts, report, and send if that is switched on.

Preview (sendEnabled is off): artifacts and reports only, no message and no state. Sending: the destination is checked before anything is sent;
what was sent is in the outbox after each message and in the history at the end.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import render
from ..operators.dedupe import with_keys
from ..operators.rules import CONSORTIA, RuleSet
from ..operators.select import rank_order
from ..sources.state import delivered, load_history, outbox, require_destination, settle, with_outbox
from .collect import collect
from .run import Run, append_summary, run, write_artifacts


def radar(
    spark: SparkSession, settings: dict, folder: str, run_at: datetime, send: Callable[[str], None] | None = None, group: str | None = None, summary: str | None = None, rules: RuleSet = CONSORTIA, **services: str
) -> Run:
    """One run over the sources that the settings name. folder: holds `state` and `artifacts`; summary: a file of the driver that reports are appended to."""
    sending = bool(settings.get("sendEnabled"))
    if sending:
        require_destination(group)
        if send is None:
            raise ValueError("sending is switched on, but nothing sends")
    state = f"{folder}/state"
    collected = collect(spark, settings, run_at, **services)
    result = run(collected.items, with_outbox(load_history(spark, state), state), run_at, settings, rules)
    write_artifacts(result, f"{folder}/artifacts", settings["minimumScore"], collected.health, collected.diagnostics)
    chosen = result.selected if "id" in result.selected.columns else with_keys(result.selected)
    order, reported = F.struct(*rank_order()), chosen
    if sending:
        ids = []
        try:
            delivered(render.messages(chosen, "text").withColumn("_place", order), "_place", send, state, run_at, result.history, (settings.get("messageDelayMs") or 0) / 1000)
        finally:
            # also after an error: what was sent is known and stays known
            sent = outbox(spark, state)
            if sent is not None:  # the quota of a run bounds them
                ids = [r["id"] for r in sent.filter(F.col("sent_at") == F.lit(run_at).cast("timestamp")).select("id").collect()]
            settle(spark, state, run_at, settings["stateRetentionDays"])
        reported = chosen.filter(F.col("id").isin(ids)) if ids else chosen.limit(0)
    observed = result.classified.filter("scraper <> ''").count()
    append_summary(
        summary, render.run_summary(reported.withColumn("n", order), "n", sending), render.preview_summary(result.previews.withColumn("n", order), "n", observed, collected.diagnostics),
        render.funnel_table(result.funnel, settings["minimumScore"]),
    )
    return result
