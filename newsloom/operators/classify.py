"""Classification of items by a rule set: every segment of evidence is scored, the best one decides.

All of it is one array expression a row: no explode, no shuffle, no Python. Each step binds its results in a struct, so the
text of a segment is normalised once and each pattern is matched once.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled, for_match, whitespace
from ..functions.urls import is_official
from ..sources.tables import spread
from .rules import CONSORTIA, GENERAL, GENERAL_MARK, REJECTED, RuleSet, quick, required

GAZETTE, GAZETTE_LIMIT, LIMIT = "gazette", 1200, 1800
NO_TEXT = f"{REJECTED}sem texto para classificação"
STRONG_REASON = "contexto público forte"
NO_CONTEXT = "sem contexto público"


def segments(kind: Column, excerpts: Column, summary: Column, raw_text: Column) -> Column:
    """The non-empty texts that are scored: the excerpts, else the summary, else the raw text, each cut to its limit."""
    texts = F.when(F.size(excerpts) > 0, excerpts).otherwise(F.array(filled(summary, raw_text)))
    most = F.when(kind.eqNullSafe(GAZETTE), GAZETTE_LIMIT).otherwise(LIMIT)
    return F.filter(F.transform(texts, lambda s: F.substring(whitespace(s), F.lit(1), most)), lambda s: s != "")


def _found(pattern: str, text: Column) -> Column:
    """Does the pattern match? A text without the words that it needs is not searched by it."""
    held = [reduce(or_, [text.contains(w) for w in words]) for words in required(pattern)]
    return reduce(and_, [*held, text.rlike(quick(pattern))])


def _matched(rules: RuleSet, text: Column) -> Column:
    """What a segment's text holds: each pattern is tried once."""
    case = lambda require, forbid: _found(require, text) & ~_found(forbid, text) if forbid else _found(require, text)
    any_of = lambda cases: F.array_max(F.array(*[case(*c) for c in cases]))
    return F.struct(
        _found(rules.subject, text).alias("subject"),
        _found(rules.strong, text).alias("strong"),
        _found(rules.local, text).alias("local"),
        F.array(*[sum((_found(p, text).cast("int") for p in r.patterns), F.lit(0)) for r in rules.rules]).alias("hits"),
        (F.array(*[any_of(p.cases) for p in rules.penalties]) if rules.penalties else F.array().cast("array<boolean>")).alias("lost"),
    )


def _judged(rules: RuleSet, m: Column, at: Column, evidence: Column, extra: Column) -> Column:
    """Score and category of a segment from what it holds; `extra` are the points of title and address."""
    public = m["strong"] | (m["subject"] & m["local"])
    points = m["subject"].cast("int") + public.cast("int") + 2 * m["strong"].cast("int") + extra
    reasons = [F.when(m["strong"], F.lit(STRONG_REASON))]
    for i, r in enumerate(rules.rules):
        n = m["hits"][i]
        points = points + F.when((n > 0) & public, r.weight + F.least(n - 1, F.lit(2))).otherwise(0)
        reasons.append(F.when(n > 0, F.when(public, F.lit(r.category)).otherwise(F.lit(f"{REJECTED}{r.category} {NO_CONTEXT}"))))
    for i, p in enumerate(rules.penalties):
        points = points - F.when(m["lost"][i], p.points).otherwise(0)
        reasons.append(F.when(m["lost"][i], F.lit(REJECTED + p.reason)))
    listed = F.filter(F.array(*reasons), lambda x: x.isNotNull())
    bad = F.exists(listed, lambda x: x.startswith(REJECTED.strip()))
    category, mark = F.lit(GENERAL), F.lit(GENERAL_MARK)
    for i, r in sorted(enumerate(rules.rules), key=lambda x: (x[1].priority, x[1].weight)):
        category, mark = F.when(m["hits"][i] > 0, r.category).otherwise(category), F.when(m["hits"][i] > 0, r.mark).otherwise(mark)
    plain = bad | ~public
    # ordered by score, then by the earlier segment
    return F.struct(
        points.cast("int").alias("score"), (-at).alias("order"),
        F.when(plain, GENERAL).otherwise(category).alias("category"), F.when(plain, GENERAL_MARK).otherwise(mark).alias("emoji"), listed.alias("reasons"),
        at.cast("int").alias("evidence_index"), evidence.alias("evidence_text"), public.alias("public_context"), m["strong"].alias("strong_public_context"),
    )


def classification(rules: RuleSet = CONSORTIA, kind="kind", title="title", summary="summary", raw_text="raw_text", excerpts="excerpts", url="url", source_url="source_url") -> Column:
    """Classification struct of a row of items."""
    kind, title, summary, raw_text, excerpts, url, source_url = (F.col(c) for c in (kind, title, summary, raw_text, excerpts, url, source_url))
    official = ~kind.eqNullSafe(GAZETTE) & is_official(filled(source_url, url), rules.official)
    extra = _found(rules.subject, for_match(title)).cast("int") + official.cast("int")
    row = F.array(F.struct(extra.alias("extra"), segments(kind, excerpts, summary, raw_text).alias("parts"), F.coalesce(title, F.lit("")).alias("title")))

    def of_row(r: Column) -> Column:
        texts = F.transform(r["parts"], lambda s: F.struct(s.alias("evidence"), for_match(F.concat_ws(" ", r["title"], s)).alias("text")))
        held = F.transform(texts, lambda x: F.struct(x["evidence"].alias("evidence"), _matched(rules, x["text"]).alias("m")))
        return F.array_max(F.transform(held, lambda x, i: _judged(rules, x["m"], i, x["evidence"], r["extra"])))

    best = F.transform(row, of_row)[0]
    names = ["category", "emoji", "score", "reasons", "evidence_index", "evidence_text", "public_context", "strong_public_context"]
    none = [F.lit(GENERAL), F.lit(GENERAL_MARK), F.lit(0), F.array(F.lit(NO_TEXT)), F.lit(-1), F.lit(""), F.lit(False), F.lit(False)]
    return F.transform(F.array(best), lambda b: F.struct(*[F.when(b.isNull(), n).otherwise(b[c]).alias(c) for c, n in zip(names, none)]))[0]


def classified(items: DataFrame, rules: RuleSet = CONSORTIA) -> DataFrame:
    """items with their classification."""
    have = set(items.columns)
    for c, kind in (("kind", "string"), ("raw_text", "string"), ("excerpts", "array<string>"), ("source_url", "string"), ("url", "string"), ("summary", "string")):
        if c not in have:
            items = items.withColumn(c, F.lit(None).cast(kind))
    # a one-row generator, not a projection: filters on its result would otherwise be pushed below and work it out again
    rest = [c for c in items.columns if c != "classification"]
    return spread(items).select(*rest, F.explode(F.array(classification(rules))).alias("classification"))


def is_publishable(minimum: int = 5) -> Column:
    return (F.col("classification.category") != GENERAL) & (F.col("classification.score") >= minimum)
