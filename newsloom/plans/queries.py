"""Queries over the shared test tables, one for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, similarity, text, urls
from ..operators import dedupe, merge, metrics, render, select
from ..operators.classify import classified, is_publishable, segments
from ..operators.rules import SYNTHETIC
from ..schema import SEEN
from ..sources import state
from ..sources.digest import changed, file_digests, folder_digests
from ..sources.index import TokenIndex
from ..sources.tables import read, spread, work_folder, written
from . import sql
from .collect import collect
from .run import run, write_artifacts

RUN_AT = datetime(2024, 1, 30, tzinfo=timezone.utc)
CONFIG = {"lookbackHours": 24 * 365, "stateRetentionDays": 365, "minimumScore": 5, "maxPostsPerRun": 25, "maxPostsPerDay": 72}
QUERIES, ORACLES = {}, {}

TITLE_SQL = "string_split(coalesce(text, ''), chr(10))[1]"
ITEMS_SQL = f"""items AS (
  SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'gazette' ELSE 'news' END AS kind, {TITLE_SQL} AS title, text AS summary,
         CASE WHEN doc_id % 3 = 0 THEN string_split(coalesce(text, ''), chr(10)) END AS excerpts,
         'https://' || coalesce(source, 'x') || CASE WHEN doc_id % 5 = 0 THEN '.example.org/' ELSE '.example.com/' END || doc_id AS url, source FROM documents
)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, over all cores also where they lie in one small file."""
    return spread(read(spark, sf_dir, "documents"))


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as items: every third a gazette with its lines as excerpts."""
    docs = texts(spark, sf_dir)
    third, body = F.col("doc_id") % 3 == 0, F.coalesce("text", F.lit(""))
    host = F.when(F.col("doc_id") % 5 == 0, ".example.org/").otherwise(".example.com/")
    return docs.select(
        F.col("doc_id").alias("id"), F.when(third, "gazette").otherwise("news").alias("kind"), F.split(body, "\n")[0].alias("title"), F.col("text").alias("summary"),
        F.when(third, F.split(body, "\n")).alias("excerpts"), F.concat(F.lit("https://"), F.coalesce("source", F.lit("x")), host, F.col("doc_id").cast("string")).alias("url"), "source",
        F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("doc_id") % 2_500_000)).alias("published_at"), F.lit(None).cast("string").alias("scraper"), F.lit(False).alias("preview_only"),
        F.lit(0).alias("family_ord"), F.lit(0).alias("query_ord"), F.col("doc_id").alias("item_ord"),
    )


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


@query("SELECT event_id, ts, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 96 HOUR AND event_type <> ''")
def scan_filter_window(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = events.agg(F.max("ts")).first()[0]
    return events.filter((F.col("ts") >= F.lit(last - timedelta(hours=96)).cast("timestamp_ntz")) & (F.col("event_type") != "")).select("event_id", "ts", "event_type")


@query(f"SELECT doc_id, {sql.whitespace('text')} AS plain FROM documents")
def normalize_ws(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", text.whitespace(F.col("text")).alias("plain"))


@query(f"SELECT doc_id, {sql.for_match('text')} AS folded FROM documents")
def normalize_match(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", text.for_match(F.col("text")).alias("folded"))


@query(f"SELECT doc_id, CASE WHEN length({sql.whitespace('text')}) <= 120 THEN {sql.whitespace('text')} ELSE rtrim(substr({sql.whitespace('text')}, 1, 119)) || '…' END AS short FROM documents")
def truncate_text(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", text.shortened(F.col("text"), 120).alias("short"))


@query(f"SELECT page_id, {sql.canonical('url')} AS canonical FROM pages")
def canonical_url(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical"))


@query(f"SELECT page_id, {sql.canonical('url')} AS canonical FROM pages")
def canonical_url_strict(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.canonical_strict(F.col("url")).alias("canonical"))


@query(f"""SELECT page_id, sha256(coalesce({sql.canonical('url')}, '') || '|' || {sql.for_match("regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1)")}) AS id FROM pages""")
def item_id(spark, sf_dir):
    title = F.regexp_extract(F.coalesce("html", F.lit("")), "<title>([^<]*)</title>", 1)
    return read(spark, sf_dir, "pages").select("page_id", urls.item_id(F.col("url"), title).alias("id"))


@query(f"SELECT page_id, {sql.host('url')} AS host, ends_with({sql.host('url')}, '.example.org') AS official FROM pages")
def official_host(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.is_official(F.col("url"), (".example.org",)).alias("official"))


@query(f"SELECT doc_id, {sql.fingerprint(TITLE_SQL)} AS fingerprint FROM documents")
def title_fingerprint(spark, sf_dir):
    title = F.split(F.coalesce("text", F.lit("")), "\n")[0]
    return texts(spark, sf_dir).select("doc_id", similarity.title_fingerprint(title).alias("fingerprint"))


@query(f"SELECT doc_id, array_to_string({sql.tokens(TITLE_SQL, 'text')}, ' ') AS tokens FROM documents")
def content_tokens(spark, sf_dir):
    title = F.split(F.coalesce("text", F.lit("")), "\n")[0]
    return texts(spark, sf_dir).select("doc_id", F.array_join(similarity.tokens(title, F.col("text")), " ").alias("tokens"))


@query(f"WITH {sql.classify(ITEMS_SQL, SYNTHETIC)} SELECT id, idx AS segment, md5(evidence) AS digest FROM scored")
def evidence_segments(spark, sf_dir):
    parts = segments(F.col("kind"), F.col("excerpts"), F.col("summary"), F.lit(None).cast("string"))
    rows = document_items(spark, sf_dir).select("id", F.posexplode(parts).alias("segment", "evidence"))
    return rows.select("id", F.col("segment").cast("long").alias("segment"), F.md5("evidence").alias("digest"))


@query(f"WITH {sql.classify(ITEMS_SQL, SYNTHETIC)} SELECT id, category, score, evidence_index, array_to_string(reasons, ';') AS reasons FROM best")
def classify_best_segment(spark, sf_dir):
    c = F.col("classification")
    return classified(document_items(spark, sf_dir), SYNTHETIC).select("id", c["category"].alias("category"), c["score"].alias("score"), c["evidence_index"].alias("evidence_index"), F.array_join(c["reasons"], ";").alias("reasons"))


@query(f"WITH {sql.classify(ITEMS_SQL, SYNTHETIC)} SELECT id, category, score FROM best WHERE category <> 'GERAL' AND score >= 5")
def publishable(spark, sf_dir):
    return classified(document_items(spark, sf_dir), SYNTHETIC).filter(is_publishable(5)).select("id", "classification.category", "classification.score")


@query(f"""WITH {sql.classify(ITEMS_SQL, SYNTHETIC)}
SELECT id, score, (row_number() OVER (ORDER BY score DESC, (1704067200 + id % 2500000) DESC, id))::INTEGER AS place FROM best WHERE category <> 'GERAL' AND score >= 5
ORDER BY place LIMIT 50""")
def rank_topk(spark, sf_dir):
    from pyspark.sql import Window

    top = classified(document_items(spark, sf_dir), SYNTHETIC).filter(is_publishable(5)).orderBy(*select.rank_order()).limit(50)
    return top.select("id", "classification.score", F.row_number().over(Window.orderBy(*select.rank_order())).alias("place"))


@query("""SELECT 'documents' AS family, doc_id AS ref, lang, NULL::VARCHAR AS role, length(text) AS n FROM documents UNION ALL
SELECT 'conversations', conv_id, NULL, role, length(text) FROM conversations UNION ALL SELECT 'benchmark', item_id, NULL, NULL, length(text) FROM benchmark""")
def union_sources(spark, sf_dir):
    one = lambda name, key, *more: read(spark, sf_dir, name).select(F.lit(name).alias("family"), F.col(key).alias("ref"), *more, F.length("text").cast("long").alias("n"))
    return merge.union_families(one("documents", "doc_id", "lang"), one("conversations", "conv_id", "role"), one("benchmark", "item_id"))


@query(f"""WITH t AS (SELECT conv_id, turn, role, {sql.whitespace('text')} AS x FROM conversations), f AS (
  SELECT conv_id, x, min(turn) AS spot FROM t WHERE x <> '' GROUP BY conv_id, x)
SELECT c.conv_id, c.first_turn, c.first_role, coalesce(g.texts, '') AS texts FROM (SELECT conv_id, min(turn) AS first_turn, arg_min(role, turn) AS first_role FROM t GROUP BY conv_id) c
LEFT JOIN (SELECT conv_id, string_agg(x, ' | ' ORDER BY spot) AS texts FROM f GROUP BY conv_id) g USING (conv_id)""")
def merge_group_distinct(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.array("text").alias("texts"))
    out = merge.merged(rows, ["conv_id"], ["turn"], "texts")
    return out.select("conv_id", F.col("turn").alias("first_turn"), F.col("role").alias("first_role"), F.array_join("texts", " | ").alias("texts"))


def document_history(items: DataFrame) -> DataFrame:
    """Every seventh item as if sent before."""
    keyed = dedupe.with_keys(items.filter("id % 7 = 1"))
    return keyed.select("id", F.lit(RUN_AT - timedelta(days=2)).alias("sent_at"), "url", "title", "title_fingerprint", "content_tokens", F.lit("GERAL").alias("category"))


@query(f"""WITH {ITEMS_SQL}, p AS (SELECT {sql.fingerprint("title")} AS f FROM items WHERE id % 7 = 1)
SELECT id FROM items WHERE id % 7 <> 1 AND NOT EXISTS (SELECT 1 FROM p WHERE p.f = {sql.fingerprint("items.title")})""")
def anti_history_exact(spark, sf_dir):
    items = document_items(spark, sf_dir).withColumn("doc_id", F.col("id"))
    return dedupe.unsent(dedupe.with_keys(items), document_history(items)).select(F.col("doc_id").alias("id"))


_SETS_SQL = f"""sets AS MATERIALIZED (SELECT id, kind, t, len(t) AS n FROM toks WHERE len(t) > 0),
each AS (SELECT id, kind, n, unnest(t) AS w FROM sets),
common AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM each a JOIN each b
  ON a.w = b.w AND a.kind = b.kind AND a.id < b.id AND a.n >= {similarity.SIMILAR} * b.n AND b.n >= {similarity.SIMILAR} * a.n GROUP BY 1, 2),
near AS MATERIALIZED (SELECT a, b, c / (na + nb - c) AS s, na, nb FROM common WHERE c / (na + nb - c) >= {similarity.SIMILAR}),
pairs AS (SELECT a, b, s, na, nb FROM near UNION ALL SELECT b, a, s, nb, na FROM near)"""
_TOKENS_SQL = f"""toks AS (SELECT id, kind, {sql.tokens("title", "summary")} AS t FROM items), {_SETS_SQL}"""


def _token_sets(spark, sf_dir) -> DataFrame:
    items = document_items(spark, sf_dir)
    return items.select(F.col("id").alias("key"), F.col("kind").alias("category"), similarity.tokens(F.col("title"), F.col("summary")).alias("tokens")).filter(F.size("tokens") > 0)


@query(f"WITH {ITEMS_SQL}, {_TOKENS_SQL}, d AS (SELECT min(id) AS id, kind, t FROM sets GROUP BY kind, t) SELECT a, b, round(s, 9) AS similarity FROM pairs WHERE a < b AND a IN (SELECT id FROM d) AND b IN (SELECT id FROM d)")
def jaccard_pairs(spark, sf_dir):
    """Similar pairs of different token sets; equal sets stand for their smallest id."""
    sets = _token_sets(spark, sf_dir).groupBy("category", "tokens").agg(F.min("key").alias("key"))
    return dedupe.similar_sets(sets).filter("a_key < b_key").select(F.col("a_key").alias("a"), F.col("b_key").alias("b"), F.round("similarity", 9).alias("similarity"))


@query(f"WITH {ITEMS_SQL}, {_TOKENS_SQL} SELECT id FROM items WHERE id % 7 <> 1 AND NOT EXISTS (SELECT 1 FROM pairs WHERE a = items.id AND b % 7 = 1 AND nb >= {similarity.LEAST_TOKENS})")
def anti_history_fuzzy(spark, sf_dir):
    items = document_items(spark, sf_dir).withColumn("content_tokens", similarity.tokens(F.col("title"), F.col("summary"))).withColumn("category", F.col("kind"))
    history = items.filter("id % 7 = 1").select("category", "content_tokens")
    return dedupe.unlike_history(items.filter("id % 7 <> 1"), history).select("id")


@query(f"WITH {ITEMS_SQL}, {_TOKENS_SQL} SELECT id FROM items WHERE id % 7 <> 1 AND NOT EXISTS (SELECT 1 FROM pairs WHERE a = items.id AND b % 7 = 1 AND nb >= {similarity.LEAST_TOKENS})")
def anti_history_indexed(spark, sf_dir):
    """The same through a stored index that follows a history of two commits."""
    folder = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    items = document_items(spark, sf_dir).withColumn("content_tokens", similarity.tokens(F.col("title"), F.col("summary"))).withColumn("category", F.col("kind"))
    log, index = state.history_log(spark, folder), TokenIndex(spark, f"{folder}/index")
    for part in (0, 1):
        sent = items.filter(f"id % 7 = 1 and id % 2 = {part}").withColumns({"id": F.col("id").cast("string"), "sent_at": F.lit(RUN_AT).cast("timestamp"), "title_fingerprint": F.lit("")})
        state.add_to_history(sent.select([f.name for f in SEEN.fields]), folder)
        index.follow(log)
    return index.against(RUN_AT, 365)(items.filter("id % 7 <> 1"), None).select("id")


@query(f"""WITH RECURSIVE {ITEMS_SQL}, {_TOKENS_SQL},
prints AS MATERIALIZED (SELECT id, {sql.fingerprint("title")} AS f FROM items),
clash AS MATERIALIZED (SELECT a, b FROM pairs WHERE b < a AND nb >= {similarity.LEAST_TOKENS} UNION SELECT x.id, y.id FROM prints x JOIN prints y ON x.f = y.f AND y.id < x.id),
lists AS MATERIALIZED (SELECT items.id, list(b) AS rivals FROM items LEFT JOIN clash ON a = items.id GROUP BY items.id),
ranked AS MATERIALIZED (SELECT id, rivals, row_number() OVER (ORDER BY id) AS n FROM lists),
fold(n, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT fold.n + 1, CASE WHEN len(list_intersect(coalesce(rivals, []), kept)) > 0 THEN kept ELSE list_append(kept, id) END FROM fold JOIN ranked ON ranked.n = fold.n + 1)
SELECT unnest(kept) AS id FROM fold WHERE n = (SELECT max(n) FROM ranked)""")
def greedy_dedupe(spark, sf_dir):
    items = document_items(spark, sf_dir).withColumn("doc_id", F.col("id")).withColumn("category", F.col("kind"))
    return dedupe.first_of_each_event(dedupe.with_keys(items), [F.col("doc_id")]).select(F.col("doc_id").alias("id"))


_DAY_SQL = "((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Sao_Paulo')::DATE"


@query(f"SELECT event_id, {_DAY_SQL}::VARCHAR AS local_day, (row_number() OVER (PARTITION BY {_DAY_SQL} ORDER BY value DESC, event_id))::INTEGER AS place FROM events QUALIFY row_number() OVER (PARTITION BY {_DAY_SQL} ORDER BY value DESC, event_id) <= 72")
def daily_quota(spark, sf_dir):
    return select.daily_quota(read(spark, sf_dir, "events"), "ts", [F.desc("value"), "event_id"], 72).select("event_id", F.col("local_day").cast("string").alias("local_day"), "place")


@query(f"SELECT event_id, {_DAY_SQL}::VARCHAR AS local_day, (row_number() OVER (PARTITION BY {_DAY_SQL} ORDER BY value DESC, event_id))::INTEGER AS place FROM events QUALIFY row_number() OVER (PARTITION BY {_DAY_SQL} ORDER BY value DESC, event_id) <= 72")
def stream_daily_quota(spark, sf_dir):
    """The same over the events as a stream of three batches, started anew for each."""
    from ..streaming.quota import best_of_days, days_of

    folder = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    rows = read(spark, sf_dir, "events").select("event_id", "ts", "value")
    for k in range(3):
        rows.filter(F.col("event_id") % 3 == k).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        best_of_days(stream, f"{folder}/days", f"{folder}/check", "ts", [F.desc("value"), "event_id"], 72).awaitTermination()
    return days_of(spark, f"{folder}/days", rows.schema).load().select("event_id", F.col("local_day").cast("string").alias("local_day"), "place")


@query(f"SELECT {_DAY_SQL}::VARCHAR AS local_day, count(*) AS sent FROM events GROUP BY 1")
def sent_by_day(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(dates.local_day(F.col("ts")).cast("string").alias("local_day")).agg(F.count(F.lit(1)).alias("sent"))


@query(f"SELECT least(3, greatest(0, 72 - count(*)))::INTEGER AS allowed, count(*) AS sent FROM events WHERE {_DAY_SQL} = DATE '2024-01-29'")
def remaining_quota(spark, sf_dir):
    history = read(spark, sf_dir, "events").select(F.col("ts").alias("sent_at"))
    sent = select.sent_on_day(history, datetime(2024, 1, 29, 15, tzinfo=timezone.utc))
    return spark.createDataFrame([(select.allowed(3, 72, sent), sent)], "allowed int, sent long")


@query("SELECT event_id FROM events WHERE NOT coalesce(CASE WHEN event_id % 11 <> 0 THEN ts END < TIMESTAMP '2024-01-15', false)")
def prune_state(spark, sf_dir):
    """Old records go; those without a date (every eleventh) stay."""
    rows = read(spark, sf_dir, "events").withColumn("sent_at", F.when(F.col("event_id") % 11 != 0, F.col("ts")))
    return state.pruned(rows, datetime(2024, 1, 30, tzinfo=timezone.utc), 15).select("event_id")


@query("""WITH h AS (SELECT DISTINCT ON (user_id) user_id, ts, event_type FROM events WHERE event_id % 2 = 0 ORDER BY user_id, ts DESC, event_id), n AS (
  SELECT DISTINCT ON (user_id) user_id, ts, event_type FROM events WHERE event_id % 2 = 1 AND user_id % 3 = 0 ORDER BY user_id, ts DESC, event_id)
SELECT user_id::VARCHAR AS id, ts AS sent_at FROM n UNION ALL SELECT user_id::VARCHAR, ts FROM h WHERE user_id NOT IN (SELECT user_id FROM n)""")
def upsert_history(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    record = lambda df: df.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", -F.col("event_id"))).alias("title"), F.max("ts").alias("sent_at")).select(F.col("user_id").cast("string").alias("id"), "sent_at", F.lit("").alias("url"), "title")
    return state.upserted(record(rows.filter("event_id % 2 = 0")), record(rows.filter("event_id % 2 = 1 and user_id % 3 = 0"))).select("id", "sent_at")


@query("""WITH batches AS (SELECT user_id, event_id % 4 AS k, max(ts) AS at_ts FROM events GROUP BY 1, 2)
SELECT user_id::VARCHAR AS id, arg_max(at_ts, k) AS sent_at FROM batches GROUP BY user_id""")
def history_commits(spark, sf_dir):
    """Four batches of records, of which the last is committed twice, through the log of the history: the last batch of a user counts."""
    folder = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    rows = read(spark, sf_dir, "events")
    for k in (0, 1, 2, 3, 3):
        batch = rows.filter(F.col("event_id") % 4 == k).groupBy(F.col("user_id").cast("string").alias("id")).agg(F.max("ts").alias("sent_at"))
        state.add_to_history(batch.withColumns({f.name: F.lit(None).cast(f.dataType) for f in SEEN.fields if f.name not in ("id", "sent_at")}), folder)
    return state.load_history(spark, folder).select("id", F.col("sent_at").cast("timestamp_ntz").alias("sent_at"))


_FUNNEL_SQL = f"WITH {sql.classify(ITEMS_SQL, SYNTHETIC)}, named AS (SELECT coalesce(nullif(source, ''), '{metrics.UNKNOWN_SOURCE}') AS source, best.*, items.id % 4 = 0 AS preview FROM best JOIN items USING (id))"


def _flagged(spark, sf_dir) -> DataFrame:
    rows = classified(document_items(spark, sf_dir), SYNTHETIC)
    relevant = is_publishable(5)
    return rows.select("source", "scraper", "classification.category", "classification.score", "classification.reasons", relevant.alias("is_relevant"), (F.col("id") % 4 == 0).alias("is_preview"), F.lit(True).alias("is_classified"), (relevant & (F.col("id") % 10 == 1)).alias("is_unseen"), (relevant & (F.col("id") % 10 == 1)).alias("is_selected"))


@query(f"""{_FUNNEL_SQL} SELECT source, count(*) AS collected, count(*) AS classified, count(*) FILTER (category = 'GERAL') AS rejected, count(*) FILTER (category <> 'GERAL' AND score < 5) AS below_minimum,
count(*) FILTER (category <> 'GERAL' AND score >= 5) AS relevant, count(*) FILTER (category <> 'GERAL' AND score >= 5 AND preview) AS preview_only, count(*) FILTER (category <> 'GERAL' AND score >= 5 AND NOT preview) AS publishable,
count(*) FILTER (category <> 'GERAL' AND score >= 5 AND id % 10 = 1) AS unseen, count(*) FILTER (category <> 'GERAL' AND score >= 5 AND id % 10 = 1) AS selected FROM named GROUP BY source""")
def source_funnel(spark, sf_dir):
    return metrics.funnel(_flagged(spark, sf_dir)).select("source", *metrics.COUNTERS)


@query(f"""{_FUNNEL_SQL} SELECT source, reason, count(*) AS n FROM (SELECT source, unnest(reasons) AS reason FROM named WHERE category = 'GERAL') WHERE starts_with(reason, 'rejeitado:') GROUP BY 1, 2""")
def discard_reasons(spark, sf_dir):
    rows = _flagged(spark, sf_dir).withColumn("source", metrics.source_name(F.col("source"), F.col("scraper")))
    return metrics.discard_reasons(rows)


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.v') AS v FROM events")
def embedded_json(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.v").alias("v"))


_MONTHS_SQL = "[" + ", ".join(sql.quoted(m) for m in dates.MONTHS) + "]"


@query(f"SELECT event_id, strftime({_DAY_SQL}, '%d') || ' ' || {_MONTHS_SQL}[month({_DAY_SQL})] || ' ' || year({_DAY_SQL}) AS spelled FROM events")
def spelled_date(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", dates.spelled(F.col("ts")).alias("spelled"))


@query("SELECT event_id, make_timestamp(year(ts), month(ts), day(ts), 15, 0, 0) AS at FROM events")
def day_first_date(spark, sf_dir):
    shown = F.concat(F.lit("em "), F.date_format("ts", "d/M/yyyy"), F.lit(" às "), F.date_format("ts", "HH:mm"))
    return read(spark, sf_dir, "events").select("event_id", dates.day_first(shown).cast("timestamp_ntz").alias("at"))


@query("SELECT event_id, date_trunc('second', ts) AS at FROM events")
def feed_date(spark, sf_dir):
    shown = F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss 'GMT'")
    return read(spark, sf_dir, "events").select("event_id", dates.instant(shown).cast("timestamp_ntz").alias("at"))


_PLAIN_SQL = sql.whitespace("text")


@query(f"""WITH p AS (SELECT doc_id, {_PLAIN_SQL} AS plain, {sql.whitespace(TITLE_SQL)} AS title FROM documents), f AS (SELECT *, trim(regexp_extract(plain, '([^.!?]+[.!?]+)', 1)) AS first FROM p)
SELECT doc_id, CASE WHEN first <> '' AND length(first) <= 280 THEN first WHEN regexp_matches(title, '[.!?]$') THEN title ELSE title || '.' END AS sentence FROM f""")
def first_sentence(spark, sf_dir):
    title = F.split(F.coalesce("text", F.lit("")), "\n")[0]
    return texts(spark, sf_dir).select("doc_id", render.first_sentence(F.col("text"), title).alias("sentence"))


_RADAR_SQL = f"""WITH RECURSIVE {sql.classify(ITEMS_SQL, SYNTHETIC)},
known AS MATERIALIZED (SELECT {sql.fingerprint("title")} AS f FROM items WHERE id % 7 = 1),
fresh AS MATERIALIZED (SELECT items.id, title, url, summary, best.category, best.score, {sql.fingerprint("title")} AS f, 1704067200 + items.id % 2500000 AS published FROM items JOIN best ON best.id = items.id
  WHERE best.category <> 'GERAL' AND best.score >= 5 AND (items.kind = 'gazette' OR (title <> '' AND url <> ''))),
open_items AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, published DESC, id) AS place FROM fresh WHERE f NOT IN (SELECT f FROM known)),
toks AS (SELECT id, category AS kind, {sql.tokens("title", "summary")} AS t FROM open_items), {_SETS_SQL},
clash AS MATERIALIZED (SELECT a, b FROM pairs JOIN open_items x ON x.id = a JOIN open_items y ON y.id = b WHERE y.place < x.place AND nb >= {similarity.LEAST_TOKENS} UNION SELECT x.id, y.id FROM open_items x JOIN open_items y ON x.f = y.f AND y.place < x.place),
lists AS MATERIALIZED (SELECT place, id, list(b) AS rivals FROM open_items LEFT JOIN clash ON a = id GROUP BY place, id),
fold(n, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT fold.n + 1, CASE WHEN len(list_intersect(coalesce(rivals, []), kept)) > 0 THEN kept ELSE list_append(kept, id) END FROM fold JOIN lists ON lists.place = fold.n + 1 WHERE len(kept) < {CONFIG["maxPostsPerRun"]}),
chosen AS (SELECT unnest(kept) AS id FROM fold WHERE n = (SELECT max(n) FROM fold))
SELECT id AS item_ord, title, url, published, category, score FROM open_items WHERE id IN (SELECT id FROM chosen)"""


@query(_RADAR_SQL)
def radar_run(spark, sf_dir):
    """The whole batch plan over all documents: classify, filter, rank, drop sent and repeated items, cap."""
    items = document_items(spark, sf_dir)
    history = document_history(items).select([f.name for f in SEEN.fields])
    result = run(items.withColumn("raw_text", F.lit("")), history, RUN_AT, CONFIG, SYNTHETIC)
    c = F.col("classification")
    return result.selected.select("item_ord", "title", "url", F.unix_timestamp("published_at").alias("published"), c["category"].alias("category"), c["score"].alias("score"))


@query(_RADAR_SQL)
def stream_radar(spark, sf_dir):
    """The same as a micro-batch of a stream: history behind its commit log, stored index, sink."""
    from ..streaming.microbatch import start

    folder = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    items = document_items(spark, sf_dir).withColumn("raw_text", F.lit(""))
    items.write.parquet(f"{folder}/in")
    state.save_history(document_history(items).withColumn("id", F.col("id").cast("string")).select([f.name for f in SEEN.fields]), f"{folder}/state")
    stream = spark.readStream.schema(items.schema).parquet(f"{folder}/in")
    start(stream, f"{folder}/state", f"{folder}/check", CONFIG, lambda: RUN_AT, SYNTHETIC, sink=f"{folder}/sent", indexed=True).awaitTermination()
    c = F.col("classification")
    return spark.read.parquet(f"{folder}/sent").select("item_ord", "title", "url", F.unix_timestamp("published_at").alias("published"), c["category"].alias("category"), c["score"].alias("score"))


@query(f"""WITH {sql.classify(ITEMS_SQL, SYNTHETIC)} SELECT items.url, items.source, best.category, best.score, array_to_string(best.reasons, ';') AS reasons
FROM items JOIN best ON best.id = items.id WHERE items.kind = 'gazette' OR (title <> '' AND url <> '')""")
def classification_audit(spark, sf_dir):
    """The audit artifact of a run, written and read back."""
    folder = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    items = document_items(spark, sf_dir).withColumn("raw_text", F.lit(""))
    write_artifacts(run(items, spark.createDataFrame([], SEEN), RUN_AT, CONFIG, SYNTHETIC), folder, CONFIG["minimumScore"])
    c = F.col("classification")
    return spark.read.parquet(f"{folder}/classification-audit").select("url", "source", c["category"].alias("category"), c["score"].alias("score"), F.array_join(c["reasons"], ";").alias("reasons"))


_FEED_SQL = "WITH feeds AS (SELECT coalesce(source, 'none') AS source, doc_id FROM documents WHERE doc_id IS NOT NULL)"


def _collected(spark, sf_dir):
    """Feeds of the documents, one file a source, collected by settings that also name a feed that is gone and a family that fails."""
    folder = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    day = f"{RUN_AT - timedelta(hours=5):%a, %d %b %Y %H:%M:%S} GMT"
    entry = F.concat(F.lit("<item><title>Document "), "doc_id", F.lit("</title><link>https://a.example/"), "doc_id", F.lit(f"</link><pubDate>{day}</pubDate><description>of "), "source", F.lit("</description></item>"))
    rows = read(spark, sf_dir, "documents").filter("doc_id is not null").select(F.coalesce("source", F.lit("none")).alias("source"), "doc_id").withColumn("value", entry)
    # a feed is one file, so one task writes it: its lines come in the order of their ids
    rows = rows.repartition("source").sortWithinPartitions("source", "doc_id").withColumn("name", F.col("source")).select("name", "value")
    rows.write.partitionBy("name").text(f"{folder}/entries")
    whole = spark.read.text(f"{folder}/entries", wholetext=True).select("name", F.concat(F.lit("<rss><channel>"), "value", F.lit("</channel></rss>")).alias("value"))
    whole.repartition("name").write.partitionBy("name").text(f"{folder}/feeds")
    paths = spark.read.text(f"{folder}/feeds").inputFiles()  # one a source
    feeds = sorted(({"name": p.rpartition("name=")[2].partition("/")[0], "url": p.replace("file:///", "file:/").replace("file:/", "file:///")} for p in paths), key=lambda f: f["name"])
    config = CONFIG | {"rssFeeds": {"enabled": True, "retries": 0, "feeds": [*feeds, {"name": "gone", "url": f"{folder}/gone.xml"}]}, "queridoDiario": {"enabled": True, "retries": 0, "queryTerms": ["a"]}}
    return collect(spark, config, RUN_AT, gazette="file:///nowhere")


@query(f"{_FEED_SQL} SELECT source, 'Document ' || doc_id AS title, 'https://a.example/' || doc_id AS url, 'of ' || source AS summary FROM feeds")
def collected_items(spark, sf_dir):
    return _collected(spark, sf_dir).items.select("source", "title", "url", "summary")


@query(f"""{_FEED_SQL} SELECT 'Feeds RSS' AS name, 'ok' AS status, count(*) AS item_count FROM feeds UNION ALL SELECT 'Querido Diário', 'error', 0 UNION ALL SELECT 'Google News', 'ok', 0 UNION ALL SELECT 'Scrapers web', 'ok', 0""")
def source_health(spark, sf_dir):
    return _collected(spark, sf_dir).health.select("name", "status", "item_count")


@query("""WITH t AS (SELECT source, text LIKE '%!%' AS hit FROM documents WHERE source IS NOT NULL AND text IS NOT NULL)
SELECT source AS path, CASE WHEN bool_or(hit) THEN 'changed' ELSE 'same' END AS change FROM t GROUP BY source""")
def changed_folders(spark, sf_dir):
    """Folders of the documents' texts by source, written twice, the second time without exclamation marks: whose digests differ?"""
    folder = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    rows = read(spark, sf_dir, "documents").filter("source is not null and text is not null").select("source", "doc_id", "text")
    found = []
    for name, value in (("before", F.col("text")), ("after", F.replace("text", F.lit("!"), F.lit("")))):
        lines = rows.repartition("source").sortWithinPartitions("source", "doc_id", "text").select(F.concat("source", F.lit("")).alias("path"), F.sha2(value, 256).alias("value"))
        lines.write.partitionBy("path").text(f"{folder}/{name}")
        found.append(folder_digests(file_digests(spark, f"{folder}/{name}"), names=False).filter("path <> ''").withColumn("path", F.replace("path", F.lit("path="), F.lit(""))))
    return changed(*found)


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def stream_dedupe_count(spark, sf_dir):
    """The events as a stream, each id once within the watermark, counted by type; one availableNow run."""
    from ..streaming.microbatch import without_repeats

    name = f"counts_{uuid.uuid4().hex}"
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_as_folder(spark, path))
    seen = without_repeats(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_id"], 24 * 60)
    out = f"{work_folder(spark)}/{name}"
    seen.select("event_id", "event_type").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, event_type string").parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, event_type, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 3, ts, event_id) = 1""")
def stream_first_seen(spark, sf_dir):
    """The events in three micro-batches, the stream started anew for each: of each user and type the first passes."""
    from ..streaming.seen import first_of_key

    folder = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", F.concat_ws("-", "user_id", "event_type").alias("key"))
    for k in range(3):
        rows.filter(F.col("event_id") % 3 == k).write.mode("append").parquet(f"{folder}/in")
        stream = first_of_key(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), "key", "ts", [F.col("ts"), F.col("event_id")], 3650)
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out").select("user_id", "event_type", "event_id")


def _as_folder(spark, path: str) -> str:
    """Streams read folders: a single file is copied as a written table."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return path
    return written(spark.read.parquet(path)).inputFiles()[0].rpartition("/")[0]

