"""Queries over Portuguese items and source payloads that are built from the customers and orders of the test tables, with SQL that gives the same rows.

Items: one a customer, its text a template that calls for one category or penalty of the public rule set. Payloads (feeds, search answers,
gazette answers, pages): written out as a service would answer, then read by the source modules; the SQL takes their fields directly
from the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text, urls
from ..operators import metrics, render, select
from ..operators.classify import classified, is_publishable
from ..operators.rules import CONSORTIA, GENERAL, GENERAL_MARK
from ..sources import feeds, gazettes, sites
from ..sources.tables import read, spread, written
from . import message_sql, sql

QUERIES, ORACLES = {}, {}

TEMPLATES = [
    "LEI Nº 4.{n}, de agosto. Autoriza a retirada do Município de {town} do Consórcio Intermunicipal de Saúde – {mark}. A saída depende da formalização do desligamento, e o município permanece responsável pelas obrigações, assegurada a continuidade do atendimento.",
    "DECRETO Nº {n}/2025. O Município de {town} confirma a adesão ao Consórcio Público {mark} para a saúde!",
    "Prefeitura de {town} teme a dissolução do consórcio público regional ({mark}) e o rombo do consórcio.",
    "Câmara municipal de {town} cria novo consórcio intermunicipal de resíduos",
    "Auditoria do tribunal de contas no consórcio público {mark} aponta irregularidade? Sim, em {town}.",
    "Extrato do contrato de rateio com o consórcio público {mark}: termo aditivo ao contrato de rateio do Município de {town}.",
    "Rateio do consórcio público com CONS. {mark} aprovado pela prefeitura de {town}.",
    "Rateio pela participação em consórcio público: celebram o município de {town} e o consórcio {mark} o instrumento.",
    "Prefeitura de {town} quita o repasse ao consórcio público {mark}, por decreto.",
    "Município de {town} publica protocolo de intenções do consórcio público",
    "Decreto trata da mudança do estatuto e da assembleia do consórcio público {mark} em {town}.",
    "LEI COMPLEMENTAR N. {n} trata da consolidação e da alteração do protocolo de intenções e do estatuto do consórcio público {mark}.",
    "Consórcio público {mark} inaugura policlínica em {town}.",
    "Adesão a ata de registro de preços do consórcio público {mark}.",
    "Carona do consórcio público de {town} em ata de preços.",
    "Consórcio de empresas vence obra do município; consórcio vencedor assina.",
    "Administradora de consórcio: cota de consórcio no município de {town}.",
    "Lei orçamentária do município de {town} reserva valores a consórcios públicos.",
    "Reunião e pauta: assuntos abordados no consórcio público {mark}.",
    "Consórcio anuncia saída; sem outro assunto.",
    "Festa da cidade de {town} no domingo.",
    "",
]
START = 1_786_000_000  # August 2026
N = len(TEMPLATES)
_LIST = "[" + ", ".join(sql.quoted(t) for t in TEMPLATES) + "]"


def _filled_sql(at: str) -> str:
    return f"replace(replace(replace({_LIST}[{at} + 1], '{{n}}', n::VARCHAR), '{{town}}', town), '{{mark}}', mark)"


ITEMS_SQL = f"""base AS (
  SELECT c_custkey AS n, 'Vila ' || n_name AS town, 'CIS' || chr((65 + c_custkey % 26)::INTEGER) || chr((65 + c_custkey // 26 % 26)::INTEGER) AS mark, c_mktsegment
  FROM customer JOIN nation ON n_nationkey = c_nationkey
), items AS (
  SELECT n AS id, n, CASE WHEN n % 3 = 0 THEN 'gazette' ELSE 'news' END AS kind,
         CASE WHEN n % 3 = 0 THEN 'Diário Oficial de ' || town || ' (MG)' WHEN n % 5 = 0 THEN 'Consórcio em ' || town ELSE 'Notícia ' || n || ' de ' || town || ': *destaque* _final_' END AS title,
         {_filled_sql(f"n % {N}")} AS summary, CASE WHEN n % 3 = 0 THEN [{_filled_sql(f"n % {N}")}, {_filled_sql(f"(n + 5) % {N}")}, ''] END AS excerpts,
         CASE WHEN n % 4 = 0 THEN 'https://www.vila.mg.gov.br/' ELSE 'https://jornal.example.com/' END || n AS url,
         CASE WHEN n % 7 <> 0 THEN c_mktsegment ELSE '' END AS source, make_timestamp((({START} + n * 3571) * 1000000)::BIGINT) AS published_at, CASE WHEN n % 2 = 0 THEN town END AS territory_name
  FROM base
)"""


def town_items(spark, sf_dir) -> DataFrame:
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("Vila "), "n_name").alias("town"))
    base = spread(read(spark, sf_dir, "customer")).join(nation, "c_nationkey").withColumn("n", F.col("c_custkey"))
    letter = lambda x: F.char((65 + x % 26).cast("long"))
    base = base.withColumn("mark", F.concat(F.lit("CIS"), letter(F.col("n")), letter(F.floor(F.col("n") / 26))))

    def filled(at: Column) -> Column:
        out = F.element_at(F.array(*[F.lit(t) for t in TEMPLATES]), (at + 1).cast("int"))
        for name, value in (("{n}", F.col("n").cast("string")), ("{town}", F.col("town")), ("{mark}", F.col("mark"))):
            out = F.replace(out, F.lit(name), value)
        return out

    n, gazette = F.col("n"), F.col("n") % 3 == 0
    news = F.when(n % 5 == 0, F.concat(F.lit("Consórcio em "), "town")).otherwise(F.concat(F.lit("Notícia "), n.cast("string"), F.lit(" de "), "town", F.lit(": *destaque* _final_")))
    host = F.when(n % 4 == 0, "https://www.vila.mg.gov.br/").otherwise("https://jornal.example.com/")
    return base.select(
        n.alias("id"), F.when(gazette, "gazette").otherwise("news").alias("kind"), F.when(gazette, F.concat(F.lit("Diário Oficial de "), "town", F.lit(" (MG)"))).otherwise(news).alias("title"),
        filled(n % N).alias("summary"), F.when(gazette, F.array(filled(n % N), filled((n + 5) % N), F.lit(""))).alias("excerpts"), F.concat(host, n.cast("string")).alias("url"),
        F.when(n % 7 != 0, F.col("c_mktsegment")).otherwise("").alias("source"), F.timestamp_seconds(START + n * 3571).alias("published_at"), F.when(n % 2 == 0, F.col("town")).alias("territory_name"),
        F.lit(0).alias("family_ord"), F.lit(0).alias("query_ord"), n.alias("item_ord"), F.lit(None).cast("string").alias("scraper"),
    )


def query(oracle: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return keep


_CLASSIFIED_SQL = sql.classify(ITEMS_SQL, CONSORTIA)
_EMOJI_SQL = "CASE " + " ".join(f"WHEN category = {sql.quoted(r.category)} THEN {sql.quoted(r.mark)}" for r in CONSORTIA.rules) + f" ELSE {sql.quoted(GENERAL_MARK)} END"
_DECIDED_SQL = f"""{_CLASSIFIED_SQL}, decided AS (
  SELECT items.*, best.category, best.score, best.reasons, coalesce(seg.evidence, '') AS evidence_text, {_EMOJI_SQL} AS emoji
  FROM items JOIN best ON best.id = items.id LEFT JOIN seg ON seg.id = items.id AND seg.idx = best.evidence_index
)"""


@query(f"WITH {_CLASSIFIED_SQL} SELECT id, category, score, evidence_index, array_to_string(reasons, ';') AS reasons FROM best")
def classify_consortia(spark, sf_dir):
    """The public rule set: every category and penalty is called for."""
    c = F.col("classification")
    return classified(town_items(spark, sf_dir), CONSORTIA).select("id", c["category"].alias("category"), c["score"].alias("score"), c["evidence_index"].alias("evidence_index"), F.array_join(c["reasons"], ";").alias("reasons"))


@query(f"WITH {_DECIDED_SQL}, {message_sql.messages('decided')} SELECT id, headline, line, message FROM messages")
def message_render(spark, sf_dir):
    """Headline, summary line and whole message of every item."""
    return render.messages(classified(town_items(spark, sf_dir), CONSORTIA), parts=True).select("id", F.col("_head").alias("headline"), F.col("_line").alias("line"), "message")


_RANK_SQL = "score DESC, published_at DESC, id"
_TOP_SQL = f"WITH {_DECIDED_SQL}, top AS (SELECT * FROM decided WHERE category <> '{GENERAL}' AND score >= 5 ORDER BY {_RANK_SQL} LIMIT 3)"


@query(f"""{_TOP_SQL} SELECT '## {render.PREVIEW}' || chr(10) || chr(10) || string_agg('- ' || emoji || ' **' || category || '** (' || score || ' pontos): [' || title || '](' || url || ')', chr(10) ORDER BY -score, '- ' || emoji || ' **' || category || '** (' || score || ' pontos): [' || title || '](' || url || ')') || chr(10) AS text FROM top""")
def run_report(spark, sf_dir):
    items = classified(town_items(spark, sf_dir), CONSORTIA).filter(is_publishable(5)).orderBy(*select.rank_order()).limit(3)
    return render.run_summary(items.withColumn("_o", -F.col("classification.score")), "_o", False)


_FUNNEL_SQL = f"""WITH {_DECIDED_SQL}, named AS (SELECT *, coalesce(nullif(source, ''), '{metrics.UNKNOWN_SOURCE}') AS name, category <> '{GENERAL}' AND score >= 5 AS relevant, id % 4 = 0 AS preview, category <> '{GENERAL}' AND score >= 5 AND id % 10 = 1 AS new_ FROM decided),
counts AS (SELECT name, '| ' || name || ' | ' || count(*) || ' | ' || count(*) FILTER (category = '{GENERAL}') || ' | ' || count(*) FILTER (category <> '{GENERAL}' AND score < 5) || ' | ' || count(*) FILTER (relevant) || ' | ' || count(*) FILTER (relevant AND preview)
  || ' | ' || count(*) FILTER (relevant AND NOT preview) || ' | ' || count(*) FILTER (new_) || ' | ' || count(*) FILTER (new_) || ' |' AS row FROM named GROUP BY name),
why AS (SELECT name, reason, count(*) AS n FROM (SELECT name, unnest(reasons) AS reason FROM named WHERE category = '{GENERAL}') WHERE starts_with(reason, 'rejeitado:') GROUP BY ALL)
SELECT {message_sql.plain(render.FUNNEL_HEAD.format(minimum=5))} || (SELECT string_agg(row, chr(10) ORDER BY name) FROM counts) || {message_sql.plain(render.REASONS_HEAD)}
  || (SELECT string_agg('- ' || name || ': ' || reason || ' (' || n || ')', chr(10) ORDER BY name, reason) FROM why) || chr(10) AS text"""


@query(_FUNNEL_SQL)
def funnel_report(spark, sf_dir):
    rows = classified(town_items(spark, sf_dir), CONSORTIA)
    relevant = is_publishable(5)
    new = relevant & (F.col("id") % 10 == 1)
    flags = rows.select("source", "scraper", "classification.category", "classification.score", "classification.reasons", relevant.alias("is_relevant"), (F.col("id") % 4 == 0).alias("is_preview"), F.lit(True).alias("is_classified"), new.alias("is_unseen"), new.alias("is_selected"))
    return render.funnel_table(metrics.funnel(flags))


@query(f"SELECT doc_id, {message_sql.printable('text')} AS printable, {message_sql.inline('text')} AS inline FROM documents")
def inline_text(spark, sf_dir):
    """Control characters to spaces; one line without emphasis marks."""
    return read(spark, sf_dir, "documents").select("doc_id", text.printable(F.col("text")).alias("printable"), text.inline(F.col("text")).alias("inline"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE o_orderkey % 4 WHEN 0 THEN 'https://a.br/n/' || o_orderkey WHEN 1 THEN 'https://a.br/x/p' || o_orderkey
WHEN 2 THEN 'https://b.br/' || o_orderkey ELSE 'https://a.br/up/' || o_orderkey END AS address FROM orders""")
def day_and_address(spark, sf_dir):
    """ISO days, and addresses made absolute against a base."""
    n, key = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    value = F.when(n == 0, F.concat(F.lit("/n/"), key)).when(n == 1, F.concat(F.lit("p"), key)).when(n == 2, F.concat(F.lit("https://b.br/"), key)).otherwise(F.concat(F.lit("../up/"), key))
    rows = read(spark, sf_dir, "orders")
    return rows.select("o_orderkey", dates.iso_day(F.col("o_orderdate")).alias("day"), urls.absolute(value, F.lit("https://a.br/x/y")).alias("address"))


_AT_SQL = "make_timestamp(((1767225600 + c_custkey * 61) * 1000000)::BIGINT)"


def _at() -> Column:
    return F.timestamp_seconds(1_767_225_600 + F.col("c_custkey") * 61)


def _joined(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


@query(f"""SELECT 'F' || c_custkey % 9 AS source, c_custkey AS query_ord, 'A & ' || c_name AS title, 'https://x.example/' || c_custkey AS url, {_AT_SQL} AS published, c_mktsegment || ' texto' AS summary FROM customer""")
def feed_entries(spark, sf_dir):
    """RSS and Atom payloads: dates in both forms, an alternate link beside others, markup, an entry without date."""
    key = F.col("c_custkey").cast("string")
    rss = _joined(
        "<rss><channel><item><title>A &amp; ", F.col("c_name"), "</title><link>https://x.example/", key, "</link><pubDate>", F.date_format(_at(), "EEE, d MMM yyyy HH:mm:ss 'GMT'"), "</pubDate><description><![CDATA[<b>",
        F.col("c_mktsegment"), "</b>  texto]]></description></item><item><title>Sem data</title><link>https://x.example/</link></item></channel></rss>",
    )
    atom = _joined(
        '<feed><entry><title>A &amp; ', F.col("c_name"), '</title><link rel="self" href="https://x.example/self"/><link rel="alternate" href="https://x.example/', key, '"/><updated>', F.date_format(_at() - F.expr("INTERVAL 3 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"),
        "-03:00</updated><summary>", F.col("c_mktsegment"), " texto</summary></entry></feed>",
    )
    rows = read(spark, sf_dir, "customer").select(_joined("F", (F.col("c_custkey") % 9).cast("string")).alias("name"), F.col("c_custkey").alias("ord"), F.when(F.col("c_custkey") % 2 == 0, rss).otherwise(atom).alias("xml"))
    return feeds.feed_items(rows).select("source", "query_ord", "title", "url", F.col("published_at").cast("timestamp_ntz").alias("published"), "summary")


@query(f"""SELECT c_custkey AS query_ord, c_name AS title, 'https://x.example/' || c_custkey AS url, {_AT_SQL} AS published, CASE WHEN c_custkey % 3 <> 0 THEN 'Jornal ' || c_mktsegment ELSE '{feeds.SEARCH_NAME}' END AS source,
CASE WHEN c_custkey % 3 <> 0 THEN 'https://pub.example/' || c_nationkey ELSE '' END AS source_url FROM customer""")
def search_entries(spark, sf_dir):
    """News search payloads: the publisher and its address where the entry names them."""
    publisher = F.when(F.col("c_custkey") % 3 != 0, _joined('<source url="https://pub.example/', F.col("c_nationkey").cast("string"), '">Jornal ', F.col("c_mktsegment"), "</source>")).otherwise("")
    xml = _joined("<rss><channel><item><title> ", F.col("c_name"), " </title><link>https://x.example/", F.col("c_custkey").cast("string"), "</link><pubDate>", F.date_format(_at(), "EEE, d MMM yyyy HH:mm:ss 'GMT'"), "</pubDate><description>d</description>", publisher, "</item></channel></rss>")
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), xml.alias("xml"))
    return feeds.search_items(rows).select("query_ord", "title", "url", F.col("published_at").cast("timestamp_ntz").alias("published"), "source", "source_url")


@query(f"""WITH g AS (SELECT *, o_custkey % 20 AS t, date_trunc('month', o_orderdate)::DATE AS d FROM orders), e AS (
  SELECT t, d, o_custkey, o_orderkey, unnest([o_orderpriority, o_orderstatus]) AS x, unnest([0, 1]) AS i FROM g), f AS (
  SELECT t, d, x, min((o_custkey, o_orderkey, i)) AS spot FROM e GROUP BY t, d, x)
SELECT 'Diário Oficial de Vila ' || t || ' (MG)' AS title, 'https://g.example/' || t AS url, d::TIMESTAMP + INTERVAL 15 HOUR AS published, string_agg(x, ' ' ORDER BY spot) AS summary, count(*) AS excerpts FROM f GROUP BY t, d""")
def gazette_entries(spark, sf_dir):
    """Gazette answers, one a customer: publications that several answers hold merge, excerpts in order of appearance."""
    t = (F.col("o_custkey") % 20).cast("string")
    gazette = F.struct(
        _joined("https://g.example/", t).alias("url"), t.alias("territory_id"), _joined("Vila ", t).alias("territory_name"), F.lit("MG").alias("state_code"), F.date_format(F.trunc("o_orderdate", "month"), "yyyy-MM-dd").alias("date"),
        F.lit("1").alias("edition"), F.array("o_orderpriority", _joined(" <b>", F.col("o_orderstatus"), "</b> "), F.lit("")).alias("excerpts"),
    )
    rows = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", gazette.alias("g")))), lambda x: x["g"]).alias("gazettes"))
    payloads = rows.select(F.col("o_custkey").alias("ord"), F.to_json(F.struct("gazettes")).alias("json"))
    return gazettes.gazette_items(payloads).select("title", "url", F.col("published_at").cast("timestamp_ntz").alias("published"), "summary", F.size("excerpts").cast("long").alias("excerpts"))


_ADAPTERS = ["rncp", "cnm", "tce-mg", "diario-municipal-index", "none"]


def _pages(spark, sf_dir) -> DataFrame:
    """One page a customer for each of the adapters in turn; every fifth names an adapter that does not exist, every eleventh has no structure."""
    key, day = F.col("c_custkey").cast("string"), F.date_format(_at(), "dd/MM/yyyy")
    card = _joined('<div class="post-item a"><h3 class="entry-title"><a href="/n/', key, '">Título &amp; ', F.col("c_name"), '</a></h3><span class="post-date updated">', day, '</span><p class="post-desc">Resumo <b>', F.col("c_mktsegment"), "</b></p></div>")
    listed = F.to_json(F.struct(F.struct(F.struct(F.array(F.struct(_joined("Título & ", F.col("c_name")).alias("titulo"), key.alias("slug"), _joined(day, " 10:00").alias("datetime"), _joined("<p>Resumo ", F.col("c_mktsegment"), "</p>").alias("conteudo"))).alias("data")).alias("dados")).alias("props")))
    data = _joined('<div id="app" data-page="', F.replace(F.replace(listed, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), '"></div>')
    heading = _joined('<h2><span class="data-noticia-internas">', day, '</span> <a href="/Noticia/', key, '">Título &amp; ', F.col("c_name"), "</a></h2><div></div><p>Resumo ", F.col("c_mktsegment"), '</p><h2><span class="data-noticia-internas">-</span><a href="/Noticia/0">x</a></h2>')
    index = _joined('<a id="downloadPdf" href="/e/', key, '.pdf"></a><div id="ultima-edicao"><span>', day, "</span></div>")
    n = F.col("c_custkey") % 5
    html = F.when(F.col("c_custkey") % 11 == 0, "<p>nada</p>").when(n == 0, card).when(n == 1, data).when(n == 2, heading).otherwise(index)
    latin = n == 2
    return spread(read(spark, sf_dir, "customer")).select(
        _joined("S", key).alias("name"), F.element_at(F.array(*[F.lit(a) for a in _ADAPTERS]), (n + 1).cast("int")).alias("adapter"), _joined("https://s.example/", key, "/x").alias("url"), (F.col("c_custkey") % 2 == 0).alias("publish"),
        F.when(latin, "iso-8859-1").alias("encoding"), F.col("c_custkey").cast("int").alias("ord"), F.lit("text/html; charset=utf-8").alias("content_type"), F.when(latin, F.encode(html, "iso-8859-1")).otherwise(F.encode(html, "UTF-8")).alias("body"),
        F.lit(None).cast("string").alias("error"),
    )


@query(f"""SELECT 'S' || c_custkey AS source, {"['" + "', '".join(_ADAPTERS) + "']"}[c_custkey % 5 + 1] AS scraper, CASE WHEN c_custkey % 5 = 3 THEN 'gazette-index' ELSE 'news' END AS kind,
CASE WHEN c_custkey % 5 = 3 THEN '{sites.EDITION}S' || c_custkey ELSE 'Título & ' || c_name END AS title,
'https://s.example/' || CASE c_custkey % 5 WHEN 0 THEN 'n/' WHEN 1 THEN 'comunicacao/noticias/' WHEN 2 THEN 'Noticia/' ELSE 'e/' END || c_custkey || CASE WHEN c_custkey % 5 = 3 THEN '.pdf' ELSE '' END AS url,
date_trunc('day', {_AT_SQL}) + INTERVAL 15 HOUR AS published, CASE WHEN c_custkey % 5 = 3 THEN '{sites.NOT_READ}' ELSE 'Resumo ' || c_mktsegment END AS summary, c_custkey % 2 <> 0 AS preview FROM customer WHERE c_custkey % 5 < 4 AND c_custkey % 11 <> 0""")
def site_entries(spark, sf_dir):
    """Items of pages through the four site adapters, one of them in another encoding."""
    items = sites.site_items(sites.parsed_pages(_pages(spark, sf_dir)))
    return items.select("source", "scraper", "kind", "title", "url", F.col("published_at").cast("timestamp_ntz").alias("published"), "summary", F.col("preview_only").alias("preview"))


@query(f"""SELECT 'S' || c_custkey AS name, {"['" + "', '".join(_ADAPTERS) + "']"}[c_custkey % 5 + 1] AS adapter, CASE WHEN c_custkey % 5 < 4 AND c_custkey % 11 <> 0 THEN 'ok' ELSE 'error' END AS status,
CASE WHEN c_custkey % 5 < 4 AND c_custkey % 11 <> 0 THEN 1 ELSE 0 END::BIGINT AS item_count FROM customer UNION ALL SELECT 'off', 'rncp', 'disabled', 0""")
def site_diagnostics(spark, sf_dir):
    """A failing page is told of and ends no other."""
    parsed = written(sites.parsed_pages(_pages(spark, sf_dir)))
    return sites.diagnostics(parsed, sites.site_items(parsed), [{"name": "off", "adapter": "rncp"}]).select("name", "adapter", "status", "item_count")
