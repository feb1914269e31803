"""Headlines, summaries and messages of selected items, as native expressions over an item row with its classification."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import spelled
from ..functions.text import LEFT, RIGHT, filled, for_match, inline, whitespace
from .classify import GAZETTE
from .metrics import joined_lines

# Fixed values, down to FUNNEL_HEAD and NO_REASON: wording of the messages and reports, and the patterns that choose it. {place}, {label}, {legal} and {target} are filled in; of a pair, the first is used
# where a consortium's short name was found.
LABELS = {
    "CRISE": "ALERTA SOBRE CONSÓRCIO", "SAÍDA": "SAÍDA DE CONSÓRCIO", "CRIAÇÃO": "CRIAÇÃO DE CONSÓRCIO", "ADESÃO": "ADESÃO A CONSÓRCIO", "RATEIO": "CONTRATO DE RATEIO",
    "PROTOCOLO": "PROTOCOLO DE INTENÇÕES", "GOVERNANÇA": "GESTÃO DO CONSÓRCIO", "CONTROLE": "FISCALIZAÇÃO E CONTROLE", "FINANÇAS": "FINANÇAS DO CONSÓRCIO", "AÇÃO": "ATUAÇÃO DO CONSÓRCIO",
}
OTHER_LABEL, LOOSE_SHARE_LABEL = "CONSÓRCIOS PÚBLICOS", "RATEIO CONSORCIAL"
HEADLINES = {
    "CRISE": ("{place} publica alerta sobre consórcio",) * 2,
    "SAÍDA": ("{place} autoriza saída do {label}", "{place} autoriza saída de consórcio"),
    "CRIAÇÃO": ("{place} formaliza criação de consórcio",) * 2,
    "ADESÃO": ("{place} autoriza adesão ao {label}", "{place} autoriza adesão a consórcio"),
    "RATEIO contrato": ("{place} publica contrato de rateio com o {label}", "{place} publica contrato de rateio"),
    "RATEIO": ("{place} publica ato sobre rateio consorcial",) * 2,
    "PROTOCOLO": ("{place} publica protocolo de intenções",) * 2,
    "GOVERNANÇA alteração": ("{place} ratifica alteração do protocolo do {label}", "{place} ratifica alteração do protocolo"),
    "GOVERNANÇA": ("{place} publica medida de gestão consorcial",) * 2,
    "CONTROLE": ("{place} tem ato de fiscalização sobre consórcio",) * 2,
    "FINANÇAS": ("{place} publica ato financeiro sobre consórcio",) * 2,
}
LEADS = {
    "SAÍDA": ("{legal} autoriza {place} a se retirar d{target}.",) * 2,
    "ADESÃO": ("{legal} autoriza {place} a integrar {target}.",) * 2,
    "CRIAÇÃO": ("{legal} trata da criação de um novo consórcio intermunicipal em {place}.",) * 2,
    "RATEIO aditivo": ("{place} publicou termo aditivo ao contrato de rateio com {target}.",) * 2,
    "RATEIO contrato": ("{place} publicou contrato de rateio com {target}.",) * 2,
    "RATEIO dotação": ("{place} publicou dotação orçamentária relacionada à participação em consórcio público.",) * 2,
    "RATEIO": ("{place} publicou ato relativo ao rateio com {target}.",) * 2,
    "PROTOCOLO": ("{place} publicou ato relacionado ao protocolo de intenções d{target}.",) * 2,
    "CRISE": ("{place} publicou ato relacionado à dissolução, extinção ou situação crítica d{target}.",) * 2,
    "GOVERNANÇA alteração": ("{place} ratificou alteração do protocolo de intenções d{target}.",) * 2,
    "GOVERNANÇA": ("{place} publicou uma medida de gestão relacionada ao {label}.", "{place} publicou uma medida de gestão relacionada a consórcio intermunicipal."),
    "CONTROLE": ("{place} aparece em ato de fiscalização ou controle relacionado ao {label}.", "{place} aparece em ato de fiscalização ou controle relacionado a consórcio intermunicipal."),
    "FINANÇAS": ("{place} publicou ato financeiro relacionado ao {label}.", "{place} publicou ato financeiro relacionado a consórcio intermunicipal."),
}
KEY_POINTS = [
    ("formalizacao do desligamento|efetiva formalizacao da saida", "A saída ainda depende da formalização do desligamento."),
    ("obrigacoes pecuniarias|compromissos assumidos|permanece responsavel pelas obrigacoes", "As obrigações assumidas permanecem até a saída ser efetivada."),
    ("continuidade da assistencia a saude|continuidade do atendimento", "A continuidade da assistência à saúde deverá ser assegurada."),
    ("termo aditivo ao contrato de rateio", "A publicação trata de um termo aditivo ao contrato de rateio."),
]
SHARE_CONTRACT, ADDENDUM, ALLOTMENT, PROTOCOL_CHANGE = "contrato(s)? de rateio", "termo aditivo", "rateio pela participacao", "alteracao.{0,120}protocolo de intencoes"
NO_NAME = "MG SP PR SC RS BR PUBLICO PÚBLICO INTERMUNICIPAL NACIONAL REGIONAL INSTITUICAO INSTITUIÇÃO SECRETARIA CNM FNS DEP".split()
NAME = r"([A-Z][A-Z0-9]{2,14})"
NAMES = [rf"cons[oó]rcio\s+(?:p[uú]blico\s+)?{NAME}{RIGHT}", rf"cons[oó]rcio.{{0,180}}\({NAME}\)", rf"cons[oó]rcio.{{0,180}}[–—-]\s*{NAME}{RIGHT}"]
SHARE_NAME = rf"{LEFT}CONS\.\s*{NAME}{RIGHT}"
LAW = rf"(?iu){LEFT}(LEI(?:\s+COMPLEMENTAR)?|DECRETO)\s+N(?:[º°]|O)?\.?\s*([0-9.]+(?:/[0-9]{{4}})?)"
NO_LEGAL, NO_TARGET, SOME_TOWN, TOWN = "O ato municipal", "o consórcio intermunicipal citado", "O município", "Município"
POINTS_TITLE, OFFICIAL_LINK, NEWS_LINK = "*Pontos-chave*", "Acesse o ato oficial (PDF)", "Leia a notícia completa"
SENT, PREVIEW, NOTHING = "Notícias publicadas", "Prévia — nenhuma mensagem enviada", "- Nenhuma notícia nova atingiu a pontuação mínima."
FUNNEL_HEAD = (
    "## Funil de qualidade por fonte\n\nLimiar de publicação: {minimum} pontos.\n\n| Fonte | Coletados | Rejeitados | Abaixo do limiar | Relevantes | Prévia | Publicáveis | Novos | Selecionados |\n"
    "|---|---:|---:|---:|---:|---:|---:|---:|---:|\n"
)
NO_CANDIDATE = "- Nenhum candidato novo dos scrapers atingiu a pontuação mínima."
NO_SOURCE, REASONS_HEAD, NO_REASON = "| Nenhuma fonte | 0 | 0 | 0 | 0 | 0 | 0 | 0 | 0 |", "\n\n### Motivos de descarte\n\n", "- Nenhum descarte contextual nesta execução."


def _text(*names: str) -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(n), F.lit("")) for n in names])


def _category() -> Column:
    return F.coalesce(F.col("classification.category"), F.lit(""))


def short_name() -> Column:
    """A consortium's short name in capitals; the empty text if none is found."""
    text = whitespace(_text("title", "summary", "raw_text"))
    text = F.when(F.col("kind").eqNullSafe(GAZETTE), F.substring(text, 1, 1600)).otherwise(text)
    found = [F.when(_category() == "RATEIO", F.upper(F.regexp_extract(text, f"(?iu){SHARE_NAME}", 1)))]
    found += [F.upper(F.regexp_extract(text, f"(?iu){n}", 1)) for n in NAMES]
    return filled(*[F.when(~f.isin(NO_NAME), f) for f in found])


def legal_act() -> Column:
    """The law or decree that the opening names, with its article; null if none."""
    text = F.substring(whitespace(_text("summary", "raw_text")), 1, 260)
    kind, number = F.lower(F.regexp_extract(text, LAW, 1)), F.regexp_extract(text, LAW, 2)
    name = F.when(kind == "decreto", "O Decreto").when(kind.contains("complementar"), "A Lei Complementar").otherwise("A Lei")
    year = F.when(number.contains("/") | F.col("published_at").isNull(), "").otherwise(F.concat(F.lit("/"), F.year("published_at").cast("string")))
    return F.when(kind != "", F.concat(name, F.lit(" nº "), number, year))


def first_sentence(text: Column, fallback: Column) -> Column:
    """The first sentence if it has at most 280 characters, else the fallback, ended by a full stop."""
    plain, other = whitespace(text), whitespace(fallback)
    # the guard keeps long texts without an end of sentence from being searched at every place
    first = F.when(plain.rlike("[^.!?][.!?]"), F.trim(F.regexp_extract(plain, "([^.!?]+[.!?]+)", 1))).otherwise("")
    return F.when((first != "") & (F.length(first) <= 280), first).otherwise(F.when(other.rlike("[.!?]$"), other).otherwise(F.concat(other, F.lit("."))))


def _filled_in(template: str, parts: dict[str, Column]) -> Column:
    return F.concat(*[parts[x[1:-1]] if x.startswith("{") else F.lit(x) for x in re.split(r"(\{\w+\})", template) if x])


def _chosen(templates: dict[str, tuple[str, str]], variant: Column, parts: dict[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for key, (named, plain) in templates.items():
        text = _filled_in(plain, parts) if named == plain else F.when(parts["label"] != "", _filled_in(named, parts)).otherwise(_filled_in(plain, parts))
        out = F.when(variant == key, text).otherwise(out)
    return out


def _evidence() -> Column:
    return filled(F.col("classification.evidence_text"), _text("summary", "raw_text"))


def with_parts(items: DataFrame) -> DataFrame:
    """Adds what several parts of a message need, so each is worked out once: _label, _law, _opening, _named, _proof."""
    for c in ("territory_name", "raw_text", "kind"):
        if c not in items.columns:
            items = items.withColumn(c, F.lit(None).cast("string"))
    return _held(items, {"_label": short_name(), "_law": legal_act(), "_opening": F.substring(for_match(_text("summary", "raw_text")), 1, 1000), "_named": for_match(_text("title", "summary")), "_proof": for_match(_evidence())})


def _held(rows: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """rows with columns that later ones use many times: made by a one-row generator, so that they are not worked out at every use."""
    held = rows.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in parts.items()]))).alias("_part"))
    return held.select("*", "_part.*").drop("_part")


def headline() -> Column:
    """Headline of an item with its parts."""
    changed = F.substring("_opening", 1, 800).rlike(PROTOCOL_CHANGE)
    variant = F.when((_category() == "RATEIO") & F.col("_named").rlike(SHARE_CONTRACT), "RATEIO contrato").when((_category() == "GOVERNANÇA") & changed, "GOVERNANÇA alteração").otherwise(_category())
    parts = {"place": inline(filled(F.col("territory_name"), F.lit(TOWN))), "label": F.col("_label")}
    own = inline(F.col("title"))
    return F.when(F.col("kind").eqNullSafe(GAZETTE), F.coalesce(_chosen(HEADLINES, variant, parts), own)).otherwise(own)


def summary_line() -> Column:
    """Summary of an item with its parts."""
    changed = F.substring("_proof", 1, 800).rlike(PROTOCOL_CHANGE)
    share = F.substring("_opening", 1, 700)
    contract = F.when(share.rlike(ADDENDUM), "RATEIO aditivo").otherwise("RATEIO contrato")
    variant = (
        F.when(_category() == "RATEIO", F.when(share.rlike(SHARE_CONTRACT), contract).when(F.col("_opening").rlike(ALLOTMENT), "RATEIO dotação").otherwise("RATEIO"))
        .when((_category() == "GOVERNANÇA") & changed, "GOVERNANÇA alteração")
        .otherwise(_category())
    )
    parts = {
        "place": inline(filled(F.col("territory_name"), F.lit(SOME_TOWN))), "label": F.col("_label"), "legal": F.coalesce("_law", F.lit(NO_LEGAL)),
        "target": F.when(F.col("_label") != "", F.concat(F.lit("o "), F.col("_label"))).otherwise(NO_TARGET),
    }
    gazette = F.coalesce(_chosen(LEADS, variant, parts), first_sentence(filled(F.col("summary"), F.col("raw_text")), F.col("title")))
    news = first_sentence(filled(F.col("classification.evidence_text"), F.col("summary"), F.col("raw_text")), F.col("title"))
    return F.when(F.col("kind").eqNullSafe(GAZETTE), gazette).otherwise(news)


def key_points() -> Column:
    """At most three fixed sentences that an act's text calls for."""
    return F.slice(F.filter(F.array(*[F.when(F.col("_proof").rlike(p), F.lit(s)) for p, s in KEY_POINTS]), lambda x: x.isNotNull()), 1, 3)


def without_double_blanks(lines: Column) -> Column:
    return F.filter(lines, lambda x, i: (x != "") | (i == 0) | (F.element_at(lines, F.greatest(i, F.lit(1))) != ""))


def messages(items: DataFrame, name: str = "message", parts: bool = False) -> DataFrame:
    """Adds the whole message of every item. parts: and its headline (_head) and summary (_line), as they were worked out for it."""
    rows = _held(with_parts(items), {"_head": headline(), "_line": summary_line(), "_points": key_points()})
    gazette = F.col("kind").eqNullSafe(GAZETTE)
    loose = (_category() == "RATEIO") & ~F.col("_named").rlike(SHARE_CONTRACT)
    label = F.lit(OTHER_LABEL)
    for category, text in LABELS.items():
        label = F.when(_category() == category, text).otherwise(label)
    none = F.array().cast("array<string>")
    bullets = F.concat(F.array(F.lit(""), F.lit(POINTS_TITLE)), F.transform("_points", lambda p: F.concat(F.lit("- "), inline(p))))
    head = F.array(
        F.concat(F.coalesce(F.col("classification.emoji"), F.lit("📰")), F.lit(" *"), F.when(loose, LOOSE_SHARE_LABEL).otherwise(label), F.lit("*")),
        F.concat(F.lit("*"), inline(F.col("_head")), F.lit("*")), F.lit(""), F.concat(F.lit("> "), inline(F.col("_line"))),
    )
    foot = F.array(
        F.lit(""), F.concat(F.lit("_📅 "), spelled(F.col("published_at")), F.lit("  ·  📰 "), inline(F.col("source")), F.lit("_")),
        F.concat(F.lit("🔗 *"), F.when(gazette, OFFICIAL_LINK).otherwise(NEWS_LINK), F.lit(":*")), F.coalesce(F.col("url"), F.lit("")),
    )
    rows = rows.withColumn("_lines", F.concat(head, F.when(gazette & (F.size("_points") > 0), bullets).otherwise(none), foot))
    text = F.trim(F.array_join(without_double_blanks(F.col("_lines")), "\n"))
    return rows.withColumn(name, text).drop("_label", "_law", "_opening", "_named", "_proof", "_points", "_lines", *([] if parts else ["_head", "_line"]))


def run_summary(items: DataFrame, order: str, sent: bool) -> DataFrame:
    """One row with the report of a run. The items of a run are few: its quota bounds them."""
    c = F.col("classification")
    line = F.concat(F.lit("- "), c["emoji"], F.lit(" **"), c["category"], F.lit("** ("), c["score"].cast("string"), F.lit(" pontos): ["), F.col("title"), F.lit("]("), F.col("url"), F.lit(")"))
    rows = joined_lines(items.withColumn("_line", line), order, "_line")
    return rows.select(F.concat(F.lit(f"## {SENT if sent else PREVIEW}\n\n"), F.when(F.coalesce("text", F.lit("")) == "", NOTHING).otherwise(F.col("text")), F.lit("\n")).alias("text"))


def funnel_table(funnel: DataFrame, minimum: int = 5) -> DataFrame:
    """One row with the funnel as a Markdown table and the reasons of discarding; sources in Portuguese order."""
    cells = ["source", "collected", "rejected", "below_minimum", "relevant", "preview_only", "publishable", "unseen", "selected"]
    row = F.concat(F.lit("| "), F.array_join(F.array(*[F.col(c).cast("string") for c in cells]), " | "), F.lit(" |"))
    funnel = funnel.withColumns({"_line": row, "_at": F.collate(F.col("source"), "pt")})
    rows = joined_lines(funnel, "_at", "_line").select(F.col("text").alias("rows"))
    why = funnel.select("_at", "source", F.explode("discard_reasons").alias("reason", "n"))
    why = why.select(F.struct("_at", "reason").alias("_at"), F.concat(F.lit("- "), "source", F.lit(": "), "reason", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("_line"))
    both = rows.crossJoin(joined_lines(why, "_at", "_line").select(F.col("text").alias("why")))  # one row each
    filled_or = lambda c, other: F.when(F.coalesce(F.col(c), F.lit("")) == "", other).otherwise(F.col(c))
    return both.select(F.concat(F.lit(FUNNEL_HEAD.format(minimum=minimum)), filled_or("rows", NO_SOURCE), F.lit(REASONS_HEAD), filled_or("why", NO_REASON), F.lit("\n")).alias("text"))


def preview_summary(items: DataFrame, order: str, observed: int, diagnostics: DataFrame) -> DataFrame:
    """One row with the report of the sites: each site's state (diagnostics: name, status, item_count, message, part, place; few rows), then
    the candidates that were not sent."""
    c, n = F.col("classification"), F.coalesce(F.col("item_count"), F.lit(0)).cast("string")
    told = F.when(F.col("status") == "ok", F.concat(F.lit("- ✅ "), "name", F.lit(": "), n, F.lit(" item(ns) dentro da janela.")))
    told = told.when(F.col("status") == "disabled", F.concat(F.lit("- ℹ️ "), "name", F.lit(": chamada direta desativada — "), F.coalesce("message", F.lit("")), F.lit(".")))
    told = told.otherwise(F.concat(F.lit("- ⚠️ "), "name", F.lit(": falha isolada — "), F.coalesce("message", F.lit(""))))
    states = joined_lines(diagnostics.withColumns({"_line": told, "_at": F.struct("part", "place")}), "_at", "_line").select(F.coalesce("text", F.lit("")).alias("states"))
    line = F.concat(F.lit("- "), c["emoji"], F.lit(" **"), c["category"], F.lit("** ("), c["score"].cast("string"), F.lit(" pontos): ["), F.col("title"), F.lit("]("), F.col("url"), F.lit(")"))
    rows = joined_lines(items.withColumn("_line", line), order, "_line").select(F.coalesce("text", F.lit("")).alias("rows"))
    head = f"## Scrapers em prévia\n\n{observed} item(ns) observado(s); nenhum deles foi enviado automaticamente.\n\n"
    states_part = F.when(F.col("states") != "", F.concat("states", F.lit("\n"))).otherwise("")
    return states.crossJoin(rows).select(F.concat(F.lit(head), states_part, F.lit("\n"), F.when(F.col("rows") == "", NO_CANDIDATE).otherwise(F.col("rows")), F.lit("\n")).alias("text"))  # one row each
