"""Rule sets: weighted patterns as data, regular expressions over unaccented lower-case text.

Java counts accented letters as word characters at \\b, so for Spark a boundary is written out by ASCII letters; RE2 takes the patterns
as they are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.text import LEFT, RIGHT

REJECTED = "rejeitado: "
GENERAL, GENERAL_MARK = "GERAL", "📰"


@dataclass(frozen=True)
class Rule:
    category: str
    mark: str
    weight: int
    priority: int
    patterns: tuple[str, ...]


@dataclass(frozen=True)
class Penalty:
    """Points lost if one of `cases` holds: a pattern that is found while another (or None) is not."""

    points: int
    reason: str
    cases: tuple[tuple[str, str | None], ...]


@dataclass(frozen=True)
class RuleSet:
    subject: str
    strong: str
    local: str
    rules: tuple[Rule, ...]
    penalties: tuple[Penalty, ...] = field(default=())
    official: tuple[str, ...] = ()


def java(pattern: str) -> str:
    """\\b before a letter, group or class begins a word; any other ends one."""
    return re.sub(r"\\b(?=[a-z(\[])", lambda _: LEFT, pattern).replace(r"\b", RIGHT)


def quick(pattern: str) -> str:
    """`java` of the pattern, which looks at the first letter of a word, where it is plain to see, before the boundary, which costs more."""

    def begin(found: re.Match) -> str:
        words = (found["words"] or found["letter"] or "").split("|")
        return f"(?=[{''.join(sorted({w[0] for w in words}))}])\\b" if all(re.match("[a-z](?![?*{])", w) for w in words) else found[0]

    return java(re.sub(r"\\b(?=\((?P<words>[^()]*)\)(?![?*{])|(?P<letter>[a-z])(?![?*{]))", begin, pattern))


def needed(pattern: str) -> str:
    """A plain text that whatever the pattern finds must hold: the longest outside groups, classes and repetitions; may be empty."""
    plain = re.sub(r"\([^()]*\)[?*+]?|\[[^\]]*\][?*+]?|\.(\{[^}]*\}|[?*+])?|\\.[?*+]?", "\0", pattern)
    return "" if re.search(r"[()|]", plain) else max(re.findall(r"[a-z ]+(?![?*{])", plain), key=len, default="")


def required(pattern: str) -> list[list[str]]:
    """Lists of plain texts: whatever the pattern finds must hold one of each list. The needed text, and the words of each group that is not optional."""
    plain = re.sub(r"(\[[^\]]*\]|\.|\\.)(\{[^}]*\}|[?*+])?", "\0", pattern)
    groups, outside, depth, begin = [], "", 0, 0
    for i, c in enumerate(plain):
        depth -= c == ")"
        if c == ")" and not depth and plain[i + 1 : i + 2] not in ("?", "*", "{"):
            groups.append(plain[begin:i])
        if c == "(" and not depth:
            begin = i + 1
        outside += c if not depth else ""
        depth += c == "("
    if "|" in outside:
        return []
    lists = [[needed(w) for w in g.split("|")] for g in groups if "(" not in g and not g.startswith("?")]
    lists = [sorted({w for w in words if not any(o != w and o in w for o in words)}) for words in lists if all(words)]
    return [[needed(pattern)]] * bool(needed(pattern)) + lists


def re2(pattern: str) -> str:
    return pattern


# The vocabulary of public consortia. Words, gaps, weights and priorities decide the results.
CONSORTIA = RuleSet(
    subject=r"\bconsorcio(s)?\b",
    strong=r"\b(consorcio publico|consorcio intermunicipal|consorcio interfederativo|associacao publica|lei 11\.?107)\b",
    local=r"\b(municipio|municipal|prefeitura|camara municipal|poder executivo)\b",
    official=(".gov.br", ".leg.br", ".mp.br"),
    rules=(
        Rule("CRISE", "🟥", 8, 100, (
            r"\b(dissolucao|extincao|liquidacao|intervencao|colapso|falencia)\b.{0,140}\bconsorcio",
            r"\bconsorcio\b.{0,140}\b(dissolucao|extincao|liquidacao|intervencao|colapso|falencia)\b",
            r"\b(inadimplencia|deficit|rombo|insolvencia)\b.{0,100}\bconsorcio",
            r"\bconsorcio\b.{0,100}\b(inadimplencia|deficit|rombo|insolvencia)\b",
            r"\bdivida(s)?\b.{0,30}\b(do|junto ao) consorcio",
            r"\bconsorcio\b.{0,120}\b(paralisado|inoperante|sem recursos|sem repasse|encerra atividades)\b",
        )),
        Rule("SAÍDA", "🟧", 8, 90, (
            r"\b(retirada|desligamento|desvinculacao|saida|exclusao)\b.{0,140}\b(consorcio|municipio consorciado)",
            r"\bconsorcio\b.{0,140}\b(retirada|desligamento|desvinculacao|saida|exclusao)\b",
            r"\b(deixa|deixou|sai|saiu|rompe|rompeu)\b.{0,100}\bconsorcio",
            r"\bdenuncia\b.{0,100}\bprotocolo de intencoes",
        )),
        Rule("CRIAÇÃO", "🟩", 8, 85, (
            r"\b(cria|criado|criacao|institui|formaliza)\b.{0,140}\bconsorcio",
            r"\b(constitui|constituicao)\b.{0,50}\b(um |do )consorcio",
            r"\bnovo consorcio\b",
        )),
        Rule("ADESÃO", "🟦", 7, 80, (
            r"\b(adesao|ingresso|integracao|filiacao|inclusao)\b.{0,130}\b(ao |no )?consorcio",
            r"\b(autoriza|autorizado)\b.{0,140}\b(municipio|prefeitura|poder executivo)\b.{0,140}\b(participar|integrar|aderir)\b.{0,100}\bconsorcio",
            r"\b(passa a integrar|torna-se membro|municipio consorciado)\b.{0,100}\bconsorcio",
            r"\bratifica\b.{0,140}\bprotocolo de intencoes",
            r"\bratificacao\b.{0,80}\bprotocolo de intencoes\b",
            r"\bratificacao\b.{0,180}\bprotocolo de intencoes\b.{0,220}\b(participacao|ingresso|adesao)\b",
        )),
        Rule("CONTROLE", "🟥", 7, 75, (
            r"\b(auditoria|investigacao|operacao|acao civil publica|recomendacao)\b.{0,140}\bconsorcio",
            r"\bconsorcio\b.{0,140}\b(irregularidade|fraude|desvio|improbidade|contas rejeitadas)\b",
            r"\b(tribunal de contas|ministerio publico|tce|tcu)\b.{0,160}\bconsorcio",
        )),
        Rule("RATEIO", "🟪", 7, 70, (
            r"\bcontrato(s)? de rateio\b",
            r"\brateio\b.{0,100}\bconsorcio",
        )),
        Rule("FINANÇAS", "💰", 6, 65, (
            r"\b(repasse|aporte|parcelamento|debito|prestacao de contas)\b.{0,120}\bconsorcio",
            r"\bconsorcio\b.{0,120}\b(repasse|aporte|parcelamento|debito|prestacao de contas)\b",
        )),
        Rule("PROTOCOLO", "🟨", 6, 50, (
            r"\bprotocolo de intencoes\b",
        )),
        Rule("GOVERNANÇA", "⬛", 8, 60, (
            r"\b(alteracao|revisao|mudanca)\b.{0,100}\b(estatuto|estatutar)",
            r"\b(ratificacao|consolidacao)\b.{0,120}\balteracao\b.{0,100}\bprotocolo de intencoes",
            r"\bassembleia\b.{0,120}\bconsorcio",
            r"\beleicao\b.{0,100}\bconsorcio",
            r"\bconsorcio\b.{0,100}\b(novo presidente|nova diretoria|eleito|eleita)\b",
        )),
        Rule("ATUAÇÃO", "📰", 4, 40, (
            r"\bconsorcio\b.{0,120}\b(inaugura|lanca|investe|aprova|assina|recebe|amplia|implanta)\b",
            r"\b(inaugura|lanca|investe|aprova|assina|recebe|amplia|implanta)\b.{0,120}\bconsorcio",
        )),
    ),
    penalties=(
        Penalty(30, "adesão a ata de preços", (
            (r"\badesao (a|de|em) (a )?(ata|atas|arp)( de registro de precos)?\b", None),
        )),
        Penalty(30, "contratação/ata de preços", (
            (r"\b(ata de registro de precos|registro de precos|intencao de registro de precos|orgao nao participante)\b", None),
        )),
        Penalty(30, "carona em ata de preços", (
            (r"\bcarona\b.{0,100}\b(ata|registro de precos|arp)\b", None),
        )),
        Penalty(30, "consórcio empresarial", (
            (r"\b(consorcio de empresas|consorcio empresarial|consorcio vencedor|empresa consorciada)\b", None),
        )),
        Penalty(30, "consórcio comercial", (
            (r"\b(administradora de consorcio|cota de consorcio|consorcio imobiliario|consorcio de veiculos)\b", None),
        )),
        Penalty(12, "previsão orçamentária genérica", (
            (r"\blei orcamentaria\b.{0,500}\b(consorcios publicos|contrato de rateio)\b", None),
            (r"\breservara recursos\b.{0,350}\bcontrato de rateio\b", None),
            (r"\brateio pela participacao em consorcio publico\b", r"\b(contrato de rateio|contrato n\.?\s*\d+|celebram.{0,160}consorcio|objeto.{0,160}repasse)\b"),
        )),
        Penalty(12, "agenda sem deliberação", (
            (r"\b(convocar|convocacao|reuniao|pauta|assuntos abordados|informes gerais)\b", r"\b(lei|decreto|autoriza|ratifica|aprovou|sanciona|promulga|delibera)\b"),
        )),
    ),
)

#: The same structure over the vocabulary of the synthetic documents.
SYNTHETIC = RuleSet(
    subject=r"\b(the|der|les|los)\b",
    strong=r"\b(of the|and the|des|del)\b",
    local=r"\b(and|und|et|que)\b",
    official=(".example.org",),
    rules=(
        Rule("ALPHA", "A", 8, 100, (
            r"\b(that|this)\b.{0,60}\bthe",
            r"\bthe\b.{0,40}\b(with|from)\b",
            r"\bidiot\b",
        )),
        Rule("BETA", "B", 7, 90, (
            r"\b(und|der)\b.{0,80}\bdie",
            r"\b(das|ein)\b.{0,30}\b(der|die)\b",
        )),
        Rule("GAMMA", "C", 6, 80, (
            r"\b(que|para)\b.{0,50}\b(los|del)\b",
            r"\buna\b",
        )),
        Rule("DELTA", "D", 4, 40, (
            r"\b(les|des)\b.{0,90}\b(une|est)\b",
            r"\boutre\b.{0,20}\b[a-z]+ion",
        )),
    ),
    penalties=(
        Penalty(30, "shouting", (
            (r"!!", None),
        )),
        Penalty(12, "table without verbs", (
            (r"\|", r"\b(is|are|was|be)\b"),
        )),
    ),
)
