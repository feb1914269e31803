from newsloom.operators.classify import NO_TEXT, classified
from newsloom.operators.rules import CONSORTIA, SYNTHETIC, java, needed, quick, re2, required

#: (item, category, score); scores worked out by hand from the rules.
CASES = [
    ({"kind": "gazette", "title": "Diário", "excerpts": ["Protocolo Urbano da cidade no município.", "O consórcio intermunicipal de saúde divulgou datas."]}, "GERAL", 4),
    ({"title": "Cidade entra", "summary": "A lei autoriza o ingresso da cidade no consórcio público regional."}, "ADESÃO", 11),
    ({"title": "Compra", "summary": "Autoriza a adesão de ata de registro de preços gerenciada por consórcio intermunicipal."}, "GERAL", 4 + 7 - 60),
    ({"title": "Consórcio público em crise", "summary": "Avaliam a dissolução do consórcio público."}, "CRISE", 5 + 8 + 1),
    ({"title": "Reunião", "summary": "Convocação para reunião sobre ratificação do protocolo de intenções do consórcio intermunicipal."}, "GERAL", 4 + 7 + 6 - 12),
    ({"title": "Obra", "summary": "O consórcio vencedor fará a obra do consórcio de empresas."}, "GERAL", 1 - 30),
    ({"kind": "news", "title": "Corte", "summary": "O tribunal de contas viu fraude no consórcio público", "source_url": "https://x.gov.br/"}, "CONTROLE", 5 + 7),
    ({"title": "Novo consórcio", "summary": "Novo consórcio assume passeio"}, "GERAL", 2),
    ({"kind": "gazette", "title": "Diário", "summary": "A lei orçamentária prevê repasse a consórcios públicos do município."}, "GERAL", None),
    ({"title": "Dissolução do consórcio público", "summary": "", "raw_text": None}, "GERAL", 0),
]


def classify(spark, items):
    kind = "n int, kind string, title string, summary string, raw_text string, excerpts array<string>, url string, source_url string"
    names = ["kind", "title", "summary", "raw_text", "excerpts", "url", "source_url"]
    rows = [(i, *[x.get(k) for k in names]) for i, x in enumerate(items)]
    return [r.classification for r in classified(spark.createDataFrame(rows, kind)).orderBy("n").collect()]


def test_cases(spark):
    for (item, category, score), got in zip(CASES, classify(spark, [c[0] for c in CASES])):
        assert got.category == category and (score is None or got.score == score), (item, got)


def test_empty_text_and_best_segment(spark):
    none, best = classify(spark, [{"title": "Dissolução do consórcio público"}, {"kind": "gazette", "title": "D", "excerpts": ["nada", "", "O município autoriza a retirada do consórcio público.", "A retirada do consórcio público pelo município."]}])
    assert (none.category, none.score, none.evidence_index, none.reasons) == ("GERAL", 0, -1, [NO_TEXT])
    assert best.category == "SAÍDA" and best.evidence_index == 1 and best.public_context and best.strong_public_context


def test_rejected_segment_hides_an_accepted_one(spark):
    got = classify(spark, [{"kind": "gazette", "title": "D", "excerpts": ["Pauta: ratificação do protocolo de intenções, cria consórcio público, adesão ao consórcio, auditoria no consórcio.", "protocolo de intenções do consórcio público"]}])[0]
    assert got.category == "GERAL" and got.evidence_index == 0


def test_limits_of_evidence(spark):
    long = "palavra " * 160 + "extinção do consórcio público no município"
    a, b = classify(spark, [{"kind": "gazette", "title": "x", "summary": long}, {"kind": "news", "title": "x", "summary": long}])
    assert a.category == "GERAL" and b.category == "CRISE"


def test_notation():
    assert java(r"\ba\b.{0,5}b") == r"(?<![A-Za-z0-9_])a(?![A-Za-z0-9_]).{0,5}b" and re2(r"\ba\b.{0,5}b") == r"\ba\b.{0,5}b"


def test_first_letters_and_needed_words():
    left, right = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
    assert quick(r"\b(ba|ca)\b.{0,5}\bd") == f"(?=[bc]){left}(ba|ca){right}.{{0,5}}(?=[d]){left}d"
    assert quick(r"\b(a )?b\b") == f"{left}(a )?b{right}" and quick(r"\b[a-z]+\b") == f"{left}[a-z]+{right}"
    assert [needed(p) for p in (r"\bab(s)?\b", r"\b(ab|cd)\b.{0,9}\befg", "abc?", "ab|cd", r"\|", "[a-z]+x")] == ["ab", "efg", "ab", "", "", "x"]


def test_needed_words_stand_in_whatever_matches():
    import re

    texts = ["consorcio", "dividas junto ao consorcio", "contrato de rateio", "contratos de rateio", "ratifica o protocolo de intencoes", "adesao a ata", "outre nation", "novo consorcio, cria um consorcio", "assembleia do consorcio", "the one with"]
    found = 0
    for rules in (CONSORTIA, SYNTHETIC):
        patterns = [rules.subject, rules.strong, rules.local, *(p for r in rules.rules for p in r.patterns), *(p for x in rules.penalties for c in x.cases for p in c if p)]
        for p in patterns:
            for t in texts:
                held = bool(re.search(java(p), t))
                assert held == bool(re.search(quick(p), t)) and (needed(p) in t or not held)
                found += held
    assert found > 10


def test_words_of_groups_are_required():
    want = {
        r"\b(that|this)\b.{0,60}\bthe": [["the"], ["that", "this"]], r"\b(the|der)\b": [["der", "the"]], r"\bab(s|t)?\b": [["ab"]], r"(ab|cd){2,3}x": [["x"]], "(a|b)|c": [], r"(a|[x-z])b": [["b"]],
        r"\b(ab(c|d)|ef)\b": [], r"\b(abc|ab|x\d+)\b": [["ab", "x"]], r"[(|]ab": [["ab"]], r"\((ab|cd)": [["ab", "cd"]], "(a.{0,9}bc|d)+": [["bc", "d"]],
    }
    assert {p: required(p) for p in want} == want


def test_required_words_stand_in_whatever_matches(spark):
    import re

    texts = ["consorcio", "dividas junto ao consorcio", "contratos de rateio", "lei 11107", "ratifica o protocolo de intencoes", "adesao a ata", "outre nation", "cria um consorcio", "that one, the with", "les une", "der die", "que por los", "a | b", "!!"]
    for rules in (CONSORTIA, SYNTHETIC):
        for p in [rules.subject, rules.strong, rules.local, *(p for r in rules.rules for p in r.patterns), *(p for x in rules.penalties for c in x.cases for p in c if p)]:
            assert all(any(w in t for w in words) for t in texts if re.search(java(p), t) for words in required(p)), p
