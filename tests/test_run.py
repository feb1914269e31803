from datetime import datetime, timedelta, timezone

from newsloom.operators import metrics, render
from newsloom.operators.select import allowed
from newsloom.plans.run import run, write_artifacts
from newsloom.schema import SEEN
from newsloom.sources import state

NOW = datetime(2026, 8, 14, 18, tzinfo=timezone.utc)
CONFIG = {"lookbackHours": 96, "stateRetentionDays": 365, "minimumScore": 5, "maxPostsPerRun": 3, "maxPostsPerDay": 72}
KIND = "kind string, title string, url string, source string, summary string, published_at timestamp, scraper string, preview_only boolean, item_ord long, territory_name string"


def items(spark):
    at = NOW - timedelta(hours=1)
    exits = [("news", f"Cidade {n} sai", f"https://a.br/{n}", "Jornal", f"Lei autoriza a retirada da cidade {w} do consórcio público.", at, None, False, i, None) for i, (n, w) in enumerate([("um", "azul verde preta branca roxa"), ("dois", "norte sul leste oeste centro"), ("três", "ferro prata ouro cobre zinco"), ("quatro", "lua sol mar rio vento")])]
    rest = [
        ("news", "Velha", "https://a.br/v", "Jornal", "Retirada do consórcio público.", NOW - timedelta(hours=97), None, False, 9, None), ("news", "Nada", "https://a.br/x", "", "texto sem assunto", at, "rncp", True, 10, None),
        ("news", "Prévia", "https://a.br/p", "Site", "Auditoria no consórcio público.", at, "cnm", True, 11, None), ("news", "Cidade um sai", "https://b.br/1", "Outro", "Retirada do consórcio público pela cidade.", at, None, False, 12, None),
    ]
    return spark.createDataFrame(exits + rest, KIND)


def test_run(spark, tmp_path):
    result = run(items(spark), spark.createDataFrame([], SEEN), NOW, CONFIG)
    assert [r.item_ord for r in result.selected.orderBy("item_ord").collect()] == [0, 1, 2] and [r.item_ord for r in result.previews.collect()] == [11]
    f = {r.source: r for r in result.funnel.collect()}
    assert (f["Jornal"].collected, f["Jornal"].relevant, f["Jornal"].selected) == (4, 4, 3) and f["Site"].preview_only == 1 and f["rncp"].rejected == 1
    write_artifacts(result, f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out/candidates").count() == 3
    text = spark.read.text(f"file://{tmp_path}/out/source-funnel-table", wholetext=True).first()[0]
    assert "| Jornal | 4 | 0 | 0 | 4 | 0 | 4 | 3 | 3 |" in text


def test_quota_of_the_day(spark):
    sent = [(f"i{n}", NOW - timedelta(hours=2), "u", f"t{n}", f"f{n}", ["a"], "GERAL") for n in range(71)] + [("y", NOW - timedelta(hours=20), "u", "t", "f", ["a"], "GERAL")]
    result = run(items(spark), spark.createDataFrame(sent, SEEN), NOW, CONFIG)
    assert result.sent_today == 71 and result.selected.count() == 1
    assert allowed(3, 72, 80) == 0


def test_message_of_an_act(spark):
    summary = "LEI Nº 4.497, DE 11 DE AGOSTO DE 2026. Autoriza a retirada da cidade do Consórcio Intermunicipal de Saúde – CISXYZ. A cidade permanece responsável pelas obrigações até a formalização do desligamento."
    rows = spark.createDataFrame([("gazette", "Diário", summary, "", "Fonte", datetime(2026, 8, 11, 15), "https://a.br/p.pdf", "Campo Belo", ("SAÍDA", "🟧", summary))], "kind string, title string, summary string, raw_text string, source string, published_at timestamp, url string, territory_name string, classification struct<category: string, emoji: string, evidence_text: string>")
    got = render.messages(rows).first().message.split("\n")
    assert got == [
        "🟧 *SAÍDA DE CONSÓRCIO*", "*Campo Belo autoriza saída do CISXYZ*", "", "> A Lei nº 4.497/2026 autoriza Campo Belo a se retirar do CISXYZ.", "", "*Pontos-chave*",
        "- A saída ainda depende da formalização do desligamento.", "- As obrigações assumidas permanecem até a saída ser efetivada.", "", "_📅 11 ago. 2026  ·  📰 Fonte_", "🔗 *Acesse o ato oficial (PDF):*", "https://a.br/p.pdf",
    ]


def test_message_of_news_and_reports(spark):
    rows = spark.createDataFrame([("news", "Cidade *entra*", "Frase um. Frase dois.", "Fonte", None, "https://a.br/", ("ATUAÇÃO", "📰", "Frase um. Frase dois.", 9))], "kind string, title string, summary string, source string, published_at timestamp, url string, classification struct<category: string, emoji: string, evidence_text: string, score: int>")
    got = render.messages(rows).first().message.split("\n")
    assert got[:4] == ["📰 *CONSÓRCIOS PÚBLICOS*", "*Cidade entra*", "", "> Frase um."] and got[-1] == "https://a.br/" and "data não informada" in got[5]
    assert render.run_summary(rows.withColumn("n", rows.url), "n", True).first().text == "## Notícias publicadas\n\n- 📰 **ATUAÇÃO** (9 pontos): [Cidade *entra*](https://a.br/)\n"
    flags = spark.createDataFrame([("", None, "GERAL", 0, ["rejeitado: x", "y"], False, False, False, False, True)], "source string, scraper string, category string, score int, reasons array<string>, is_relevant boolean, is_preview boolean, is_unseen boolean, is_selected boolean, is_classified boolean")
    f = metrics.funnel(flags).first()
    assert f.source == metrics.UNKNOWN_SOURCE and f.discard_reasons == {"rejeitado: x": 1} and f.rejected == 1


def test_stream_equals_batches(spark, tmp_path):
    from newsloom.streaming.microbatch import start

    rows = items(spark)
    rows.filter("item_ord < 2").write.parquet(f"{tmp_path}/in/a")
    source = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    folder = f"file://{tmp_path}/state"
    start(source, folder, f"{tmp_path}/check", CONFIG, lambda: NOW, sink=f"{tmp_path}/sent").awaitTermination()
    assert state.load_history(spark, folder).count() == 2
    rows.filter("item_ord >= 2 or item_ord = 0").write.parquet(f"{tmp_path}/in/b")
    source = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    start(source, folder, f"{tmp_path}/check", CONFIG, lambda: NOW, sink=f"{tmp_path}/sent").awaitTermination()
    assert sorted(r.item_ord for r in spark.read.parquet(f"{tmp_path}/sent").collect()) == [0, 1, 2, 3]


def test_stream_sends_each_message_once(spark, tmp_path):
    from newsloom.streaming.microbatch import start

    rows = items(spark)
    rows.write.parquet(f"{tmp_path}/in")
    folder, sent, waits, down = f"file://{tmp_path}/state", [], [], [True]

    def send(text):
        if len(sent) == 2 and down:
            down.pop()
            raise OSError("down")
        sent.append(text)

    for _ in range(2):
        source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        query = start(source, folder, f"{tmp_path}/check", CONFIG, lambda: NOW, send=send, delay=0.01)
        try:
            query.awaitTermination()
        except Exception:  # the first run ends at the third message
            pass
    assert len(sent) == 4 == len(set(sent)) or len(sent) == 5 == len(set(sent))
    assert state.load_history(spark, folder).count() == len(sent)


def test_reports_of_sites_and_summary_file(spark, tmp_path):
    from newsloom.plans.run import append_summary

    rows = spark.createDataFrame([("a", "ok", 2, None, 0, 0), ("b", "error", 0, "m", 0, 1), ("c", "disabled", 0, "x", -1, 0)], "name string, status string, item_count long, message string, part int, place int")
    none = spark.createDataFrame([], "title string, url string, n int, classification struct<category: string, emoji: string, score: int>")
    text = render.preview_summary(none, "n", 3, rows)
    assert text.first().text.split("\n")[2:] == ["3 item(ns) observado(s); nenhum deles foi enviado automaticamente.", "", "- ℹ️ c: chamada direta desativada — x.", "- ✅ a: 2 item(ns) dentro da janela.", "- ⚠️ b: falha isolada — m", "", render.NO_CANDIDATE, ""]
    append_summary(None, text)
    append_summary(str(tmp_path / "s.md"), text)
    append_summary(str(tmp_path / "s.md"), text)
    assert (tmp_path / "s.md").read_text() == text.first().text * 2


def test_rank_prefix_equals_the_whole_pass(spark):
    from pyspark.sql import functions as F

    from newsloom.operators import dedupe

    rows = [(i, f"https://a.br/{i}", f"title {i % 23}", f"common words here {i % 31} alpha beta gamma", "AB"[i % 2]) for i in range(300)]
    frame = spark.createDataFrame(rows, "n int, url string, title string, summary string, category string")
    history = spark.createDataFrame([], SEEN)
    whole = [r.n for r in dedupe.select_unseen(frame, history, [F.col("n")]).orderBy("n").collect()]
    for most in (0, 1, 5, 1000):
        assert [r.n for r in dedupe.first_unseen(frame, history, [F.col("n")], most, begin=1).orderBy("n").collect()] == whole[:most]
    assert [r.n for r in dedupe.first_unseen(frame, history, [F.col("n")], 5, whole=2).orderBy("n").collect()] == whole[:5]


def test_a_batch_that_is_repeated_puts_nothing_twice(spark, tmp_path):
    import os

    from newsloom.streaming.microbatch import add_to_sink, start

    rows = items(spark)
    rows.write.parquet(f"{tmp_path}/in")
    for again in range(2):
        source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        start(source, f"file://{tmp_path}/state", f"{tmp_path}/check", CONFIG, lambda: NOW, sink=f"{tmp_path}/sent").awaitTermination()
        # without its commit the batch counts as not ended
        for name in ("0", ".0.crc") if not again else ():
            if os.path.exists(f"{tmp_path}/check/commits/{name}"):
                os.remove(f"{tmp_path}/check/commits/{name}")
    assert sorted(r.item_ord for r in spark.read.parquet(f"{tmp_path}/sent").collect()) == [0, 1, 2]
    assert state.load_history(spark, f"file://{tmp_path}/state").count() == 3
    # a try that died after it had put some rows
    add_to_sink(spark.createDataFrame([("a", 1)], "id string, v int"), f"{tmp_path}/other", 7)
    add_to_sink(spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int"), f"{tmp_path}/other", 7)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/other").collect()) == [("a", 1, 7), ("b", 2, 7)]
