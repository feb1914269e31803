from datetime import datetime, timezone

import pytest

from newsloom.plans.radar import radar
from newsloom.sources import state

NOW = datetime(2026, 8, 15, tzinfo=timezone.utc)
ENTRY = "<item><title>{0}</title><link>https://a.br/{1}</link><pubDate>Fri, 14 Aug 2026 12:0{1}:00 GMT</pubDate><description>{2}</description></item>"
TEXTS = ["Lei autoriza a retirada da cidade azul do consórcio público.", "Auditoria investiga contratos verdes no consórcio público regional.", "Assembleia elege diretoria nova do consórcio intermunicipal do norte.", "Nada."]


def settings(folder, **more):
    entries = "".join(ENTRY.format(f"Notícia {i} {t.split()[0]}", i, t) for i, t in enumerate(TEXTS))
    (folder / "feed.xml").write_text(f"<rss><channel>{entries}</channel></rss>")
    (folder / "site.html").write_text('<div class="post-item"><h3 class="entry-title"><a href="/n">Retirada do consórcio público</a></h3><span class="post-date">14/08/2026</span></div>')
    return {
        "lookbackHours": 96, "stateRetentionDays": 365, "minimumScore": 5, "maxPostsPerRun": 2, "maxPostsPerDay": 72, "messageDelayMs": 0, "sendEnabled": False,
        "rssFeeds": {"enabled": True, "retries": 0, "feeds": [{"name": "F", "url": f"file://{folder}/feed.xml"}]},
        "webScrapers": {"enabled": True, "sites": [{"name": "S", "adapter": "rncp", "url": f"file://{folder}/site.html", "retries": 0}]},
    } | more


def test_preview_reports_but_saves_and_sends_nothing(spark, tmp_path):
    sent = []
    result = radar(spark, settings(tmp_path), f"file://{tmp_path}/run", NOW, sent.append, summary=str(tmp_path / "s.md"))
    assert sent == [] and result.selected.count() == 2 and state.load_history(spark, f"file://{tmp_path}/run/state").count() == 0
    text = (tmp_path / "s.md").read_text()
    assert text.startswith("## ") and "https://a.br/0" in text and "S: 1 item(ns)" in text and "| F | 4 |" in text
    assert spark.read.json(f"file://{tmp_path}/run/artifacts/candidates").count() == 2


def test_sending_saves_what_was_sent_and_goes_on_from_there(spark, tmp_path):
    sent, on = [], settings(tmp_path, sendEnabled=True)
    for n in (2, 3, 3):  # the third run has nothing left
        radar(spark, on, f"file://{tmp_path}/run", NOW, sent.append, "123@g.us", str(tmp_path / "s.md"))
        assert len(sent) == len(set(sent)) == n == state.load_history(spark, f"file://{tmp_path}/run/state").count()
    assert (tmp_path / "s.md").read_text().count("https://a.br/") == 3


def test_the_destination_is_checked_first(spark, tmp_path):
    sent, on = [], settings(tmp_path, sendEnabled=True)
    with pytest.raises(ValueError):
        radar(spark, on, f"file://{tmp_path}/run", NOW, sent.append, "123@c.us")
    with pytest.raises(ValueError):
        radar(spark, on, f"file://{tmp_path}/run", NOW, None, "123@g.us")
    assert sent == [] and not (tmp_path / "run").exists()


def test_an_error_while_sending_keeps_what_was_sent(spark, tmp_path):
    sent, on = [], settings(tmp_path, sendEnabled=True)

    def send(text):
        if sent:
            raise OSError("down")
        sent.append(text)

    with pytest.raises(OSError):
        radar(spark, on, f"file://{tmp_path}/run", NOW, send, "123@g.us")
    assert state.load_history(spark, f"file://{tmp_path}/run/state").count() == 1
    radar(spark, on, f"file://{tmp_path}/run", NOW, sent.append, "123@g.us")
    assert len(sent) == len(set(sent)) == 3
