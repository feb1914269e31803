import unicodedata
from datetime import datetime, timezone

from pyspark.sql import functions as F

from newsloom.functions import dates, similarity, text, urls


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1)]).select(column).first()[0]


def test_whitespace_and_folding(spark):
    assert one(spark, text.whitespace(F.col("x")), x="<p>A&nbsp;&amp; B</p>\t\n&quot;c&#39;  d  &lt;") == "A & B \"c' d &lt;"
    assert one(spark, text.whitespace(F.lit(None).cast("string"))) == ""
    assert one(spark, text.for_match(F.col("x")), x="Município  É Açãó ÑÜ") == "municipio e acao nu"
    codes = [c for c in range(0x20, 0x2000) if not 0xD800 <= c < 0xE000 and chr(c) not in "<>&"]
    rows = spark.createDataFrame([(c, chr(c)) for c in codes], "c int, x string").select("c", text.unaccented(F.col("x")).alias("y")).collect()
    plain = lambda x: "".join(y for y in unicodedata.normalize("NFD", x) if not "̀" <= y <= "ͯ").lower()
    odd = {r.c for r in rows if r.y != plain(chr(r.c)) and len(plain(chr(r.c))) == 1}
    assert len(odd) <= 5


def test_short_and_inline(spark):
    assert one(spark, text.shortened(F.col("x"), 6), x="abc defgh") == "abc d…" and one(spark, text.shortened(F.col("x"), 9), x="abc defgh") == "abc defgh"
    assert one(spark, text.inline(F.col("x")), x=" *a*\n_b_ `~c ") == "a b c"
    assert one(spark, text.filled(F.lit(""), F.lit(None), F.lit("x"))) == "x" and one(spark, text.filled(F.lit(""))) == ""


def test_canonical_urls(spark):
    cases = {
        "https://Example.GOV.br/n?id=1&utm_source=x#top": "https://example.gov.br/n?id=1", "http://a.br:80": "http://a.br/", "https://a.br:443/x?FBCLID=1": "https://a.br/x", "https://a.br/x?a=1&&b=": "https://a.br/x?a=1&&b=",
        "https://a.br?utm_=1&ref=2": "https://a.br/?utm_=1", "not a url": "not a url", "": "",
    }
    rows = spark.createDataFrame(list(cases.items()), "x string, want string").select("x", "want", urls.canonical(F.col("x")).alias("a"), urls.canonical_strict(F.col("x")).alias("b")).collect()
    for r in rows:
        assert r.a == r.want and r.b == r.want, r


def test_hosts_and_ids(spark):
    assert [one(spark, urls.is_official(F.lit(u))) for u in ("https://www.tce.mg.gov.br/n", "https://x.leg.br", "https://gov.br.example.com", "%%", None)] == [True, True, False, False, False]
    same = [one(spark, urls.item_id(F.lit(u), F.lit(t))) for u, t in (("https://a.br/x?ref=1", "Ação  NOVA"), ("https://A.br/x", "acao nova"))]
    assert same[0] == same[1] and len(same[0]) == 64
    rows = spark.createDataFrame([("/x", "https://a.br/y"), ("z", "https://a.br/y/"), (None, "https://a.br")], "a string, b string").select(urls.absolute(F.col("a"), F.col("b")).alias("u")).collect()
    assert [r.u for r in rows] == ["https://a.br/x", "https://a.br/y/z", "https://a.br"]


def test_dates(spark):
    at = datetime(2026, 8, 14, 15)
    shown = one(spark, F.date_format(dates.instant(F.lit("Fri, 14 Aug 2026 12:00:00 -0300")), "yyyy-MM-dd HH:mm"))
    assert shown == at.strftime("%Y-%m-%d %H:%M")
    for x in ("2026-08-14T12:00:00-03:00", "Fri, 14 Aug 2026 15:00:00 GMT"):
        assert one(spark, F.date_format(dates.instant(F.lit(x)), "yyyy-MM-dd HH:mm")) == shown
    assert one(spark, dates.instant(F.lit("soon"))) is None
    assert one(spark, F.date_format(dates.day_first(F.lit("em 14/8/2026, às")), "yyyy-MM-dd HH:mm")) == shown
    assert one(spark, dates.day_first(F.lit("31/02/2026"))) is None and one(spark, dates.day_first(F.lit("-"))) is None
    assert one(spark, dates.spelled(F.to_timestamp(F.lit("2026-08-14 15:00:00")))) == "14 ago. 2026" and one(spark, dates.spelled(F.lit(None).cast("timestamp"))) == dates.UNKNOWN
    assert str(one(spark, dates.local_day(F.to_timestamp(F.lit("2026-08-14 02:00:00"))))) == "2026-08-13"
    assert datetime.now(timezone.utc)


def test_similarity(spark):
    assert one(spark, similarity.tokens(F.lit("Cidade de Belo"), F.lit("sai do consórcio; cidade um 12 345"))) == ["345", "belo", "cidade", "sai"]
    a = F.array(*[F.lit(x) for x in "abc"])
    assert one(spark, similarity.jaccard(a, F.array(F.lit("b"), F.lit("c"), F.lit("d")))) == 0.5
    assert one(spark, similarity.jaccard(a, F.array().cast("array<string>"))) == 0.0 and one(spark, similarity.jaccard(a, F.lit(None).cast("array<string>"))) == 0.0
    assert one(spark, similarity.title_fingerprint(F.lit("Saída do grupo"))) == one(spark, similarity.title_fingerprint(F.lit("saida da Grupo")))


def test_white_space_as_one_pattern_finds_it(spark):
    import re

    space = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2005\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
    marks = [*space, "  ", " \n", "\n ", "\u00a0 ", " \u3000", "\n\n", "\u200b", "\u0085", "\x1c", "–", "é", "e\u0301", "😀", "<b>", "<", ">", "&nbsp;", "&AMP;nbsp;", "&amp;lt;", "&#39;", "&apos;", "&QUOT;", ""]
    texts = [a + x + m + y + b for m in marks for x, y in (("", ""), ("a", "b"), ("é ", " b")) for a, b in (("", ""), (" ", "\n"))] + [None]

    def plain(t):
        t = re.sub("<[^>]*>", " ", t or "")
        for p, m in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;|&apos;", "'")):
            t = re.sub(p, m, t, flags=re.I)
        return re.sub(f"[{space}]+", " ", t).strip(" ")

    got = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", text.whitespace(F.col("t")), text.for_match(F.col("t"))).orderBy("n").collect()
    assert [r[1] for r in got] == [plain(t) for t in texts]
    assert all(r[2] == plain(t).lower().replace("é", "e").replace("e\u0301", "e") for r, t in zip(got, texts))


def test_texts_without_tags_and_marks_are_not_searched_by_patterns(spark):
    plan = spark.createDataFrame([("a b",)], "t string").select(text.whitespace(F.col("t")))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert 0 < plan.count("regexp_replace") <= plan.count("case when") and plan.count("contains(") >= 2
