import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from newsloom.operators import dedupe
from newsloom.sources import state


def greedy(rows, least=0.66):
    kept = []
    for r in rows:
        t = set(r[3])
        for k in kept:
            u = set(k[3])
            if k[2] == r[2] or (k[1] == r[1] and len(u) >= 4 and t and len(t & u) / len(t | u) >= least):
                break
        else:
            kept.append(r)
    return [r[0] for r in kept]


def test_rounds_equal_the_greedy_pass(spark):
    for seed in range(3):
        rng = random.Random(seed)
        words = [f"w{i}" for i in range(12)]
        rows = []
        for i in range(250):
            base = rng.choice(rows)[3] if rows and rng.random() < 0.6 else rng.sample(words, rng.randrange(0, 9))
            t = sorted({w for w in base if rng.random() < 0.9} | set(rng.sample(words, rng.randrange(0, 2))))
            rows.append((i, rng.choice(["A", "B", None]), f"f{rng.randrange(120)}", t))
        frame = spark.createDataFrame(rows, "n int, category string, title_fingerprint string, content_tokens array<string>")
        got = sorted(r.n for r in dedupe.first_of_each_event(frame, [F.col("n")]).collect())
        assert got == greedy(rows)


def test_dropped_item_does_not_shadow(spark):
    rows = [(1, "A", "f1", list("abcd")), (2, "A", "f2", list("abcd")), (3, "B", "f2", list("wxyz"))]
    frame = spark.createDataFrame(rows, "n int, category string, title_fingerprint string, content_tokens array<string>")
    assert sorted(r.n for r in dedupe.first_of_each_event(frame, [F.col("n")]).collect()) == [1, 3]


def test_history_and_unseen(spark):
    now = datetime(2026, 8, 14, tzinfo=timezone.utc)
    kind = "n int, url string, title string, summary string, category string"
    sent = spark.createDataFrame([(0, "https://a.br/1", "Campo Belo deixa de grupo", "lei aprovada ontem retira cidade alto rio grande", "SAÍDA"), (9, "https://a.br/9", "três só", "", "SAÍDA")], kind)
    history = state.seen_records(dedupe.with_keys(sent), now)
    items = [
        (1, "https://a.br/1?utm_source=x", "Campo Belo deixa de grupo", "outra", "CRISE"), (2, "https://b.br/2", "CAMPO BELO deixa do grupo", "outra coisa", "CRISE"),
        (3, "https://c.br/3", "Deixa grupo campo belo", "lei aprovada ontem retira cidade alto rio grande", "SAÍDA"), (4, "https://c.br/4", "Deixa grupo campo belo hoje", "lei aprovada ontem retira cidade alto rio grande", "CRISE"),
        (5, "https://d.br/5", "só três", "", "SAÍDA"),
    ]
    got = dedupe.select_unseen(spark.createDataFrame(items, kind), history, [F.col("n")])
    assert sorted(r.n for r in got.collect()) == [4, 5]
    assert sorted(r.n for r in dedupe.select_unseen(spark.createDataFrame(items, kind), history.limit(0), [F.col("n")]).collect()) == [1, 3, 4, 5]
    assert dedupe.select_unseen(spark.createDataFrame([], kind), history, [F.col("n")]).count() == 0


def test_a_long_chain_in_rounds_writes_each_item_once(spark, monkeypatch):
    # each set resembles only its neighbours: every second one stays
    rows = [(i, "A", f"f{i}", [f"w{j:03d}" for j in range(i, i + 10)]) for i in range(6)]
    frame = spark.createDataFrame(rows, "n int, category string, title_fingerprint string, content_tokens array<string>")
    counts, whole = [], dedupe.written
    # what is written with a state are decisions

    def counted(df):
        out = whole(df)
        if "_state" in df.columns:
            counts.append(out.count())
        return out

    monkeypatch.setattr(dedupe, "written", counted)
    want = greedy(rows)
    assert sorted(r.n for r in dedupe.first_of_each_event(frame, [F.col("n")], few=0).collect()) == want
    assert sum(counts) == len(rows) and len(counts) > 2
    counts.clear()
    chain = [(i, "A", f"f{i}", [f"w{j:04d}" for j in range(i, i + 10)]) for i in range(500)]
    frame = spark.createDataFrame(chain, "n int, category string, title_fingerprint string, content_tokens array<string>")
    assert sorted(r.n for r in dedupe.first_of_each_event(frame, [F.col("n")]).collect()) == greedy(chain) and not counts


def test_rounds_alone_equal_the_greedy_pass(spark):
    rng = random.Random(9)
    rows = []
    for i in range(40):
        base = rng.choice(rows)[3] if rows and rng.random() < 0.7 else rng.sample([f"w{i}" for i in range(12)], rng.randrange(0, 9))
        rows.append((i, rng.choice(["A", None]), f"f{rng.randrange(25)}" if i % 9 else None, sorted({w for w in base if rng.random() < 0.9})))
    frame = spark.createDataFrame(rows, "n int, category string, title_fingerprint string, content_tokens array<string>")
    plain = [(n, c, f"own{n}" if f is None else f, t) for n, c, f, t in rows]
    for few in (8, 10_000):
        assert sorted(r.n for r in dedupe.first_of_each_event(frame, [F.col("n")], few=few).collect()) == greedy(plain)
    assert dedupe.first_of_each_event(frame.limit(0), [F.col("n")]).count() == 0


def _random_sets(rng, n, words, most):
    sets = []
    for _ in range(n):
        base = rng.choice(sets) if sets and rng.random() < 0.5 else rng.sample(words, rng.randrange(1, most))
        sets.append(sorted({w for w in base if rng.random() < 0.9} | set(rng.sample(words, rng.randrange(0, 2)))))
    return sets


@pytest.mark.parametrize("frequent", [0, 5, 1000])
@pytest.mark.parametrize("least", [0.4, 0.66])
def test_the_join_equals_brute_force_however_frequent_tokens_are(spark, frequent, least):
    rng = random.Random(frequent)
    rows = [(i, rng.choice(["A", "B", None]), t) for i, t in enumerate(_random_sets(rng, 200, [f"w{i}" for i in range(60)], 14))]
    frame = spark.createDataFrame(rows, "key long, category string, tokens array<string>")
    near = {(a, b) for a, c, s in rows for b, d, t in rows if a != b and c == d and s and t and len(set(s) & set(t)) / len(set(s) | set(t)) >= least}
    want = {(a, b) for a, b in near if len(rows[b][2]) >= 4}
    got = [(r.a_key, r.b_key) for r in dedupe.similar_sets(frame, least=least, smallest=4, frequent=frequent).collect()]
    assert want and sorted(got) == sorted(want)
    got = [(r.a_key, r.b_key) for r in dedupe.similar_sets(frame.filter("key % 3 = 0"), frame.filter("key % 3 > 0"), least, frequent=frequent).collect()]
    assert sorted(got) == sorted((a, b) for a, b in near if a % 3 == 0 and b % 3 > 0)


def test_unlike_sets_of_frequent_tokens_hardly_become_candidates(spark):
    rng = random.Random(1)
    rows = [(i, "A", rng.sample([f"w{i}" for i in range(500)], 60)) for i in range(1000)]
    sets = spark.createDataFrame(rows, "n long, category string, tokens array<string>")
    keys = dedupe.prefixes(sets, dedupe.token_order(sets), 0.66, 50)
    # every token is in about 120 sets, so single tokens without parity bits make over 100 candidates a set
    on = dedupe.may_be_similar(0.66) & (F.col("a_n") < F.col("b_n"))
    assert dedupe.named(keys, "a_").join(dedupe.named(keys, "b_"), on).select("a_n", "b_n").distinct().count() < 100
