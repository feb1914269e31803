import re
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline as p
from newsloom.llm import quality_knn
from newsloom.llm.simhash import fingerprint
from tests.llm.test_substring import brute as passages

DATA = "/root/testdata/sf0.001"


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def first_of_group(texts, ids):
    """Smallest id that each text reaches over links of the stage's fingerprints."""
    fps = np.array([fingerprint((t or "").encode(), 5, prints=2) for t in texts])
    near = (np.bitwise_count((fps[:, None] ^ fps[None]).view(np.uint64)) <= 6).any(2)
    root = np.array(ids)
    while True:
        new = np.array([root[near[i]].min() for i in range(len(ids))])
        if (new == root).all():
            return root.tolist()
        root = new


def test_each_stage_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    steps, frames = dict(p.STAGES), [docs]
    for name in list(steps)[:-1]:
        frames.append(p.written(steps[name](spark, frames[-1], DATA)))
        assert frames[-1].columns == docs.columns and frames[-1].dtypes == docs.dtypes
    whole, good, unlike, cut = (rows_of(f) for f in frames[:4])
    predicted = {r.doc_id: r.predicted for r in quality_knn.op8_quality_knn(spark, DATA).collect()}
    assert good == {k: r for k, r in whole.items() if predicted[k]} and 0 < len(good) < len(whole)
    ids = sorted(good)
    first = first_of_group([good[k].text for k in ids], ids)
    assert unlike == {k: good[k] for k in set(first)} and len(unlike) < len(good)
    ids = sorted(unlike)
    want = dict(zip(ids, passages([(k, unlike[k].text) for k in ids], 13)))
    import hashlib

    for k, r in cut.items():
        kept = " ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert hashlib.sha256(kept.encode()).hexdigest() == want[k][2] and r.n_chars == len(r.text)
        if not want[k][1]:
            assert r.text == unlike[k].text
    assert cut.keys() == unlike.keys()
    mixed = Counter(r.doc_id for r in frames[4].collect())
    assert set(mixed) <= set(cut) and max(mixed.values()) <= 3
    pieces = defaultdict(list)
    for r in steps["packing"](spark, frames[4], DATA).collect():
        pieces[r.doc_id].append(r)
    assert pieces.keys() == mixed.keys()
    for k, own in pieces.items():
        assert sum(r.length for r in own) == mixed[k] * len(cut[k].text.split())


def test_run_is_the_stages(spark):
    out = p.run(spark, DATA)
    assert out.count() > 0 and "bin_id" in out.columns
    assert [n for n, _ in p.STAGES] == ["quality classifier", "near-duplicates", "substring dedup", "mixing", "packing"] and p.ORACLE_SQL is None


def test_one_of_each_with_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, "a b c d e f", "en", "s", 1), (None, "q r s t u v", "en", "s", 1), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id or 0 for r in p.one_of_each(spark, docs, DATA).collect()) == [0, 1, 3]


def test_one_of_each_decides_rows_and_not_ids(spark):
    def kept(*rows):
        docs = spark.createDataFrame([(k, t, lang, "s", 1) for k, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
        return sorted((r.doc_id or 0, r.text, r.lang) for r in p.one_of_each(spark, docs.repartition(3), DATA).collect())

    one, two, three = "a b c d e f", "q r s t u v", "g h i j k l m n"
    # a group without any id keeps one row; a nameless copy of a named text goes
    assert kept((None, two, "en"), (None, two, "en"), (None, two, "en"), (None, one, "en"), (7, one, "en")) == [(0, two, "en"), (7, one, "en")]
    # two texts under one id are two documents
    assert kept((1, one, "en"), (1, two, "en"), (1, two, "en")) == [(1, one, "en"), (1, two, "en")]
    # of an id's rows only the copy of a smaller id goes
    assert kept((1, one, "en"), (5, one, "en"), (5, three, "en")) == [(1, one, "en"), (5, three, "en")]
    # rows that differ in other columns only: one stays, always the same
    assert len(kept((1, one, "de"), (1, one, "en"))) == 1 and kept((1, one, "de"), (1, one, "en")) == kept((1, one, "en"), (1, one, "de"))


def tables(spark, folder, rows, labels, columns):
    spark.createDataFrame(rows, columns).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return f"file://{folder}"


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_whole_run_over_odd_rows(spark, tmp_path):
    words = [f"w{i}" for i in range(900)]
    rng = np.random.default_rng(1)
    text = lambda n: " ".join(rng.choice(words, n))
    rows = [(i, text(40), "en", "ab"[i % 2], 1) for i in range(60)]
    rows += [rows[5], rows[5], (70, rows[5][1], "en", "a", 1), (None, rows[6][1], None, None, None), (None, None, None, None, None), (71, "", "en", "a", 0), (72, text(120_000), "de", None, 9)]
    more = [(*r, f"x{i}", i, float(i)) for i, r in enumerate(rows)]
    folder = tables(spark, tmp_path, more, [(i, 1, 0) for i in range(60)], COLUMNS + ", score string, _row int, copies double")
    frames = [spark.read.parquet(f"{folder}/documents.parquet")]
    for _, stage in p.STAGES[:-1]:
        frames.append(p.written(stage(spark, frames[-1], folder)))
        assert frames[-1].dtypes == frames[0].dtypes
    whole = {(r.doc_id, r.text): r for r in frames[0].collect()}
    for r in frames[2].collect():  # extra columns are those of the row
        assert (r.score, r._row) in {(x.score, x._row) for x in frames[0].collect() if (x.doc_id, x.text) == (r.doc_id, r.text)}
    kept = [(r.doc_id, r.text) for r in frames[2].collect()]
    assert kept.count((5, rows[5][1])) == 1 and not any(k == 70 for k, _ in kept) and set(kept) <= set(whole)
    got = p.run(spark, folder).collect()
    assert {r.doc_id for r in got} >= {72} and sum(r.length for r in got if r.doc_id == 72) % 120_000 == 0
    assert sorted(map(tuple, got)) == sorted(map(tuple, p.run(spark, folder).collect()))


def test_empty_tables_and_few_columns(spark, tmp_path):
    folder = tables(spark, tmp_path, [], [], COLUMNS)
    assert p.run(spark, folder).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n"), (2, "x a b c d e f g h i j k l m n")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in p.passages(spark, docs, folder).collect()} == {1: "a b c d e f g h i j k l m n", 2: "x"}
