import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from newsloom.llm import spelling as S

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


def plain_words(docs, odd=S.ODD, shortest=S.SHORTEST, least=S.LEAST):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if odd and h % odd == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= shortest and k >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(n):
    """(word, form, root, n, n_near, form_n) by comparing every word with every other."""
    near = {w: [v for v in n if v != w and abs(len(v) - len(w)) <= 1 and one_edit(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: v if v is not None and n[v] >= 2 * n[w] else None for w, v in best.items()}
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] is not None else None))
    return sorted(out, key=str)


def got(spark, n, **how):
    return sorted((tuple(r) for r in S.variants(spark.createDataFrame(list(n.items()), "word string, n long"), **how).collect()), key=str)


def test_words_of_the_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    assert {r["word"]: r["n"] for r in S.words(docs).collect()} == plain_words([tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("letters, shortest, bucket", [("ab", 5, 100), ("abcé", 1, 10**6), ("aàbcdÿ", 3, 1000)])
def test_variants_against_all_pairs(spark, letters, shortest, bucket):
    rng = random.Random(5)
    n = {"".join(rng.choices(letters, k=rng.randint(shortest, 7))): rng.choice([3, 3, 5, 6, 12, 40]) for _ in range(500)}
    assert got(spark, n, shortest=shortest, bucket=bucket) == plain(n)


def test_forms_are_followed_to_the_root(spark):
    n = {"a" * (5 + i): 3 * 2**i for i in range(20)} | {"zebra": 10, "zebre": 4, "zebro": 4, "zebrx": 10, "other": 3}
    rows = got(spark, n)
    assert rows == plain(n)
    assert {r[2] for r in rows if r[0].startswith("a")} == {"a" * 24}


def test_equal_hashes_of_different_strings_do_not_count(spark, monkeypatch):
    n = {"".join(random.Random(i).choices("abc", k=5 + i % 2)): 3 + i for i in range(60)}
    whole = S.deletion_keys
    # keys of 2 bits: nearly all meet
    monkeypatch.setattr(S, "deletion_keys", lambda found: {k: v & np.uint64(3) if v.dtype == np.uint64 else v for k, v in whole(found).items()})
    import newsloom.llm.spelling as module

    keyed = module._keyed(1, 5)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(list(n))], ["w", "word"])
    met = S._meeting(pa.Table.from_batches(list(keyed([batch]))))
    assert met.num_rows > len(n) * 8
    monkeypatch.setattr(S, "_keyed", lambda buckets, shortest, f=keyed: _narrow(f))
    assert got(spark, n) == plain(n)


def _narrow(keyed):
    """The keys of `keyed`, all but two bits cleared, made in a worker."""
    import pyarrow as pa

    def run(batches):
        for b in keyed(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b.num_rows, np.int32)), pa.array(b.column(1).to_numpy() & 3), *b.columns[2:]], b.schema.names)

    return run


def test_hashes_of_deletions_are_those_of_what_is_left():
    found = ["abc", "é", "aabb", "x" * 300, "ba"]
    k = S.deletion_keys(found)
    rest = [w[:i] + w[i + 1 :] for w in found for i in range(len(w))]
    assert [int(x) for x in k["deleted"]] == [int(S.deletion_keys([r])["whole"][0]) if r else int(k["deleted"][3]) for r in rest]
    assert [bool(x) for x in k["first"]] == [i == 0 or w[i] != w[i - 1] for w in found for i in range(len(w))]
    assert len(set(k["gap"].tolist())) == len(k["gap"])


def test_odd_rows(spark):
    long = "q" * 30_000
    rows = [(1, None), (None, "Tres tres TRES ÉTAGE Étage étage"), (2, ""), (2, "12 — ..."), (3, "house House HOUSE horse horse horse horse horse horse hous3"), (3, f"{long} {long} {long}"), (3, f"{long}q {long}q {long}q")]
    rows += [(4, "repeat repea")] * 3
    docs = spark.createDataFrame(rows, SCHEMA)
    n = plain_words(rows)
    out = sorted((tuple(r) for r in S.variants(S.words(docs.selectExpr("*", "1 as word", "2 as n", "3 as w", "'x' as id"))).collect()), key=str)
    assert out == plain(n) and {len(r[0]) for r in out} >= {30_000, 30_001}
    assert S.variants(S.words(spark.createDataFrame([], SCHEMA))).collect() == []
