from collections import Counter, defaultdict

from newsloom.llm import packing


def test_best_fit_takes_the_tightest_compatible_bin():
    # 6 | 5 | 3: the 3 fits both bins of 10; the tighter (residual 4) holds its cluster, so it goes to the next
    assert packing.best_fit([(6, "a", "x"), (5, "b", "y"), (3, "c", "x"), (4, "d", "z")], 10) == [(0, 0), (1, 0), (1, 5), (0, 6)]
    assert packing.best_fit([(1, "a", str(i)) for i in range(5)], 10, per_source=2) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]


def test_against_plain_search():
    import random

    rng = random.Random(5)
    pieces = sorted(((rng.randrange(1, 40), rng.choice("aaab"), rng.choice("xyzuvw")) for _ in range(400)), key=lambda p: -p[0])
    got = packing.best_fit(pieces, 50, 3)
    left, held = [], []
    for (n, s, c), (b, at) in zip(pieces, got):
        fits = [i for i in range(len(left)) if left[i] >= n and c not in held[i][1] and held[i][0][s] < 3]
        if fits:
            assert b < len(left) and b in fits and left[b] == min(left[i] for i in fits)
        else:
            assert b == len(left)
            left.append(50)
            held.append((Counter(), set()))
        assert at == 50 - left[b]
        left[b] -= n
        held[b][0][s] += 1
        held[b][1].add(c)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    rows = packing.op10_packing(spark, "/root/testdata/sf0.01").collect()
    text = {d.doc_id: " ".join((d.text or "").split()).lower() for d in docs}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.bin_id].append(r)
    assert pieces.keys() == text.keys()
    for k, own in pieces.items():
        own = sorted(own, key=lambda r: r.start)
        assert sum(r.length for r in own) == len(text[k].split())
        assert all(a.start + a.length == b.start for a, b in zip(own, own[1:]))
    for own in bins.values():
        own = sorted(own, key=lambda r: r.bin_offset)
        assert all(a.bin_offset + a.length == b.bin_offset for a, b in zip(own, own[1:]))
        assert sum(r.length for r in own) <= packing.CAPACITY
        assert len({text[r.doc_id] for r in own}) == len(own)
        assert max(Counter(r.source for r in own).values()) <= packing.PER_SOURCE


def test_odd_rows(spark):
    rows = [(None, None, None, 1), (1, "", "a", 1), (2, "a b", None, 1), (2, "a b", None, 1), (3, "w " * 5000, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, bin_id int")
    got = packing.packed(docs).collect()
    assert sum(r.bin_id is None for r in got) == 2 and sorted(r.length for r in got) == [0, 0, 2, 2, 904, 2048, 2048]
    assert len({r.bin_id for r in got if r.length == 2}) == 2
    assert packing.packed(docs.limit(0)).count() == 0
