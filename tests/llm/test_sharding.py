import zlib
from collections import defaultdict

from newsloom.llm import sharding

DATA = "/root/testdata/sf0.01"


def check(rows, texts, shards):
    """Contiguous gapless slots, right sizes, equal texts together unless large, and near-equal bytes."""
    total, by, where = sum(r.size for r in rows), defaultdict(list), defaultdict(set)
    for r in rows:
        by[r.shard].append(r)
    largest = max(r.size for r in rows)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / shards) <= 2 * (largest + total / shards / sharding.SMALL)
    for r in rows:
        where[texts[r.doc_id]].add(r.shard)
    for text, at in where.items():
        size = sum(len(text.encode()) + 16 for t in texts.values() if t == text)
        assert len(at) == 1 or size * sharding.SMALL > total // shards
    assert all(r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)


def test_whole_table(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = sharding.op5_sharding(spark, DATA).collect()
    assert len(rows) == len(texts) == len({r.doc_id for r in rows}) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert {r.shard for r in rows} <= set(range(40))
    check(rows, texts, 40)
    again = sharding.op5_sharding(spark, DATA).collect()
    assert sorted(rows, key=lambda r: r.doc_id) == sorted(again, key=lambda r: r.doc_id)


def test_hot_copies_are_cut_and_small_groups_are_not(spark):
    texts = {i: "hot text that many share" if i % 3 == 0 else f"text {i // 4}" if i % 3 == 1 else f"own {i}" for i in range(3000)}
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, shard int")
    rows = sharding.sharded(docs, 7).collect()
    check(rows, texts, 7)
    assert len({r.shard for r in rows if texts[r.doc_id].startswith("hot")}) >= 2


def test_odd_rows(spark):
    rows = [(1, None), (None, "a"), (None, "a"), (2, ""), (2, ""), (3, "ü" * 100_000)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
    assert sorted(r.size for r in got) == [16, 16, 16, 17, 17, 200_016]
    assert sharding.sharded(spark.createDataFrame([], "doc_id long, text string"), 3).count() == 0


def test_a_hot_text_without_ids_is_cut(spark):
    rows = [(None, "hot")] * 2000 + [(7, "hot")] * 2000 + [(i, f"own {i}") for i in range(2000)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 6).collect()
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(got) == 6000 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(sizes.values()) - min(sizes.values()) < sum(sizes.values()) / 6 * 0.05
