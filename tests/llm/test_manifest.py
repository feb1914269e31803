import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from newsloom.llm import manifest as M

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def plain_levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def plain_way(levels, i, fanout):
    for own in levels[:-1]:
        base = i - i % fanout
        yield "".join(own[base:i]), "".join(own[i + 1 : base + fanout])
        i //= fanout


def plain(rows, fanout=3):
    """Rows (doc_id, leaf, subroot, root, proof, folded, verified) of documents (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        other = r[:4] + (r[4] and r[4].replace("\n", ""),) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r
        by.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0), plain_leaf(r), plain_leaf(other), r[0]))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort()
        trees[s] = plain_levels([x[1] for x in by[s]], fanout)
    top = plain_levels([trees[s][-1][0] for s in names], fanout)
    for k, s in enumerate(names):
        for i, (_, leaf, node, doc_id) in enumerate(by[s]):
            way = [*plain_way(trees[s], i, fanout), *plain_way(top, k, fanout)]
            for a, b in way:
                node = H(a, node, b)
            yield doc_id, leaf, trees[s][-1][0], top[-1][0], H(*(a + b for a, b in way)), node, node == top[-1][0]


def got(docs, **how):
    without = M.leaf(*[F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in M.FIELDS])
    made = M.manifest(docs, altered=F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, without), **how)
    rows = made.checked(["_id", "_leaf"]).collect()
    return made, sorted((str(r["_id"]), r["_leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["folded_root"] == r["root"]) for r in rows)


def as_text(rows):
    return sorted((str(r[0]), *r[1:]) for r in rows)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    want = as_text(plain([tuple(r) for r in docs.collect()]))
    out = M.op13_merkle_manifest(spark, DATA)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert as_text(tuple(r) for r in out.collect()) == want
    assert {x[-1] for x in want} == {True, False}


@pytest.mark.parametrize("sizes, part, fanout", [([28, 1, 3, 400, 9], 7, 3), ([81, 82], 11, 3), ([50, 33], 4, 2), ([1] * 40, 5, 3)])
def test_trees_of_every_shape(spark, sizes, part, fanout, monkeypatch):
    monkeypatch.setattr(M, "CLIMB", 1)  # so merging takes several rounds
    rows = [(100 * g + i, f"s{g}", None if i % 5 else "de", i, f"text {i}\nof {g}") for g, n in enumerate(sizes) for i in range(n)]
    random.Random(7).shuffle(rows)
    made, found = got(spark.createDataFrame(rows, SCHEMA).repartition(3), part=part, fanout=fanout)
    assert found == as_text(plain(rows, fanout))
    # every node of every tree is recorded once, but for the leaves, which only stand as peaks
    for r in made.trees.roots().collect():
        levels = plain_levels([x[1] for x in sorted((q[0], plain_leaf(q)) for q in rows if q[1] == r["_group"])], fanout)
        kept = {(x.level, x.idx): x.digest for x in made.trees.nodes.filter(F.col("_g") == r["_g"]).collect()}
        assert {k: v for k, v in kept.items() if k[0]} == {(h, i): d for h, own in enumerate(levels) for i, d in enumerate(own) if h}
        assert all(levels[0][i] == d for (h, i), d in kept.items() if not h)


def test_paths_reopen_to_the_group_root(spark):
    rows = [(i, "a" if i % 3 else "b", "en", 1, f"t{i}") for i in range(200)]
    made = M.manifest(spark.createDataFrame(rows, SCHEMA), part=13)
    paths = M.proved(made.trees, ["_id", "_leaf"]).withColumn("root", M.reopened(F.col("_leaf"), F.col("_path")))
    assert {r["root"] for r in paths.collect()} == {r["digest"] for r in made.trees.roots().collect()} and paths.count() == 200


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "", "", 0, ""), (1, "", "", 0, ""), (1, "", "x", 0, "a\nb"), (2, None, "-", -5, "\n" * 9), (3, "ü", "é", 7, "ü\n" * 60_000), (-4, "z", None, 1, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"_leaf": F.lit("x"), "root": F.lit(1), "_id": F.lit(2)})
    assert got(docs, part=2)[1] == as_text(plain(rows))
    assert got(spark.createDataFrame([], SCHEMA))[1] == []


def test_a_hot_group_of_equal_rows_is_parted(spark):
    rows = [(5, "hot", "en", 1, "same")] * 600 + [(i, "cold", "en", 1, f"t{i}") for i in range(300)]
    made, found = got(spark.createDataFrame(rows, SCHEMA).repartition(4), part=50)
    assert found == as_text(plain(rows))
    assert max(r["count"] for r in made.trees.leaves.groupBy("_part").count().collect()) < 300


def test_mountain_range_needs_no_more_than_its_stack():
    leaves = [H(str(i)) for i in range(1000)]
    under, peaks = M.climbed(leaves, 5)
    assert len(peaks) <= 2 * 2 * M.height(1005, 3) and len(under) + len(peaks) > 1000
