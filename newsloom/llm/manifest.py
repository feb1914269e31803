"""Merkle manifest of a table: one tree a group, one tree above the groups' roots, and a proof for every row.

A row's leaf is the SHA-256 of its fields, each with its length. Leaves of a group stand in the order of their ids; every FANOUT consecutive
nodes become one, a last run of fewer stays short and is never padded. Leaves are dealt to contiguous partitions, of which each knows the index
of its first leaf. There a mountain range is kept as a stack: a leaf is pushed, and while the top FANOUT nodes are the children of one
parent they are carried into it, so the stack holds only peaks, some FANOUT a level. What the edges of partitions leave open is merged in
rounds over aligned blocks of the index, CLIMB levels a round; there also the short last runs close. A proof needs of other partitions only
peaks and merged nodes, a few a level; all other siblings are climbed again where the leaf is.

Null fields count as "-". Null id: first in its group, never altered by `altered`. Null group: a group of its own, before all others, other
than the empty text. Repeated ids stand in the order of their leaves; wholly repeated rows are leaves of their own with proofs of their own. Empty and
very long texts are fields like any other, read once. Empty table: no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_sql, small_enough, table, written

FANOUT = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Leaves of a partition, on average; a task holds one partition's digests.
PART = 250_000
#: Levels that one round of merging climbs: FANOUT ** CLIMB partitions a block.
CLIMB = 6
#: Groups and partitions whose few columns are broadcast at most.
FEW = 100_000
#: Siblings before and after, level by level.
WAYS = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
NODES = "_g long, _n long, level int, idx long, digest string, peak boolean"


def field(value: Column) -> Column:
    """A value with its UTF-8 length; "-" for null."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def digest(parts) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def width(n: int, level: int, fanout: int) -> int:
    """Nodes of a level of a tree with n leaves."""
    return -(-n // fanout**level)


def height(n: int, fanout: int) -> int:
    level = 0
    while width(n, level, fanout) > 1:
        level += 1
    return level


def climbed(leaves: list[str], start: int, fanout: int = FANOUT) -> tuple[list, list]:
    """Nodes (level, index, digest) of the leaves from index `start` on: those that a parent has taken up, and the peaks left on the stack."""
    under, stack = [], []
    for i, d in enumerate(leaves, start):
        stack.append((0, i, d))
        while True:
            level, at, _ = stack[-1]
            if at % fanout != fanout - 1 or len(stack) < fanout or stack[-fanout][:2] != (level, at - fanout + 1):
                break
            run = stack[-fanout:]
            del stack[-fanout:]
            under += run
            stack.append((level + 1, at // fanout, digest(x[2] for x in run)))
    return under, stack


def closed(nodes: list[tuple], n: int, top: int, fanout: int = FANOUT) -> list[tuple]:
    """The nodes above `nodes`, which cover an aligned block of a tree with n leaves, up to level `top` or the root; short last runs close."""
    levels, made = {}, []
    for level, i, d in nodes:
        levels.setdefault(level, {})[i] = d
    for level in range(top):
        own = levels.get(level, {})
        if width(n, level, fanout) == 1:
            break
        for parent in sorted({i // fanout for i in own}):
            run = [own[i] for i in range(parent * fanout, min(parent * fanout + fanout, width(n, level, fanout)))]
            made.append((level + 1, parent, digest(run)))
            levels.setdefault(level + 1, {})[parent] = made[-1][2]
    return made


@dataclass
class Forest:
    """leaves: id, _leaf, other columns, _part, _at. runs: a group's leaves in a partition (_part, _first, _len, _start), its name, number _g and size _n.
    edges: peaks and merged nodes; nodes: these and the inner ones. All are written tables."""

    leaves: DataFrame
    runs: DataFrame
    edges: DataFrame
    nodes: DataFrame
    fanout: int

    def roots(self) -> DataFrame:
        """_group, _g, _n, digest: one row a group."""
        last = self.edges.filter(F.expr("idx = 0") & (F.ceil(F.col("_n") / F.pow(F.lit(float(self.fanout)), "level")) == 1))
        names = self.runs.filter("_start = 0").select("_group", "_g")
        return names.join(last.select("_g", "_n", "digest"), "_g")


def forest(rows: DataFrame, order: list[str], part: int = PART, fanout: int = FANOUT) -> Forest:
    """Trees over rows (a written table: _group, _leaf and more), each group's leaves in the total order `order`."""
    spark, n = rows.sparkSession, rows.count()
    parts = max(-(-n // part), min(spark.sparkContext.defaultParallelism, -(-n // 1000)), 1)
    ranged = rows.repartitionByRange(parts, "_group", *order).sortWithinPartitions("_group", *order).withColumn("_at", F.monotonically_increasing_id())
    leaves = written(ranged.withColumn("_part", F.shiftright("_at", 33)))
    runs = leaves.groupBy("_part", "_group").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_len"))
    # a group has at most one run a partition
    own = Window.partitionBy("_group")
    before = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = written(runs.withColumns({"_start": F.coalesce(F.sum("_len").over(before), F.lit(0)), "_n": F.sum("_len").over(own), "_g": F.min("_first").over(own)}))
    schema = pa.schema([("_g", pa.int64()), ("_n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("peak", pa.bool_())])

    def climb(leaves: pa.Table, runs: pa.Table) -> pa.Table:
        digests, at, out = leaves.sort_by("_at").column("_leaf").to_pylist(), 0, []
        for run in runs.sort_by("_first").to_pylist():
            under, peaks = climbed(digests[at : at + run["_len"]], run["_start"], fanout)
            # leaves that a parent has taken up are in the table of leaves
            out += [(run["_g"], run["_n"], *x, False) for x in under if x[0]] + [(run["_g"], run["_n"], *x, True) for x in peaks]
            at += run["_len"]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 6, schema)], schema=schema)

    nodes = written(leaves.select("_part", "_at", "_leaf").groupBy("_part").cogroup(runs.groupBy("_part")).applyInArrow(climb, NODES))
    largest = height(runs.agg(F.max("_n")).first()[0] or 0, fanout)
    edges = open_ = nodes.filter("peak")
    top = height(part, fanout)
    while True:
        top += CLIMB

        def close(key: tuple, block: pa.Table) -> pa.Table:
            g, n = key[0].as_py(), block.column("_n")[0].as_py()
            own = list(zip(*(block.column(c).to_pylist() for c in ("level", "idx", "digest"))))
            out = [(g, n, *x, False) for x in closed(own, n, top, fanout)]
            return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 6, schema)], schema=schema)

        low = open_.filter(F.col("level") < top).withColumn("_block", F.floor(F.col("idx") / F.pow(F.lit(float(fanout)), F.lit(top) - F.col("level"))))
        made = written(low.groupBy("_g", "_block").applyInArrow(close, NODES))
        edges, nodes = edges.unionByName(made), nodes.unionByName(made)
        if top >= largest:
            return Forest(leaves, runs, edges, nodes, fanout)
        open_ = open_.filter(F.col("level") >= top).unionByName(made.filter(F.col("level") == top))


def _asked(fanout: int):
    """Of every run, the siblings on its leaves' way to the root that its own leaves do not give: (_part, _first, _g, level, idx)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                low, end = r["_start"], r["_start"] + r["_len"]  # what is complete at the level
                for level in range(height(r["_n"], fanout)):
                    size = fanout**level
                    first, last = r["_start"] // size, (r["_start"] + r["_len"] - 1) // size
                    wanted = range(first - first % fanout, min(width(r["_n"], level, fanout), last - last % fanout + fanout))
                    out += [(r["_part"], r["_first"], r["_g"], level, i) for i in wanted if not low <= i < end]
                    low, end = -(-low // fanout), end // fanout
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, [pa.int64()] * 3 + [pa.int32(), pa.int64()])], ["_part", "_first", "_g", "level", "idx"])

    return run


def ways(digests: list[str], run: dict, fanout: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf of a run, level by level, the joined siblings before and after the node that holds it. The list is changed in place."""
    widths = [width(run["_n"], level, fanout) for level in range(height(run["_n"], fanout))]
    levels = [{} for _ in widths]
    under, peaks = climbed(digests, run["_start"], fanout)
    for level, i, d in [*under, *peaks, *((x["level"], x["idx"], x["digest"]) for x in run["outer"] or [])]:
        if level < len(levels):
            levels[level][i] = d
    way = [None] * len(levels)
    for i in range(run["_start"], run["_start"] + len(digests)):
        at = i
        for level, own in enumerate(levels):
            base = at - at % fanout
            way[level] = "".join([own[j] for j in range(base, at)]), "".join([own[j] for j in range(at + 1, min(base + fanout, widths[level]))])
            # the node above is another one only after a last child
            if at % fanout and i > run["_start"]:
                break
            at //= fanout
        yield way


def _walk(trees: Forest, keep: list[str], above: DataFrame | None, made: str, each) -> DataFrame:
    """Columns `made` of every leaf: each(digest, other, way, run) makes their values. above: _g and what `run` holds further of a group."""
    fanout = trees.fanout
    asked = trees.runs.select("_part", "_first", "_g", "_len", "_start", "_n").mapInArrow(_asked(fanout), "_part long, _first long, _g long, level int, idx long")
    outer = asked.join(trees.edges.select("_g", "level", "idx", "digest"), ["_g", "level", "idx"]).groupBy("_first").agg(F.collect_list(F.struct("level", "idx", "digest")).alias("outer"))
    runs = trees.runs.drop("_group").join(outer, "_first", "left")
    if above is not None:
        runs = runs.join(small_enough(above, FEW), "_g")
    rows = trees.leaves.select(*dict.fromkeys(["_part", "_at", "_leaf", "_other", *keep]))
    names, fields = [c.split()[0] for c in made.split(", ")], [f"{c} {t}" for c, t in rows.select(*keep).dtypes]
    kinds = {"string": pa.string(), "ways": WAYS}

    def walk(leaves: pa.Table, runs: pa.Table) -> pa.Table:
        leaves, at, out = leaves.sort_by("_at"), 0, []
        digests, others = leaves.column("_leaf").to_pylist(), leaves.column("_other").to_pylist()
        for run in runs.sort_by("_first").to_pylist():
            out += [each(digests[k], others[k], way, run) for k, way in enumerate(ways(digests[at : at + run["_len"]], run, fanout), at)]
            at += run["_len"]
        columns = [pa.array(c, kinds[f.split()[1]]) for c, f in zip(zip(*out), made.split(", "))]
        return pa.Table.from_arrays([*(leaves.column(c) for c in keep), *columns], [*keep, *names])

    schema = ", ".join(fields + made.split(", ")).replace(" ways", " array<struct<before:string,after:string>>")
    return rows.groupBy("_part").cogroup(runs.groupBy("_part")).applyInArrow(walk, schema)


def proved(trees: Forest, keep: list[str]) -> DataFrame:
    """keep and _path (siblings before and after, leaf level first, up to the group's root) of every leaf."""
    return _walk(trees, keep, None, "_path ways", lambda own, other, way, run: ([{"before": a, "after": b} for a, b in way],))


def _fold(own: str, other: str | None, way: list, run: dict) -> tuple:
    way = way + [(x["before"], x["after"]) for x in run["_path"]]
    node = other or own
    for a, b in way:
        node = sha256((a + node + b).encode()).hexdigest()
    return digest([a + b for a, b in way]), node, run["subroot"], run["root"]


def reopened(node: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, node, lambda d, x: F.sha2(F.concat(x.before, d, x.after), 256))


@dataclass
class Manifest:
    """trees: one a group; above: the tree over their roots; roots: _g, _group, subroot, root and the _path from one to the other."""

    trees: Forest
    above: Forest
    roots: DataFrame

    def checked(self, keep: list[str]) -> DataFrame:
        """keep, proof_sha256 (hash of all siblings up to the root), folded_root (from the altered leaf, else the own), subroot and root of every leaf."""
        return _walk(self.trees, keep, self.roots.drop("_group"), "proof_sha256 string, folded_root string, subroot string, root string", _fold)


def manifest(docs: DataFrame, group_col: str = "source", id_col: str = "doc_id", fields: list[str] = FIELDS, altered: Column | None = None, part: int = PART, fanout: int = FANOUT) -> Manifest:
    """The trees of docs. altered: the leaf of an altered row, null where a row is as it was; kept as column _other."""
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(group_col).alias("_group"), leaf(*[F.col(c) for c in fields]).alias("_leaf"), (F.lit(None).cast("string") if altered is None else altered).alias("_other"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    trees = forest(written(rows), ["_id", "_leaf", "_tie"], part, fanout)
    roots = trees.roots().select(F.lit(0).alias("_group"), F.col("_group").alias("_name"), F.col("_g").alias("_of"), F.col("digest").alias("_leaf"), F.lit(None).cast("string").alias("_other"))
    above = forest(written(roots), ["_name"], part, fanout)
    root = above.roots().first()
    paths = proved(above, ["_name", "_of", "_leaf"])
    return Manifest(trees, above, written(paths.select(F.col("_of").alias("_g"), F.col("_name").alias("_group"), F.col("_leaf").alias("subroot"), F.lit(root and root["digest"]).cast("string").alias("root"), "_path")))


def op13_merkle_manifest(spark, sf_dir) -> DataFrame:
    # tampering takes the line feeds out of the texts of about every second document
    without = leaf(*[F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS])
    made = manifest(table(spark, sf_dir, "documents"), altered=F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, without))
    rows = made.checked(["_id", "_leaf"])
    return rows.select(F.col("_id").alias("doc_id"), F.col("_leaf").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _step_sql(nodes: str) -> str:
    """SQL list of the parents of a list of digests."""
    return f"list_transform(range(0, len({nodes}), {FANOUT}), lambda i: sha256(array_to_string({nodes}[i + 1:i + {FANOUT}], '')))"


def _tree_sql(name: str, leaves: str, key: str) -> str:
    """SQL of trees over lists of leaves: levels <name>(key, level, nodes), way <name>_way(key, spot, level, before, after) and <name>_root(key, root)."""
    return f"""
{name}(k, level, nodes) AS (
  SELECT {key}, 0, nodes FROM {leaves} UNION ALL SELECT k, level + 1, {_step_sql('nodes')} FROM {name} WHERE len(nodes) > 1
), {name}_root AS (SELECT k, nodes[1] AS root FROM {name} WHERE len(nodes) = 1
), {name}_at AS (
  SELECT k, level, nodes, unnest(range(0, CAST(len(nodes) AS BIGINT))) AS spot FROM {name} WHERE len(nodes) > 1
), {name}_way AS (
  SELECT k, level, spot, array_to_string(nodes[spot - spot % {FANOUT} + 1:spot], '') AS before, array_to_string(nodes[spot + 2:spot - spot % {FANOUT} + {FANOUT}], '') AS after FROM {name}_at
)"""


def _field_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || {value} END"


_LEAF_SQL = " || ".join(_field_sql(c) for c in FIELDS)
ORACLE_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, sha256({_LEAF_SQL}) AS leaf, sha256({_LEAF_SQL.replace("text", "replace(text, chr(10), '')")}) AS other FROM documents
), own AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY source NULLS FIRST) AS g,
         CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN other ELSE leaf END AS start FROM docs
), lists AS (SELECT g, list(leaf ORDER BY pos) AS nodes FROM own GROUP BY g
), {_tree_sql("tree", "lists", "g")}, tops AS (SELECT list(root ORDER BY k) AS nodes FROM tree_root
), {_tree_sql("crown", "tops", "0")}, steps AS (
  SELECT own.g, pos, level, before, after FROM own JOIN tree_way ON k = own.g AND spot = pos // CAST(power({FANOUT}, level) AS BIGINT)
  UNION ALL SELECT own.g, pos, 1000 + level, before, after FROM own JOIN crown_way ON spot = (own.g - 1) // CAST(power({FANOUT}, level) AS BIGINT)
), gathered AS (
  SELECT g, pos, list({{'b': before, 'a': after}} ORDER BY level) AS way FROM steps GROUP BY g, pos
), fold(g, pos, node, way) AS (
  SELECT own.g, own.pos, start, way FROM own LEFT JOIN gathered USING (g, pos)
  UNION ALL SELECT g, pos, sha256(way[1].b || node || way[1].a), way[2:] FROM fold WHERE len(way) > 0
)
SELECT doc_id, leaf, tree_root.root AS subroot, crown_root.root AS root, sha256(coalesce(array_to_string(list_transform(gathered.way, lambda x: x.b || x.a), ''), '')) AS proof_sha256, node AS folded_root,
       node = crown_root.root AS verified
FROM own JOIN tree_root ON tree_root.k = own.g CROSS JOIN crown_root LEFT JOIN gathered USING (g, pos) JOIN fold ON fold.g = own.g AND fold.pos = own.pos AND len(coalesce(fold.way, [])) = 0
"""
