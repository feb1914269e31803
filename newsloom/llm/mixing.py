"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that they belong to); a flow network over patterns and
sources decides how many words each pattern gives to each source. A pattern's capacity is its words, once for each allowed
repetition, at convex costs (1, 3, 9, ...: a first use is cheapest), and a source takes at most its quota. Quotas are found by rounds of
sums over the table of sources, of any number. The network falls into the connected components of sources that share documents. A component
of one source (always so where the source column is a string) gives that source's quota; every other one is a group of its own, whose
task solves it exactly: a node for each of its patterns and sources, not for documents. Selection is distributed: a pattern that
gives r times its words uses every document floor(r) times and once more those that come first in a seeded order, up to the words
left; one more document, that which best fits what then lacks, follows. The cut is found from a histogram of the seeded order in
two levels, so only the documents of one of BUCKETS buckets a pattern are ever ordered against each other.

Very long texts are counted whole and used whole. Null and blank texts have size 0 and are taken 0 words. A null source is a source of its own, after the others. Null doc_id:
has its place in the seeded order by its text. Rows equal in id and text are units of their own,
numbered among themselves. Empty table: no rows. Other columns pass through
`mixed`; its own (size, source_size, target, copies, taken) replace those of the same names.
"""

from __future__ import annotations

from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, hot_join, prefix_sums, small_enough, table, word_count, written

REPEATS, SEED, BUCKETS, COARSE = 3, 42, 1 << 14, 1 << 7
#: Sources or patterns whose plan is broadcast at most.
PLANNED = 100_000


def quotas(sizes: list[int], weights: list[float], repeats: int = REPEATS) -> list[Fraction]:
    """Shares of all words by weight; no share above `repeats` times its source, the excess shared anew by weight."""
    out, left, free = [Fraction(0)] * len(sizes), Fraction(sum(sizes)), list(range(len(sizes)))
    while free:
        total = sum(Fraction(weights[i]) for i in free)
        share = {i: left * Fraction(weights[i]) / total if total else Fraction(0) for i in free}
        full = [i for i in free if share[i] > repeats * sizes[i]]
        if not full:
            for i in free:
                out[i] = share[i]
            return out
        for i in full:
            out[i] = Fraction(repeats * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(full)]
    return out


def min_cost_flow(patterns: list[tuple[int, list[int]]], quota: list[int], repeats: int = REPEATS) -> dict[tuple[int, int], int]:
    """(pattern, source) -> words; patterns: words and the sources that may use them.

    Only the arcs into patterns cost anything, and a path that adds flow never takes any back from them. So the cheapest flow is reached use by use: the
    most that first uses can send, then the most that second uses can add, each by blocking flows over shortest paths.
    """
    n, sink = len(patterns) + len(quota) + 2, len(patterns) + len(quota) + 1
    to, cap, out, ends = [], [], [[] for _ in range(n)], {}

    def arc(a: int, b: int, most: int) -> int:
        for x, y, c in ((a, b, most), (b, a, 0)):
            out[x].append(len(to))
            to.append(y)
            cap.append(c)
        return len(to) - 2

    for p, (_, sources) in enumerate(patterns):
        arc(0, 1 + p, 0)
        for s in sources:
            ends[arc(1 + p, 1 + len(patterns) + s, repeats * patterns[p][0])] = (p, s)
    for s, q in enumerate(quota):
        arc(1 + len(patterns) + s, sink, q)
    for _ in range(repeats):
        for p, (words, _) in enumerate(patterns):
            cap[out[0][p]] += words
        while True:
            far, queue = [-1] * n, [0]
            far[0] = 0
            for a in queue:
                for e in out[a]:
                    if cap[e] and far[to[e]] < 0:
                        far[to[e]] = far[a] + 1
                        queue.append(to[e])
            if far[sink] < 0:
                break
            tried, path, at = [0] * n, [], 0
            while True:
                if at == sink:
                    most = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= most
                        cap[e ^ 1] += most
                    cut = next(i for i, e in enumerate(path) if not cap[e])
                    at = to[path[cut] ^ 1]
                    del path[cut:]
                while tried[at] < len(out[at]):
                    e = out[at][tried[at]]
                    if cap[e] and far[to[e]] == far[at] + 1:
                        break
                    tried[at] += 1
                else:
                    if not path:
                        break
                    at = to[path.pop() ^ 1]
                    tried[at] += 1
                    continue
                path.append(e)
                at = to[e]
    return {ps: cap[e ^ 1] for e, ps in ends.items() if cap[e ^ 1]}


def _plan(held: DataFrame, give, target) -> DataFrame:
    """_of, source_size, target and the words to give as whole uses of the source and a rest."""
    used = F.col("size") > 0
    whole, rest = F.when(used, F.expr("_give div size")).otherwise(0), F.when(used, F.expr("_give % size")).otherwise(0)
    held = held.withColumns({"_give": give, "target": target})
    return written(held.select("_of", F.col("size").alias("source_size"), "target", whole.cast("long").alias("_whole"), rest.cast("long").alias("_rest")))


def source_targets(sources: DataFrame, weights, repeats: int) -> DataFrame:
    """The quotas of `quotas` as columns _target and _round (whole words) of sources (_s, size). Only sums and the sources that
    `weights` names come to the driver."""
    if weights:
        named = spark_rows(sources, weights)
        same = F.col("_s").eqNullSafe(F.col("_k"))
        found = sources.join(F.broadcast(named.select(F.col("_s").alias("_k"))), same).select("_s", "size").collect()
        words = sources.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        # all other sources as one without weight
        target = quotas([*(r["size"] for r in found), words - sum(r["size"] for r in found)], [*(weights[r["_s"]] for r in found), 0], repeats)
        named = spark_rows(sources, {r["_s"]: t for r, t in zip(found, target)})
        out = sources.join(F.broadcast(named.withColumnRenamed("_s", "_k")), same, "left")
        return out.select("_s", "size", F.coalesce("_target", F.lit(0.0)).alias("_target"), F.coalesce("_round", F.lit(0)).alias("_round"))
    sources = sources.select("_s", "size", F.col("_s").isNull().alias("_null"))
    sources = written(prefix_sums(sources, ["_null", "_s"], "size").withColumn("_w", F.col("row_no") % 3 + 1).select("_s", "size", "_w"))
    words, weight = sources.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    # each round, sources whose share by weight is more than they have are full, and their excess raises the others' shares
    left, total, full, before = words, weight, F.lit(False), -1
    while total:
        most = [(left * w - 1) // (total * repeats) for w in (1, 2, 3)]
        full = F.col("size") <= F.element_at(F.array(*[F.lit(m).cast("long") for m in most]), F.col("_w").cast("int"))
        n, size, taken = sources.filter(full).agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
        if n == before:
            break
        before, left, total = n, words - repeats * size, weight - taken
    share = [Fraction(left * w, total) if total else Fraction(0) for w in (1, 2, 3)]
    mine = [F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("_w").cast("int")) for xs in ([int(round(x)) for x in share], [float(x) for x in share])]
    most = F.col("size") * repeats
    return sources.select("_s", "size", F.when(full, most.cast("double")).otherwise(mine[1]).alias("_target"), F.when(full, most).otherwise(mine[0].cast("long")).alias("_round"))


def one_source_plan(held: DataFrame, weights, repeats: int) -> DataFrame:
    """The plan where each pattern is one source; held: _of, size."""
    found = source_targets(held.select(F.get("_of", 0).alias("_s"), "size"), weights, repeats)
    return _plan(found.withColumn("_of", F.array("_s")), F.col("_round"), F.col("_target"))


def spark_rows(held: DataFrame, values: dict) -> DataFrame:
    """source -> value as rows _s, _target, _round."""
    rows = [(k, float(v), round(Fraction(v))) for k, v in values.items()]
    return held.sparkSession.createDataFrame(rows, "_s string, _target double, _round long")


def network_plan(held: DataFrame, weights, repeats: int) -> DataFrame:
    """The plan where documents belong to several sources; held: _of, size."""
    held = written(held.select("_of", "size"))
    member = held.filter(F.size("_of") > 0).select("_of", "size", F.explode("_of").alias("_s"))
    # what a source could use at most: every document that belongs to it
    sources = written(source_targets(member.groupBy("_s").agg(F.sum("size").alias("size")), weights, repeats))
    spare, total = sources.agg(F.coalesce(F.sum("_target"), F.lit(0.0))).first()[0], held.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    part = min(1.0, total / spare) if spare else 1.0  # overlapping words count once
    quota = F.round(F.col("_target") * part).cast("long") if part < 1 else F.col("_round")
    name = lambda s: F.coalesce(F.concat(F.lit("s"), s), F.lit("n"))
    shared = held.filter(F.size("_of") > 1).select(F.explode(F.transform(F.slice("_of", 2, 1 << 30), lambda s: F.struct(name(F.get("_of", 0)).alias("a"), name(s).alias("b")))).alias("e")).select("e.*")
    root = written(components(shared))
    sources = sources.select("_s", quota.alias("_quota"), name(F.col("_s")).alias("node")).join(root.select("node", F.col("root").alias("_root")), "node", "left")
    patterns = held.withColumn("node", name(F.get("_of", 0))).join(root, "node", "left")
    single = patterns.filter("root is null").select("_of", "size", F.get("_of", 0).alias("_s"), F.size("_of").alias("_n"))
    alone = sources.filter("_root is null").select(F.col("_s").alias("_k"), "_quota")
    single = single.join(alone, (F.col("_n") > 0) & F.col("_s").eqNullSafe(F.col("_k")), "left")
    single = single.select("_of", "size", F.least(F.coalesce("_quota", F.lit(0)), F.col("size") * repeats).alias("_give"))

    def solve(patterns: pa.Table, sources: pa.Table) -> pa.Table:
        rows = sorted(zip(patterns.column("_of").to_pylist(), patterns.column("size").to_pylist()), key=lambda r: [(s is None, s or "") for s in r[0]])
        every = sorted(zip(sources.column("_s").to_pylist(), sources.column("_quota").to_pylist()), key=lambda r: (r[0] is None, r[0] or ""))
        at = {s: i for i, (s, _) in enumerate(every)}
        flow = min_cost_flow([(n, [at[s] for s in of]) for of, n in rows], [q for _, q in every], repeats)
        gives = [0] * len(rows)
        for (p, _), n in flow.items():
            gives[p] += n
        return pa.table({"_of": pa.array([of for of, _ in rows], pa.list_(pa.string())), "size": pa.array([n for _, n in rows], pa.int64()), "_give": pa.array(gives, pa.int64())})

    linked = patterns.filter("root is not null").groupBy("root").cogroup(sources.filter("_root is not null").groupBy("_root")).applyInArrow(solve, "_of array<string>, size long, _give long")
    return _plan(single.unionByName(linked), F.col("_give"), F.col("_give").cast("double"))


def _told_apart(base: DataFrame, buckets: int) -> DataFrame:
    """base as a written table in which rows of one unit (_u) have places of their own in the seeded order, after the first by their number.

    They are numbered within each partition, then over the partitions, so no unit is in one task, however many rows repeat it. Rows of a unit are
    alike, so it does not matter which has which number.
    """
    rows = written(base.withColumn("_row", F.monotonically_increasing_id()))
    units = written(rows.select("_u", "_row", F.shiftright("_row", 33).alias("_in")))
    again = written(units.groupBy("_u").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_u"))
    own = Window.partitionBy("_u", "_in").orderBy("_row")
    local = written(hot_join(units, again, "_u", "left_semi").withColumn("_no", F.row_number().over(own)))
    parts = local.groupBy("_u", "_in").agg(F.count(F.lit(1)).alias("_n"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_u").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = local.join(parts, ["_u", "_in"]).select("_row", (F.col("_before") + F.col("_no") - 1).alias("_tie")).filter("_tie > 0")
    rows = rows.join(number, "_row", "left").withColumn("_u", F.when(F.col("_tie").isNull(), F.col("_u")).otherwise(F.xxhash64("_u", "_tie")))
    return written(rows.withColumn("_b", F.pmod(F.shiftright("_u", 20), F.lit(buckets))).drop("_row", "_tie"))


def mixed(docs: DataFrame, weights=None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", repeats: int = REPEATS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """docs with size, source_size, target, copies and taken.

    `source_col` is a string (one source) or an array of the sources that a document belongs to; then source_size and target
    are those of its pattern: the words that it holds and the words that the flow takes from it. weights: source -> weight;
    by default 1, 2, 3, repeating over the sources by code point, null last.
    """
    own = ["size", "source_size", "target", "copies", "taken"]
    docs = docs.drop(*own)
    many = dict(docs.dtypes)[source_col].startswith("array")
    names = F.array_sort(F.array_distinct(source_col)) if many else F.array(F.col(source_col))
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit(seed))
    base = docs.withColumns({"size": word_count(F.col(text_col)), "_of": names, "_u": key}).withColumn("_b", F.pmod(F.shiftright("_u", 20), F.lit(buckets)))
    alone = set(docs.columns) <= {id_col, source_col, text_col}
    slim = written(base.drop(text_col) if alone else base.select("_of", "_u", "_b", "size"))
    if slim.filter("size > 0").groupBy("_u").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").head(1):
        # equal rows, which would else be used all or none; the texts are written only where other columns come with them
        apart = _told_apart(slim if alone else base, buckets)
        slim, base = (apart, base) if alone else (written(apart.select("_of", "_u", "_b", "size")), apart)
    held = slim.groupBy("_of").agg(F.sum("size").alias("size"))
    plan = (network_plan if many else one_source_plan)(held, weights, repeats)
    # the tables below have at most one row a pattern
    near = F.broadcast if plan.limit(PLANNED + 1).count() <= PLANNED else lambda df: df
    # where the words left over end: first among coarse buckets, then among the fine ones of that bucket, so no window holds
    # more than COARSE rows a pattern
    fine = buckets // COARSE

    def crossing(hist: DataFrame, at: str, *keep: str) -> DataFrame:
        """The bucket of each pattern at which the running size passes _rest, with what is before it."""
        running = F.col("_base") + F.coalesce(F.sum("_n").over(Window.partitionBy("_of").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return hist.withColumn("_before", running).filter("_before < _rest and _before + _n >= _rest").select("_of", F.col(at).alias(f"{at}_cut"), *keep, "_before", "_rest")

    rest = near(plan.select("_of", "_rest"))
    coarse = slim.groupBy("_of", F.floor(F.col("_b") / fine).alias("_hi")).agg(F.sum("size").alias("_n")).join(rest, "_of").withColumn("_base", F.lit(0).cast("long"))
    coarse = written(crossing(coarse, "_hi"))
    inner = slim.join(near(coarse), "_of").filter(F.floor(F.col("_b") / fine) == F.col("_hi_cut"))
    inner = inner.groupBy("_of", "_b", F.col("_before").alias("_base"), "_rest").agg(F.sum("size").alias("_n"))
    cut = written(crossing(inner, "_b").withColumnRenamed("_b_cut", "_cut"))
    # whole units up to the cut, then the one unit of the others whose size is nearest to the gap, if that lessens it
    units = slim.filter("size > 0").join(near(cut), "_of").filter("_b >= _cut").groupBy("_of", "_u", "_b", "_cut", "_before", "_rest").agg(F.sum("size").alias("size"))
    edge = units.filter("_b = _cut").withColumn("_end", F.col("_before") + F.sum("size").over(Window.partitionBy("_of").orderBy("_u").rowsBetween(Window.unboundedPreceding, 0)))
    edge = written(edge.select("_of", "_u", "_end", (F.col("_end") <= F.col("_rest")).alias("_in")))
    gaps = cut.join(edge.filter("_in").groupBy("_of").agg(F.max("_end").alias("_end")), "_of", "left").select("_of", (F.col("_rest") - F.coalesce("_end", "_before")).alias("_gap"))
    others = units.join(near(gaps.filter("_gap > 0")), "_of").join(edge.filter("_in").select("_of", "_u"), ["_of", "_u"], "left_anti")
    best = others.groupBy("_of").agg(F.min(F.struct(F.abs(F.col("size") - F.col("_gap")).alias("_off"), "_u", "_gap")).alias("_best")).filter("_best._off < _best._gap")
    chosen = written(edge.filter("_in").select("_of", "_u").union(best.select("_of", "_best._u")).withColumn("_more", F.lit(1)))
    rows = slim if alone else base
    # with the texts at hand, whether there is a word is cheaper to see than how many; unused sizes are then not counted again
    worded = F.col("size") > 0 if alone else F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = rows.join(near(plan.join(cut.select("_of", "_cut"), "_of", "left")), "_of").join(small_enough(chosen, 100_000), ["_of", "_u"], "left")
    more = F.coalesce((F.col("_b") < F.col("_cut")).cast("long"), F.lit(0)) + F.coalesce("_more", F.lit(0))
    rows = rows.withColumn("copies", F.when(worded, F.col("_whole") + more).otherwise(F.lit(0)))
    return rows.withColumn("taken", F.col("copies") * F.col("size")).select(*[c for c in docs.columns if c in rows.columns], *own)


def op3_mixing(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")
