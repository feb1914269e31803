"""Approximate nearest neighbours by a hash-prefix forest.

Each of TREES trees labels a vector with a long string of 7-bit characters. A character is the index and sign of the largest
coordinate after a random rotation of the centred vector (the vertex of a cross-polytope that it is nearest to). The rows are
dealt to slices of SLICE rows at random; a slice keeps, for each tree, its strings in a sorted array. One task sorts a slice once and
then streams all queries past it, so rows are shuffled once and queries once a slice. A query descends in every tree to its
longest matching prefix (two binary searches a length). Then it ascends all trees in step, one prefix length at a time and tree by
tree within a length, until the matches reach the share `reach` of the slice, and goes on until it has met k different rows
other than its own; the root is the whole slice. The matches are ranked by their exact distances, and the best lists of all
slices merge, so every query gets k answers, or all candidates where there are fewer. Every row is indexed and every query meets every slice.

The centre is the mean of at most SAMPLE rows, and `reach` is fitted on them: for at most QUERIES of the queries, it is the share at which the ascent has met a
part AIM of their true neighbours in the sample. A sample is sparser than the whole, so its neighbours are farther away and the fitted share
is on the safe side. Vectors without structure need a large share (in 64 independent dimensions, about a third); no cap is set.

Rows with null id or a vector that is null, zero or holds null or non-finite components take no part. Repeated ids count once
(the first vector in order). Vectors of unequal length are compared as if the shorter ended in zeros. Ties go to the smaller id. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written
from .vectors import clean, matrix, merged

K, EVERY = 10, 100
TREES, SAMPLE, QUERIES, AIM, SEED = 64, 8192, 128, 0.96, 42
SLICE = 65_536


@lru_cache(maxsize=1)
def rotations(width: int, length: int, trees: int, seed: int) -> list[list[np.ndarray]]:
    """The random rotations of each tree's characters: made once a task."""
    pad = max(2, min(64, 1 << (width - 1).bit_length()))  # vertices: 2 * pad
    rng = np.random.default_rng(seed)
    turn = lambda: np.linalg.qr(rng.standard_normal((max(width, pad), pad)))[0][:width].astype(np.float32)
    return [[turn() for _ in range(length)] for _ in range(trees)]


class Forest:
    """Strings of some rows, sorted in each tree."""

    def __init__(self, x: np.ndarray, centre: np.ndarray, length: int, trees: int = TREES, seed: int = SEED):
        self.x, self.centre, self.length, self.trees, self.seed = x, centre, length, trees, seed
        strings = self.strings(x)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, 1)

    def strings(self, x: np.ndarray) -> np.ndarray:
        """trees x rows; `length` characters of 7 bits, the first in the highest bits."""
        y = (x - self.centre).astype(np.float32)
        out = np.zeros((self.trees, len(x)), np.int64)
        for t, turns in enumerate(rotations(x.shape[1], self.length, self.trees, self.seed)):
            for turn in turns:
                z = y @ turn
                at = np.abs(z).argmax(1)
                out[t] = (out[t] << 7) | (at << 1) | (z[np.arange(len(z)), at] > 0)
        return out

    def spans(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end of the matches of each query, by prefix length (0 to all) and tree."""
        first = np.zeros((self.length + 1, self.trees, strings.shape[1]), np.int64)
        end = np.full_like(first, len(self.x))
        for d in range(1, self.length + 1):
            shift = 7 * (self.length - d)
            for t in range(self.trees):
                first[d, t] = np.searchsorted(self.sorted[t], (strings[t] >> shift) << shift, "left")
                end[d, t] = np.searchsorted(self.sorted[t], ((strings[t] >> shift) + 1) << shift, "left")
        return first, end

    def stops(self, first: np.ndarray, end: np.ndarray, reach: float, own: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Prefix length and number of trees at which the ascent of each query has `reach` matches. own: 1 where a query is itself a row, which every tree meets."""
        n = end - first - own
        q = n.shape[2]
        depth, trees, open_ = np.zeros(q, np.int64), np.full(q, self.trees), np.ones(q, bool)
        for d in range(self.length, 0, -1):
            longer = n[d + 1] if d < self.length else np.zeros_like(n[d])
            met = np.cumsum(n[d] - longer, axis=0) + longer.sum(0)[None]
            done = met >= reach
            hit = done.any(0) & open_
            depth[hit], trees[hit] = d, done.argmax(0)[hit] + 1
            open_ &= ~hit
        return depth, trees

    def matches(self, first: np.ndarray, end: np.ndarray, q: int, depth: int, trees: int) -> np.ndarray:
        """Rows that a query has met when it stops."""
        if not depth:
            return np.arange(len(self.x))
        met = np.zeros(len(self.x), bool)
        for t in range(self.trees):
            d = depth if t < trees else depth + 1
            if d <= self.length:
                met[self.order[t, first[d, t, q] : end[d, t, q]]] = True
        return np.flatnonzero(met)

    def enough(self, first: np.ndarray, end: np.ndarray, q: int, depth: int, trees: int, k: int, own: np.ndarray) -> np.ndarray:
        """The same without rows `own` (a mask), going on up by whole prefix lengths until there are k of them or the root is reached."""
        met = self.matches(first, end, q, depth, trees)
        met = met[~own[met]]
        while len(met) < k and depth:
            depth, trees = depth - 1, self.trees
            met = self.matches(first, end, q, depth, trees)
            met = met[~own[met]]
        return met


def fitted_reach(x: np.ndarray, ids: np.ndarray, asks: np.ndarray, ask_ids: np.ndarray, centre: np.ndarray, length: int, k: int, trees: int = TREES, aim: float = AIM) -> float:
    """Share of a slice that the ascent of queries `asks` must reach (matches of all trees other than the query added up) to meet a part `aim` of
    their true neighbours among x; infinity is the root."""
    if len(x) <= k + 1:
        return math.inf
    forest = Forest(x, centre, length, trees)
    first, end = forest.spans(forest.strings(asks))
    n = end - first - np.isin(ask_ids, ids).astype(np.int64)
    place = np.empty_like(forest.order)
    np.put_along_axis(place, forest.order, np.arange(len(x))[None], 1)
    need = []
    for i, a in enumerate(asks):
        d2 = ((x - a) ** 2).sum(1)
        d2[ids == ask_ids[i]] = np.inf
        for b in np.argpartition(d2, k)[:k]:
            inside = (first[1:, :, i] <= place[:, b]) & (place[:, b] < end[1:, :, i])  # length x trees
            at = np.flatnonzero(inside[::-1].ravel())
            if not len(at):
                need.append(math.inf)
                continue
            back, t = divmod(int(at[0]), trees)
            d = forest.length - back
            need.append(n[d, : t + 1, i].sum() + (n[d + 1, t + 1 :, i].sum() if d < forest.length else 0))
    need = sorted(need)[max(0, math.ceil(aim * len(need)) - 1)]
    return float(need) / len(x)


def search(df: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, reach: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the nearest rows found for each row that `is_query` names."""
    spark = df.sparkSession
    rows = written(clean(df, id_col, vector_col, zeros=False).withColumn("asks", is_query(F.col("vec_id"))))
    n, asked, width = rows.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(F.size("v"))).first()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    first = lambda df, most: df.orderBy(F.xxhash64("vec_id", F.lit(SEED))).limit(most).select("vec_id", "v").toArrow()
    some, ask = first(rows, SAMPLE), first(rows.filter("asks"), QUERIES)
    sample = matrix(some.column("v"), width)
    centre = sample.mean(0)
    length = 1 + math.ceil(math.log(max(2, n)) / math.log(128))
    if reach is None:
        reach = fitted_reach(sample, some.column("vec_id").to_numpy(), matrix(ask.column("v"), width), ask.column("vec_id").to_numpy(), centre, length, k, trees)
    slices = max(math.ceil(n / SLICE), min(8, math.ceil(n / 4096)))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long")))
    data = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(slices)).alias("slice"), F.lit(False).alias("asks"))
    asking = rows.filter("asks").select("vec_id", "v", each.alias("slice"), F.lit(True).alias("asks"))
    # a slice's rows come first, then all queries, in batches: the forest is built once and never copied
    dealt = data.union(asking).repartition(2 * slices, "slice").sortWithinPartitions("slice", "asks")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, forest, ids = None, [], None, None
        for slice_no, asks, part in _runs(batches):
            if slice_no != at:
                at, held, forest = slice_no, [], None
            if not asks:
                held.append(part)
                continue
            if forest is None and held:
                whole = pa.Table.from_batches(held)
                ids, forest, held = whole.column("vec_id").to_numpy(), Forest(matrix(whole.column("v"), width), centre, length, trees), []
            if forest is not None:
                yield from _answers(forest, ids, part, width, k, reach)

    found = dealt.mapInArrow(solve, "query_id long, vec_id long, score double")
    return merged(found, k, F.col("score")).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """Pieces of batches (vec_id, v, slice, asks) that are of one slice and kind."""
    for b in batches:
        if b.num_rows:
            key = b.column(2).to_numpy() * 2 + b.column(3).to_numpy(zero_copy_only=False)
            cuts = [*np.flatnonzero(np.diff(key, prepend=-1)), b.num_rows]
            yield from ((int(key[i]) // 2, bool(key[i] % 2), b.slice(i, j - i)) for i, j in zip(cuts[:-1], cuts[1:]))


def _answers(forest: Forest, ids: np.ndarray, queries: pa.RecordBatch, width: int, k: int, reach: float) -> Iterator[pa.RecordBatch]:
    """query_id, vec_id, score of the k nearest rows of the forest that each query's ascent meets."""
    q, qid = matrix(queries.column(1), width), queries.column(0).to_numpy()
    for at in range(0, len(q), 256):
        first, end = forest.spans(forest.strings(q[at : at + 256]))
        depth, upto = forest.stops(first, end, reach * len(ids), np.isin(qid[at : at + 256], ids).astype(np.int64))
        found = []
        for i in range(len(depth)):
            met = forest.enough(first, end, i, depth[i], upto[i], k, ids == qid[at + i])
            d = np.sqrt(((forest.x[met] - q[at + i]) ** 2).sum(1))
            if len(d) > k:
                near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                met, d = met[near], d[near]
            best = np.lexsort((ids[met], d))[:k]
            found.append((np.full(len(best), qid[at + i]), ids[met[best]], d[best]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["query_id", "vec_id", "score"])


def op6_ann_forest(spark, sf_dir) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), lambda i: i % EVERY == 0)
