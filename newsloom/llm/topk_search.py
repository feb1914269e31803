"""Exact top-k search by inner product: a Voronoi k-nearest-neighbour join.

Inner products become distances by one more coordinate: with R the largest norm, x' = (x, sqrt(R^2 - |x|^2)) and q' = (q, 0),
|q' - x'|^2 = |q|^2 + R^2 - 2 q.x, so the largest products are the nearest neighbours.

1. Pivots are as many as the root of the number of rows, at most MOST_PIVOTS, spread farthest first over a seeded sample of at most
   SAMPLE rows. Every row goes to the Voronoi cell of its
   nearest pivot, every query to its home cell.
2. Summaries: each data cell's rows nearest to its pivot (k + 1 distances), each home's number of queries and radius. For a home with
   pivot p and radius u, theta, the (k + 1)-th smallest of u + |p, pivot of a cell| + |row, its pivot| over all summaries, bounds
   the distance of the k-th neighbour of every query of the home.
3. Homes that reach each other (whose pivots are within theta + u) share a block, up to BLOCK queries; a home of more queries is
   parted. A row is handed to a block only if, for one of its homes, both lower bounds on the distance to the home's queries
   are within theta: |row, p| - u (triangle inequality) and the distance to the plane between p and the row's own pivot.
4. Each (block, part, slice of the rows) is solved on its own with blocked exact integer products; the k best of each slice
   merge to the result.

All that the driver sees are summaries of at most MOST_PIVOTS cells. Scaled components stay whole numbers of any size: sums of products
that may leave the exact range of doubles are taken in Python integers. A score that does not fit a long raises OverflowError.

Rows with null id or a vector that is null or holds null or non-finite components take no part. Repeated ids count once (the
first vector in order). Vectors of unequal length are compared as if the shorter ended in zeros. Fewer than k candidates: all of
them. Ties go to the smaller id. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written
from .vectors import clean, matrix, merged

K, SCALE, EVERY = 20, 64, 20
BLOCK, SLICE, MOST_PIVOTS, SAMPLE, SEED = 4096, 65_536, 1024, 8192, 42
RESULT = "query_id long, rank int, vec_id long, score long"


def _whole(x: np.ndarray) -> np.ndarray:
    """Python integers of a matrix of whole numbers."""
    return np.array([[int(y) for y in row] for row in x.tolist()], object).reshape(x.shape)


def _best(queries: np.ndarray, qid: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query id, id and product of each query's k best rows of the slice; matrices of whole numbers."""
    order = np.argsort(ids, kind="stable")
    data, ids = data[order], ids[order]
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * data.shape[1]
    kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else object
    data, out, n = (_whole(data) if kind is object else data.astype(kind)).T, [], len(ids)
    k = min(k + 1, n)
    for at in range(0, len(queries), 256):
        asked = queries[at : at + 256]
        product = (_whole(asked) if kind is object else asked.astype(kind)) @ data
        whole = product if kind is object else product.astype(object if top * n >= 1 << 62 else np.int64)
        key = whole * n + np.arange(n - 1, -1, -1)  # distinct: ties to the row that comes first
        pick = np.argsort(-key, axis=1)[:, :k] if key.dtype == object else np.argpartition(key, n - k, axis=1)[:, n - k :]
        out.append((np.repeat(qid[at : at + 256], k), ids[pick].ravel(), np.take_along_axis(whole, pick, 1).ravel()))
    q, i, s = (np.concatenate(x) for x in zip(*out))
    keep = q != i
    return q[keep], i[keep], s[keep].astype(np.int64)  # OverflowError where a score does not fit


def spread(x: np.ndarray, n: int) -> np.ndarray:
    """At most n different rows, each the farthest from those before it, so every cluster that x meets gets one."""
    pick, away = [0], np.full(len(x), math.inf)
    while len(pick) < min(n, len(x)):
        away = np.minimum(away, ((x - x[pick[-1]]) ** 2).sum(1))
        if not away.max() > 0:
            break
        pick.append(int(away.argmax()))
    return x[pick]


def _blocks(homes: list[tuple[int, int]], reach: np.ndarray, between: np.ndarray, block: int) -> list[list[int]]:
    """Homes (pivot, queries) that share a block: those within reach of the block's first home, nearest first."""
    left, out = dict(sorted(homes)), []
    while left:
        first = next(iter(left))
        own, total = [first], left.pop(first)
        for h in sorted(left, key=lambda h: between[first, h]):
            if between[first, h] > reach[first] or total + left[h] > block:
                break
            own.append(h)
            total += left.pop(h)
        out.append(own)
    return out


class Handout:
    """Blocks of queries, the rows that each of them needs, and the number of blocks."""

    def __init__(self, asking: DataFrame, data: DataFrame, blocks: int, width: int):
        self.asking, self.data, self.blocks, self.width = asking, data, blocks, width


def handout(df: DataFrame, is_query, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, slice_rows: int = SLICE, most_pivots: int = MOST_PIVOTS) -> Handout | None:
    """Steps 1 to 3; None where there are no queries. asking and data: vec_id, v, block, slice."""
    rows = clean(df, id_col, vector_col).select("vec_id", F.transform("v", lambda x: _floor(x * scale)).alias("v"))
    rows = written(rows.withColumn("asks", is_query(F.col("vec_id"))))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, asked, width, far, top = rows.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(F.size("v")), F.max(norm), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    if not asked:
        return None
    width = max(1, width)
    pivots = min(most_pivots, max(4, math.isqrt(n)))
    sample = matrix(rows.orderBy(F.xxhash64("vec_id", F.lit(SEED))).limit(min(SAMPLE, 16 * pivots)).select("v").toArrow().column("v"), width)  # SAMPLE rows at most
    with np.errstate(over="ignore", invalid="ignore"):
        pivot = spread(np.column_stack((sample, np.sqrt(np.maximum(0, far - (sample**2).sum(1))))), pivots)
    # rounding of squared distances of this size
    slack = 1e-6 + 1e-7 * math.sqrt(far)

    def apart(v: np.ndarray, ask: bool) -> np.ndarray:
        more = np.zeros(len(v)) if ask else np.sqrt(np.maximum(0, far - (v**2).sum(1)))
        square = (v**2).sum(1)[:, None] + more[:, None] ** 2 + (pivot**2).sum(1)[None] - 2 * (v @ pivot[:, :width].T + more[:, None] * pivot[:, width][None])
        return np.sqrt(np.maximum(0, square))

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in (b.slice(i, 1024) for i in range(0, b.num_rows, 1024)):
                v = matrix(p.column(1), width).astype(float)
                own, asks, as_query = apart(v, False), p.column(2).to_numpy(zero_copy_only=False), apart(v, True)
                home = np.where(asks, as_query.argmin(1), -1)
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(own.argmin(1)), pa.array(own.min(1)), pa.array(home), pa.array(as_query.min(1))], ["vec_id", "cell", "dist", "home", "radius"])

    cells = written(rows.mapInArrow(celled, "vec_id long, cell long, dist double, home long, radius double"))
    # summaries: k + 1 rows a data cell, one row a home
    near = cells.withColumn("no", F.row_number().over(Window.partitionBy("cell").orderBy("dist", "vec_id"))).filter(F.col("no") <= k + 1).select("cell", "dist").toArrow()
    near_cell, near_dist = near.column("cell").to_numpy(), near.column("dist").to_numpy()
    homes = cells.filter("home >= 0").groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.max("radius").alias("u")).collect()
    with np.errstate(over="ignore", invalid="ignore"):
        between = np.sqrt(np.maximum(0, ((pivot**2).sum(1)[:, None] + (pivot**2).sum(1)[None] - 2 * pivot @ pivot.T)))
    theta, reach = np.full(len(pivot), math.inf), np.full(len(pivot), math.inf)
    for r in homes:
        ups = r["u"] + between[r["home"], near_cell] + near_dist
        if len(ups) > k:
            theta[r["home"]] = np.partition(ups, k)[k] + slack
        reach[r["home"]] = theta[r["home"]] + r["u"] + slack
    shared = _blocks([(r["home"], r["n"]) for r in homes], reach, between, block)
    parts = {b: max(1, math.ceil(sum(r["n"] for r in homes if r["home"] in set(own)) / block)) for b, own in enumerate(shared)}
    block_of = {h: b for b, own in enumerate(shared) for h in own}
    home = np.array(sorted(block_of))
    first = np.array([block_of[h] for h in home])
    by_block = np.argsort(first, kind="stable")
    home, starts = home[by_block], np.flatnonzero(np.diff(first[by_block], prepend=-1))
    slices, small = max(1, math.ceil(n / slice_rows)), (top or 0) < 1 << 31

    def handed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in (b.slice(i, 1024) for i in range(0, b.num_rows, 1024)):
                far_off = apart(matrix(p.column(1), width).astype(float), False)
                cell = far_off.argmin(1)
                own, to_home = far_off[np.arange(len(cell)), cell], far_off[:, home]
                apart_pivots = between[home[None], cell[:, None]]
                plane = np.where(apart_pivots > slack, (to_home**2 - own[:, None] ** 2) / (2 * np.maximum(apart_pivots, slack)), 0)
                out = (to_home > reach[home][None]) | (plane > theta[home][None] + slack)
                to, row = np.nonzero(np.logical_or.reduceat(~out, starts, axis=1).T)
                yield pa.RecordBatch.from_arrays([p.column(0).take(pa.array(row)), p.column(1).take(pa.array(row)), pa.array(to)], ["vec_id", "v", "shared"])

    kind = "array<int>" if small else "array<double>"
    slim = rows.withColumn("v", F.col("v").cast(kind))
    part = F.element_at(F.array(*[F.lit(parts[b]) for b in sorted(parts)]), F.col("shared").cast("int") + 1).cast("long")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    data = slim.select("vec_id", "v").mapInArrow(handed, f"vec_id long, v {kind}, shared long").withColumn("part", each(part))
    data = data.select("vec_id", "v", (F.col("shared") * (1 << 32) + F.col("part")).alias("block"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(slices)).alias("slice"))
    at = F.create_map(*[F.lit(x) for hb in block_of.items() for x in hb])
    asking = cells.filter("home >= 0").select("vec_id", at[F.col("home")].cast("long").alias("shared"))
    asking = asking.select("vec_id", (F.col("shared") * (1 << 32) + F.pmod(F.xxhash64("vec_id"), part)).alias("block"))
    asking = slim.filter("asks").join(asking, "vec_id").select("vec_id", "v", "block", each(F.lit(slices).cast("long")).alias("slice"))
    return Handout(asking, data, sum(parts.values()), width)


def _floor(x: F.Column) -> F.Column:
    """floor as a double, also where it is beyond a long (then x is whole already)."""
    return F.when(F.abs(x) < 2.0**62, F.floor(x).cast("double")).otherwise(x)


def search(df: DataFrame, is_query, k: int = K, **options) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that `is_query` (a condition on vec_id) names, its k largest products.

    options: as of `handout`.
    """
    plan = handout(df, is_query, k, **options)
    if plan is None:
        return df.sparkSession.createDataFrame([], RESULT)
    width = plan.width

    def solve(queries: pa.Table, part: pa.Table) -> pa.Table:
        if not queries.num_rows or not part.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        q, i, s = _best(matrix(queries.column("v"), width), queries.column("vec_id").to_numpy(), matrix(part.column("v"), width), part.column("vec_id").to_numpy(), k)
        return pa.table({"query_id": pa.array(q), "vec_id": pa.array(i.astype(np.int64)), "score": pa.array(s)})

    found = plan.asking.groupBy("block", "slice").cogroup(plan.data.groupBy("block", "slice")).applyInArrow(solve, "query_id long, vec_id long, score long")
    return merged(found, k, F.col("score").desc()).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_topk_search(spark, sf_dir) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), lambda i: i % EVERY == 0)


ORACLE_SQL = f"""
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score FROM rows q JOIN rows d ON d.vec_id <> q.vec_id WHERE q.vec_id % {EVERY} = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {K}
"""
