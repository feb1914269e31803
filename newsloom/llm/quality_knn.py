"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

The terms of a text are its words and its pairs of neighbouring words (each hashed to WORDS buckets), pairs of neighbouring characters in
32 classes, triples in 10 coarse classes, and its share of words that repeat the word before and of words that it holds already
(each in steps). A term-document matrix of log counts times
inverse document frequency, taken over at most SAMPLE labelled rows, is cut to RANK latent dimensions by a seeded randomised
SVD. The labelled vectors (SAMPLE x RANK numbers) and the projection (TERMS x RANK) are broadcast: their sizes are fixed by
these parameters. Every document is projected, its cosines with all labelled vectors are computed exactly, block by block, and the
NEAREST labels vote with the POWER of their cosine, beside a weak vote of the base rate.

The labelled rows are those with the smallest seeded hashes of their doc_id, so the sample does not depend on partitions; rows
whose crc32(doc_id as text) leaves 0 modulo 5 are held out. Labels, language, source and id are not inputs of a score.

Null, empty and blank texts hold no terms and get the base rate. Null doc_id: never labelled, counted as held out. Repeated labels of a
document: their mean decides (at least one half: good); null labels are skipped. Without any label every score is one half.
Empty table: no rows. Other columns pass through; earlier columns named held_out, score or predicted are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .substring import FACTOR, word_ids

SAMPLE, RANK, NEAREST, POWER, SEED, CUT = 3000, 48, 15, 8, 42, 0.3
MARKS = b" \n.,!?|$%&*#:;-'\"()/=<>@_"
STEPS = 12


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Byte -> fine class (0-31) and coarse class (0-9)."""
    fine, coarse = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b)
        if b > 127:
            fine[b], coarse[b] = 1, 1
        elif c.isalpha():
            vowel = c.lower() in "aeiou"
            fine[b] = (2 if c.islower() else 4) + vowel
            coarse[b] = 2 if c.islower() else 3
        elif c.isdigit():
            fine[b], coarse[b] = 6, 4
        elif b in MARKS:
            at = MARKS.index(b)
            fine[b], coarse[b] = 7 + at, 5 if c == " " else 6 if c == "\n" else 7 if at < 6 else 8
        else:
            coarse[b] = 9
    return fine, coarse


FINE, COARSE = _classes()
#: Buckets of words, and of word pairs.
WORDS = 1024
TERMS = 32 * 32 + 10 * 10 * 10 + 2 * WORDS + 2 * STEPS


def _slices(column: pa.Array, size: int = 1_000_000) -> Iterator[tuple[int, int]]:
    at = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)) // size
    cuts = np.flatnonzero(np.diff(at, prepend=-1, append=-1)) if len(at) else []
    for i, j in zip(cuts[:-1], cuts[1:]):
        yield from ((k, min(j, k + 500)) for k in range(i, j, 500))


def term_counts(column: pa.Array) -> np.ndarray:
    """Rows x TERMS counts of a column of UTF-8 texts."""
    n = len(column)
    column = column.fill_null(b"").cast(pa.large_binary())
    edge = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[edge[0] : edge[-1]]
    edge = edge - edge[0]
    out = np.zeros((n, TERMS), np.float32)
    for p in range(0, len(data), 1 << 22):  # a very long text comes in pieces that overlap by two bytes
        b = data[p : p + (1 << 22) + 2]
        row = np.searchsorted(edge, np.arange(p, p + len(b)), "right") - 1 if n > 1 else np.zeros(len(b), np.int64)
        for classes, k, base, step in ((FINE, 2, 32, 0), (COARSE, 3, 10, 1024)):
            c, term = classes[b], 0
            m = min(len(b) - k + 1, 1 << 22)
            if m <= 0:
                continue
            for i in range(k):
                term = term * base + c[i : i + m]
            keep = row[:m] == row[k - 1 : k - 1 + m]
            out[:, step : step + base**k] += np.bincount(row[:m][keep] * base**k + term[keep], minlength=n * base**k).reshape(n, -1)
    ids, row = word_ids(column)
    words = np.bincount(row, minlength=n)
    pairs = np.flatnonzero(row[1:] == row[:-1])
    for step, of, term in ((2024, row, ids), (2024 + WORDS, row[pairs], (ids[pairs] * FACTOR + ids[pairs + 1]) * FACTOR)):
        out[:, step : step + WORDS] = np.bincount(of * WORDS + (term >> np.uint64(40)).astype(np.int64) % WORDS, minlength=n * WORDS).reshape(n, WORDS)
    again = np.bincount(row[1:][(ids[1:] == ids[:-1]) & (row[1:] == row[:-1])], minlength=n)
    order = np.lexsort((ids, row))
    held = np.bincount(row[order][1:][(ids[order][1:] == ids[order][:-1]) & (row[order][1:] == row[order][:-1])], minlength=n)
    some = np.flatnonzero(words)
    for at, times in ((TERMS - 2 * STEPS, again), (TERMS - STEPS, held)):
        out[some, at + np.minimum(STEPS - 1, times[some] * STEPS // words[some])] = words[some]
    return out


def _sparse(counts: np.ndarray) -> list[bytes]:
    return [np.concatenate((at := np.flatnonzero(x), x[at])).astype(np.float32).tobytes() for x in counts]


def fit(texts: list[bytes], labels: list[int], rank: int = RANK, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """projection (TERMS x rank), labelled unit vectors, labels; texts: term counts as made by _sparse."""
    counts = np.zeros((len(texts), TERMS), np.float32)
    for i, x in enumerate(texts):
        at, n = np.frombuffer(x, np.float32).reshape(2, -1)
        counts[i, at.astype(int)] = n
    idf = np.log((1 + len(texts)) / (1 + (counts > 0).sum(0))) + 1
    a = np.log1p(counts) * idf.astype(np.float32)
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)
    rank = min(rank, len(texts))
    q = np.random.default_rng(seed).standard_normal((TERMS, min(rank + 16, len(texts)))).astype(np.float32)
    for _ in range(3):
        q, _ = np.linalg.qr(a.T @ (a @ q))
    _, _, v = np.linalg.svd(a @ q, full_matrices=False)
    projection = (idf[:, None] * (q @ v[:rank].T)).astype(np.float32)
    return projection, latent(counts, projection), np.array(labels, np.float32)


def latent(counts: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Unit vectors; texts without terms stay zero."""
    x = np.log1p(counts) @ projection
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def votes(x: np.ndarray, vectors: np.ndarray, labels: np.ndarray, nearest: int = NEAREST, power: int = POWER) -> np.ndarray:
    """Scores of unit vectors x: the labels of the nearest by cosine, weighted by its power, beside 0.1 vote of the base rate."""
    cosine = x @ vectors.T
    k = min(nearest, len(labels))
    top = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosine, top, 1), 0) ** power
    return ((weight * labels[top]).sum(1) + 0.1 * labels.mean()) / (weight.sum(1) + 0.1)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """docs with held_out, score and predicted."""
    docs = docs.drop("held_out", "score", "predicted")
    spark = docs.sparkSession

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in _slices(b.column(2)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(_sparse(term_counts(b.column(2).slice(i, j - i))), pa.binary())], ["doc_id", "label", "terms"])

    marked = labels.filter("quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    marked = marked.filter(~held_out("doc_id")).join(docs.select(F.col(id_col).alias("doc_id")), "doc_id", "left_semi")
    marked = marked.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(sample)
    # at most `sample` rows, also where ids repeat
    mine = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(marked), "doc_id").select("doc_id", "label", "text")
    mine = mine.mapInArrow(counted, f"doc_id {dict(docs.dtypes)[id_col]}, label int, terms binary").groupBy("doc_id").agg(F.min(F.struct("terms", "label")).alias("row"))
    rows = sorted((r["row"]["label"], bytes(r["row"]["terms"])) for r in mine.collect())
    model = spark.sparkContext.broadcast(fit([t for _, t in rows], [n for n, _ in rows]) if rows else None)

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    names, at = [*docs.columns, "score"], docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for b in batches:
            text = b.column(at).cast(pa.binary())
            for i, j in _slices(text):
                score = votes(latent(term_counts(text.slice(i, j - i)), fitted[0]), *fitted[1:]) if fitted else np.full(j - i, 0.5)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns), pa.array(np.clip(score, 0, 1).astype(np.float64))], names)

    out = docs.mapInArrow(run, schema)
    return out.withColumns({"held_out": held_out(id_col), "predicted": (F.col("score") >= cut).cast("int")})


def op8_quality_knn(spark, sf_dir) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")
