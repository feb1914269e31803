"""Spelling variants: words one edit apart, found by rolling-hash deletions, and the form that each word is a variant of.

Two words of one length differ in one place exactly if they are equal with that place left out; a word differs from one a letter longer
exactly if one deletion of the longer gives it. Every word therefore has a key for each of its gaps (place and length are part of it), one for each deletion
(of a run of equal letters only the first) and one for itself. Keys are 64-bit polynomial hashes that prefix and suffix hashes give for all
places of a batch of words at once. Keys are dealt to buckets by their leading bits and sorted there; only those that meet others
go on, with the number of their word. Then the words come back by their numbers and the left-out strings are grouped as strings, so equal
hashes of different strings never count. No pairs are made: a group of one gap, at most one word a letter, gives each member the number
of the others and the most frequent of them; likewise a word and the longer words around it.

A form is the most frequent near word where it is at least RATIO times as frequent; following forms ends at the root. Forms grow by RATIO a
step, so doubling steps end after few rounds.

Null and empty texts: no words. Null id: the text before the colon is empty. Very long texts and very long words are taken whole; a word's keys are numbers, so a
word of k letters costs k small rows. Repeated rows count as often as they stand. Ties: the smaller word in code-point order. Empty table: no
rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_sql, table, written

LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, LEAST, RATIO, ODD = 5, 3, 2, 97
#: Keys of a bucket, on average, and letters that are hashed at a time.
BUCKET, LETTERS_AT_ONCE = 1_000_000, 1_000_000
GAP, DELETED, WHOLE = 0, 1, 2
KEYS = "bucket int, key long, kind byte, place int, w long"


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", odd: int = ODD, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """word, n: words of at least `shortest` letters and `least` occurrences. Where `odd` divides the checksum of id and word, one letter is lost (0: never)."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(LETTERS), F.lit(0))).alias("run"))
    # a lost letter never makes a word longer
    runs = runs.filter(F.length("run") >= shortest).select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("word"))
    if odd:
        sign = F.crc32(F.concat("id", F.lit(":"), "word"))
        runs = runs.withColumn("sign", sign).withColumn("cut", (F.col("sign") % F.length("word")).cast("int"))
        lost = F.concat(F.substr("word", F.lit(1), F.col("cut")), F.substr("word", F.col("cut") + 2))
        runs = runs.select(F.when(F.col("sign") % odd == 0, lost).otherwise(F.col("word")).alias("word")).filter(F.length("word") >= shortest)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers scattered so that their leading bits are even."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletion_keys(found: list[str], base: int = 0x9E3779B97F4A7C15) -> dict[str, np.ndarray]:
    """For every letter of the words: its word, its place, whether another letter stands before it, the key of the gap and of the deletion; and a key a word."""
    size = np.fromiter(map(len, found), np.int64, len(found))
    letters = _mixed(np.frombuffer("".join(found).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(base))
    word, start = np.repeat(np.arange(len(found)), size), np.cumsum(size) - size
    place = np.arange(len(letters)) - start[word]
    power = np.cumprod(np.concatenate(([1], np.full(max(1, size.max(initial=1)), base))).astype(np.uint64))  # wraps around
    here = letters * power[place]
    # a letter after the deletion stands one place earlier; a word's first letter never does
    moved = np.where(place > 0, letters * power[np.maximum(place - 1, 0)], np.uint64(0))

    def within(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Running sums from each word's start, its own letter included, and the words' totals."""
        run = np.concatenate(([np.uint64(0)], np.cumsum(x, dtype=np.uint64)))
        return run[1:] - run[start][word], run[start + size] - run[start]

    prefix, whole = within(here)
    suffix, total = within(moved)
    rest = (prefix - here) + (total[word] - suffix)
    long, at = size[word].astype(np.uint64), place.astype(np.uint64)
    gap = _mixed(rest ^ _mixed((long << np.uint64(32)) + at + np.uint64(1)))
    first = np.ones(len(letters), bool)
    first[1:] = (letters[1:] != letters[:-1]) | (place[1:] == 0)
    by_length = lambda rest, long: _mixed(rest + long * np.uint64(0xD6E8FEB86659FD93))
    return {"word": word, "place": place, "first": first, "gap": gap, "deleted": by_length(rest, long - np.uint64(1)), "whole": by_length(whole, size.astype(np.uint64))}


def _keyed(buckets: int, shortest: int):
    """Rows KEYS of the words of batches (w, word)."""

    def rows(key: np.ndarray, kind: int, place: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        bucket = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        columns = [bucket.astype(np.int32), key.view(np.int64), np.full(len(key), kind, np.int8), place.astype(np.int32), w]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f.split()[0] for f in KEYS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, every = b.column(0).to_numpy(), b.column(1).to_pylist()
            size = np.cumsum(np.fromiter(map(len, every), np.int64, len(every)))
            cuts = np.searchsorted(size, np.arange(0, size[-1] if len(size) else 0, LETTERS_AT_ONCE)).tolist() + [len(every)]
            for low, high in zip(cuts, cuts[1:]):
                if low < high:
                    own, k = ids[low:high], deletion_keys(every[low:high])
                    yield rows(k["gap"], GAP, k["place"], own[k["word"]])
                    # what is left of a shortest word is no word
                    some = k["first"] & (np.fromiter(map(len, every[low:high]), np.int64, high - low)[k["word"]] > shortest)
                    yield rows(k["deleted"][some], DELETED, k["place"][some], own[k["word"][some]])
                    yield rows(k["whole"], WHOLE, np.zeros(high - low), own)

    return run


def _meeting(rows: pa.Table) -> pa.Table:
    """The rows of one bucket whose key others have as well: gaps of two words or more; a word and deletions that give its key."""
    key, kind = rows.column("key").to_numpy(), rows.column("kind").to_numpy()
    order = np.lexsort((kind, key))
    plain = kind[order] != GAP
    key, kind = key[order], kind[order]
    starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (plain[1:] != plain[:-1]))))
    group = np.cumsum(np.bincount(starts, minlength=len(key))) - 1
    size = np.bincount(group)
    deleted = np.bincount(group, kind == DELETED)
    met = np.where(plain[starts], (deleted > 0) & (deleted < size), size > 1)
    return rows.take(pa.array(order[met[group]])).select(["kind", "place", "w"])


def near(vocabulary: DataFrame, shortest: int = SHORTEST, bucket: int = BUCKET) -> DataFrame:
    """w, n_near, best (struct of -n, word, w) of every word that has words one edit away. vocabulary: a written table w, word, n."""
    keys = vocabulary.agg(F.coalesce(F.sum(F.length("word") * 2 + 1), F.lit(0))).first()[0]
    buckets = max(1, -(-keys // bucket), min(vocabulary.sparkSession.sparkContext.defaultParallelism, keys // 10_000))
    found = vocabulary.select("w", "word").mapInArrow(_keyed(buckets, shortest), KEYS).groupBy("bucket").applyInArrow(_meeting, "kind byte, place int, w long")
    met = written(found.join(vocabulary, "w"))
    left = F.concat(F.substr("word", F.lit(1), F.col("place")), F.substr("word", F.col("place") + 2))
    best = F.struct((-F.col("n")).alias("less"), "word", "w")
    # gaps: as many words as there are letters at most stand in one
    gaps = met.filter(F.col("kind") == GAP).select("w", "place", left.alias("left"), best.alias("own"))
    group = Window.partitionBy("place", "left")
    ordered = group.orderBy("own").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gaps = gaps.select("w", (F.count(F.lit(1)).over(group) - 1).alias("more"), "own", F.first("own").over(ordered).alias("one"), F.nth_value("own", 2).over(ordered).alias("two"))
    gaps = gaps.select("w", "more", F.when(F.col("own.w") == F.col("one.w"), F.col("two")).otherwise(F.col("one")).alias("best"))
    # deletions: partial sums by what is left, once for the word itself and once for the longer words
    plain = met.filter(F.col("kind") != GAP).select("kind", "w", F.when(F.col("kind") == WHOLE, F.col("word")).otherwise(left).alias("left"), best.alias("own"))
    longer, whole = plain.filter(F.col("kind") == DELETED), plain.filter(F.col("kind") == WHOLE)
    above = longer.groupBy("left").agg(F.count(F.lit(1)).alias("more"), F.min("own").alias("best"))
    shorter = whole.join(above, "left").select("w", "more", "best")
    longer = longer.select("w", "left").join(whole.select("left", F.col("own").alias("best")), "left").select("w", F.lit(1).cast("long").alias("more"), "best")
    return gaps.unionByName(shorter).unionByName(longer).filter("more > 0").groupBy("w").agg(F.sum("more").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """w, up (the last of the chain of forms) from w, up (the form)."""
    forms, before = written(forms), None
    while True:
        onward = forms.select(F.col("w").alias("up"), F.col("up").alias("next"))
        forms = written(forms.join(onward, "up", "left").select("w", F.coalesce("next", "up").alias("up")))
        now = forms.agg(F.bit_xor(F.xxhash64("w", "up"))).first()[0]
        if now == before:
            return forms
        before = now


def variants(found: DataFrame, ratio: int = RATIO, shortest: int = SHORTEST, bucket: int = BUCKET) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n)."""
    vocabulary = written(written(found).withColumn("w", F.monotonically_increasing_id()))
    form = F.when(-F.col("best.less") >= F.col("n") * ratio, F.col("best"))
    rows = written(vocabulary.join(near(vocabulary, shortest, bucket), "w", "left").select("w", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form")))
    ends = roots(rows.filter("form is not null").select("w", F.col("form.w").alias("up")))
    ends = ends.join(vocabulary.select(F.col("w").alias("up"), F.col("word").alias("root")), "up").select("w", "root")
    return rows.join(ends, "w", "left").select("word", F.col("form.word").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", (-F.col("form.less")).alias("form_n"))


def op11_spelling(spark, sf_dir) -> DataFrame:
    return variants(words(table(spark, sf_dir, "documents")))


ORACLE_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS run FROM documents
), counted AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= {SHORTEST} GROUP BY ALL
), signed AS (SELECT *, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM counted
), made AS (
  SELECT CASE WHEN h % {ODD} = 0 THEN substr(run, 1, h % length(run)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, c FROM signed
), words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM made WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(c) >= {LEAST}
), places AS (SELECT word, n, unnest(range(1, CAST(length(word) + 1 AS BIGINT))) AS i FROM words
), gone AS (SELECT word, n, i, length(word) AS len, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM gone a JOIN gone b ON a.rest = b.rest AND a.i = b.i AND a.len = b.len AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gone a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM gone a JOIN words b ON a.rest = b.word
), best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM pairs GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {RATIO} * n THEN other END AS form, CASE WHEN other_n >= {RATIO} * n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS at_word FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at_word WHERE f.form IS NOT NULL
), ends AS (SELECT c.word, c.at_word AS root FROM chain c JOIN formed f ON f.word = c.at_word WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
