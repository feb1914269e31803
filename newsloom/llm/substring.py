"""Substring de-duplication by prefix-partitioned suffix trees over words.

Every word position starts a suffix; the tree is cut at the depth of the window (13 words), where each inner node is a word
sequence that occurs again. Five steps:

1. Ids are ranked: prefix sums of the texts' bytes over the sorted ids cut them to blocks of about BLOCK bytes, however many these
   are. An id whose rows hold more than that, and the rows without id (the last rank), are dealt to several blocks of one rank. Up to CUTS
   cuts are broadcast; more are joined by id.
2. One pass counts suffixes by their first 1, 2 and 4 words (hashed to buckets, whose number grows with the text). A prefix in a bucket of
   more than GROUP suffixes is split by the next longer prefix; at most (suffixes / GROUP) such buckets a level exist, and only these leave
   the cluster. A suffix hangs below the shortest prefix that is not split; prefixes are hashed to groups of about GROUP suffixes.
3. Each block hands every group its subtrees in leaf order: prefix after prefix, and below each the sorted labels (64-bit rolling hashes of
   13 words) of its windows, once each, so a passage that stands in a third of all documents is one leaf a block.
4. A group merges the subtrees of all blocks in leaf order (prefix, label). A run of equal leaves is an inner node at the depth of the window,
   a repeat. Its first rank keeps it, each block of a later rank (larger doc_ids) is told.
5. Each block marks the windows that it was told of and those that a smaller doc_id of its own holds. Covering windows merge
   to maximal repeats, whose words go.

Two windows are one leaf if 32 bits of their prefixes' hashes and the 64-bit hashes of their 13 words are equal; at most (suffixes x GROUP) / 2^64 false
matches are to be expected (10^-3 at 30 GB).

Null text: no words. Null doc_id: larger than any other, and nulls do not compare with each other. Rows of the same doc_id do
not compare with each other. Repeated rows come back as often as they stand. Very long texts: a block holds at least one text whole, as word
hashes and bytes, so memory follows the longest text; words are hashed PIECE bytes at a time. Empty table: no rows. Other
columns pass through; earlier columns named n_words or n_removed are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, dropped, prefix_sums, table, written

WINDOW = 13
#: Suffixes of a group, bytes of a block, least number of buckets, cuts that are broadcast at most.
GROUP, BLOCK, BUCKETS, CUTS = 2_000_000, 3_000_000, 1 << 14, 1 << 20
#: Bytes of text of a shuffle partition, and partitions at most (then they hold more blocks; memory follows the block).
PART, PARTS = 16_000_000, 20_000
#: A block's number is its rank by doc_id and, in the low bits, its part of a rank that is dealt to several blocks.
SPLIT = 24
FACTOR = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _hashed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(29))


LETTER = _hashed(np.arange(1, 257, dtype=np.uint64) * FACTOR)
BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
PIECE = 1 << 18
RADIX = 0x2545F4914F6CDD1D


class _Powers:
    """Powers of RADIX and of its inverse modulo 2^64."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> None:
        if len(cls.up) < n:
            one = np.ones(1, np.uint64)
            cls.up = np.cumprod(np.concatenate((one, np.full(n, RADIX, np.uint64))), dtype=np.uint64)
            cls.down = np.cumprod(np.concatenate((one, np.full(n, pow(RADIX, -1, 1 << 64), np.uint64))), dtype=np.uint64)


def word_ids(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of a column of UTF-8 texts, and the row of each; PIECE bytes at a time, cut between words."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).fill_null(b"").cast(pa.large_binary())
    edge = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    ids, rows, p, end = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], int(edge[0]), int(edge[-1])
    while p < end:
        q = min(end, p + PIECE)
        while q < end and not BLANK[data[q]] and edge[np.searchsorted(edge, q)] != q:
            more = np.flatnonzero(BLANK[data[q : q + 4096]])
            q = min(q + (int(more[0]) if len(more) else 4096), int(edge[np.searchsorted(edge, q)]))
        b = data[p:q]
        ink = ~BLANK[b]
        cut = np.zeros(q - p + 1, bool)  # a row begins here
        cut[edge[(edge >= p) & (edge <= q)] - p] = True
        begins = np.flatnonzero(ink & (cut[:-1] | ~np.concatenate(([False], ink[:-1]))))
        ends = np.flatnonzero(ink & (cut[1:] | ~np.concatenate((ink[1:], [False]))))
        _Powers.upto(q - p)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(LETTER[b] * _Powers.up[: q - p], dtype=np.uint64)))
        ids.append(_hashed((sums[ends + 1] - sums[begins]) * _Powers.down[begins]))
        rows.append(np.searchsorted(edge, begins + p, "right") - 1)
        p = q
    return np.concatenate(ids), np.concatenate(rows)


def _levels(window: int) -> list[int]:
    return sorted({min(k, window) for k in (1, 2, 4)} | {window})


def _suffixes(ids: np.ndarray, row: np.ndarray, window: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Where a whole window of one row's words starts, and rolling hashes of its first 1, 2, 4 and `window` words."""
    n = max(0, len(ids) - window + 1)
    at = np.flatnonzero(row[:n] == row[window - 1 : window - 1 + n])
    out, h = {}, np.zeros(n, np.uint64)
    for k in range(window):
        h = h * FACTOR + ids[k : k + n]
        if k + 1 in _levels(window):
            out[k + 1] = h[at]
    return at, out


def _slices(b: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, some hundred KB of text at a time."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(text)), 0), np.int64)) // 500_000
    cuts = np.flatnonzero(np.diff(size, prepend=-1, append=-1)) if len(size) else []
    yield from (b.slice(i, j - i) for i, j in zip(cuts[:-1], cuts[1:]))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h ^ (h >> np.uint64(29))) * FACTOR) >> np.uint64(33)).astype(np.int64) % buckets


def _counts(window: int, buckets: int, most: int = 1 << 20):
    """Rows (level, at, n): suffixes by prefix level and bucket. A task holds about `most` sums at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, fresh = np.zeros(0, np.int64), np.zeros(0, np.int64), [[], []]

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every, back = np.unique(np.concatenate((keys, *fresh[0])), return_inverse=True)
            total = np.bincount(back, np.concatenate((sums, *fresh[1])), len(every)).astype(np.int64)
            fresh[0].clear(), fresh[1].clear()
            return every, total

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys >> 40), pa.array(keys & ((1 << 40) - 1)), pa.array(sums)], ["level", "at", "n"])

        for b in (x for whole in batches for x in _slices(whole, 0)):
            for level, h in _suffixes(*word_ids(b.column(0)), window)[1].items():
                if level < window:
                    at, n = np.unique(_bucket(h, buckets), return_counts=True)
                    fresh[0].append(at + (level << 40)), fresh[1].append(n)
            if sum(map(len, fresh[0])) > most:
                keys, sums = merged()
                if len(keys) > most:
                    yield rows()
                    keys, sums = keys[:0], sums[:0]
        keys, sums = merged()
        yield rows()

    return run


def _planes(values: np.ndarray, width: int = 8) -> bytes:
    """Numbers as byte planes of their differences; the shuffle's codec packs the empty planes."""
    return np.diff(values, prepend=values.dtype.type(0)).astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _values(planes: bytes, width: int = 8) -> np.ndarray:
    kind = np.dtype(f"<u{width}")
    return np.cumsum(np.frombuffer(planes, np.uint8).reshape(width, -1).T.copy().view(kind).ravel(), dtype=kind)


def _split_prefixes(docs: DataFrame, text_col: str, window: int, group: int, buckets: int) -> dict[int, np.ndarray]:
    """Level -> sorted buckets of more than `group` suffixes."""
    found = docs.select(F.col(text_col).cast("binary")).mapInArrow(_counts(window, buckets), "level long, at long, n long").groupBy("level", "at").agg(F.sum("n").alias("n"))
    hot = found.filter(F.col("n") > group).select("level", "at").toArrow()  # at most suffixes / group rows a level
    level, at = hot.column("level").to_numpy(), hot.column("at").to_numpy()
    return {k: np.sort(at[level == k]) for k in _levels(window)[:-1]}


def _dealt(docs: DataFrame, id_col: str, text_col: str, block: int, cuts: int) -> tuple[DataFrame, int]:
    """docs with the number of their block (_block), and the bytes of all texts."""
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    sizes = written(docs.select(F.col(id_col).alias("_id"), size.alias("_bytes")).groupBy("_id").agg(F.sum("_bytes").alias("_bytes")))
    whole, nameless = sizes.agg(F.coalesce(F.sum("_bytes"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("_id").isNull(), F.col("_bytes"))), F.lit(0))).first()
    heavy = F.col("_bytes") > block
    # a heavy id is followed by ranks of at least two more, so it has one of its own
    ranks = prefix_sums(sizes.filter("_id is not null"), ["_id"], "_bytes")
    ranks = written(ranks.select("_id", (2 * F.floor(F.col("sum_before") / block) + heavy.cast("long")).alias("_rank"), F.when(heavy, F.ceil(F.col("_bytes") / block)).otherwise(1).cast("long").alias("_parts")))
    dropped(sizes)
    begins = written(ranks.groupBy("_rank").agg(F.min("_id").alias("_id"), F.max("_parts").alias("_parts")))
    last, rest = 2 * (whole // block) + 2, 1 + nameless // block
    mixed = F.xxhash64(*docs.columns)
    kind = dict(docs.dtypes)[id_col]
    if kind in ("bigint", "int", "smallint", "tinyint") and begins.limit(cuts + 1).count() <= cuts:
        at = begins.orderBy("_id").toArrow()
        first, rank, parts = (at.column(c).to_numpy().astype(np.int64) for c in ("_id", "_rank", "_parts"))

        @F.pandas_udf("long")
        def numbered(ids, hashes):
            i = np.searchsorted(first, ids.to_numpy(np.int64), "right") - 1
            return pd.Series((rank[i] << SPLIT) + hashes.to_numpy(np.int64) % parts[i])

        named = numbered(F.coalesce(F.col(id_col), F.lit(0)).cast("long"), mixed) if len(first) else F.lit(0).cast("long")
        out = docs
    else:
        out = docs.withColumn("_mixed", mixed).join(ranks.withColumnRenamed("_id", id_col), id_col, "left").select(*docs.columns, "_rank", "_parts", "_mixed")
        named = F.shiftleft("_rank", SPLIT) + F.pmod("_mixed", "_parts")
        mixed = F.col("_mixed")
    unnamed = F.lit(last << SPLIT).cast("long") + F.pmod(mixed, F.lit(rest).cast("long"))
    return out.withColumn("_block", F.when(F.col(id_col).isNull(), unnamed).otherwise(named)).select(*docs.columns, "_block"), whole


def _hand_out(window: int, split: dict[int, np.ndarray], groups: np.ndarray, buckets: int, text_at: str):
    """A block's subtrees, in leaf order, to the groups of their prefixes: the prefixes, the number of leaves below each, the leaves."""

    def run(docs: pa.Table) -> pa.Table:
        block = docs.column("_block")[0].as_py()
        _, label = _suffixes(*word_ids(docs.column(text_at)), window)
        leaf, once = np.unique(label[window], return_index=True)
        prefix, open_ = leaf.copy(), np.ones(len(leaf), bool)  # a window that is split at every level is a prefix of its own
        for k in _levels(window)[:-1]:
            own = label[k][once]
            now = open_ & ~np.isin(_bucket(own, buckets), split[k])
            prefix[now] = _hashed(own[now] + np.uint64(k))
            open_ &= ~now
        to, prefix = (prefix % np.uint64(len(groups))).astype(np.int64), (prefix >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((leaf, prefix, to))
        to, prefix, leaf = to[order], prefix[order], leaf[order]
        tree = np.flatnonzero((np.diff(prefix, prepend=~prefix[:1]) != 0) | (np.diff(to, prepend=-1) != 0))
        size = np.diff(tree, append=len(to)).astype(np.uint32)
        first = np.flatnonzero(np.diff(to[tree], prepend=-1))  # trees at which a group begins
        cuts = tree[first]
        return pa.table({
            "grp": pa.array(groups[to[cuts]]), "block": pa.array(np.full(len(first), block, np.int64)),
            "prefixes": pa.array([_planes(x, 4) for x in np.split(prefix[tree], first[1:])] if len(first) else [], pa.binary()),
            "sizes": pa.array([_planes(x, 4) for x in np.split(size, first[1:])] if len(first) else [], pa.binary()),
            "leaves": pa.array([_planes(x) for x in np.split(leaf, cuts[1:])] if len(first) else [], pa.binary()),
        })

    return run


def _inner_nodes(part: pa.Table) -> pa.Table:
    """For each block of a later rank in a run of equal leaves, the labels that an earlier rank holds."""
    order = np.argsort(part.column("block").to_numpy(), kind="stable")
    blocks = part.column("block").to_numpy()[order]
    column = lambda name: [part.column(name)[int(i)].as_py() for i in order]
    prefix = np.concatenate([np.repeat(_values(p, 4), _values(n, 4)) for p, n in zip(column("prefixes"), column("sizes"))])
    leaves = [_values(x) for x in column("leaves")]
    at = np.repeat(np.arange(len(leaves), dtype=np.int32), [len(x) for x in leaves])
    leaf = np.concatenate(leaves)
    sort = np.lexsort((leaf, prefix))  # stable: earlier ranks first
    leaf, at, prefix = leaf[sort], at[sort], prefix[sort]
    first = np.flatnonzero(np.concatenate(([True], (leaf[1:] != leaf[:-1]) | (prefix[1:] != prefix[:-1]))))
    rank = blocks[at] >> SPLIT
    again = rank > np.repeat(rank[first], np.diff(first, append=len(leaf)))
    leaf, at = leaf[again], at[again]
    sort = np.lexsort((leaf, at))
    leaf, at = leaf[sort], at[sort]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return pa.table({"block": pa.array(blocks[at[first]] if len(first) else [], pa.int64()), "labels": pa.array([_planes(x) for x in np.split(leaf, first[1:])] if len(first) else [], pa.binary())})


def removed_words(texts: pa.ChunkedArray, keys: list, told: np.ndarray, window: int) -> list[np.ndarray]:
    """Which words of each document of a block go; keys: the doc_ids, None for null; told: labels that earlier blocks hold."""
    rank = {k: i for i, k in enumerate(sorted({k for k in keys if k is not None}))}
    rank = np.array([rank.get(k, len(rank)) for k in keys], np.int64)
    order = np.argsort(rank, kind="stable")
    ids, row = word_ids(texts.take(pa.array(order)))
    at, label = _suffixes(ids, row, window)
    every, doc = label[window], rank[order][row[at]]
    _, first, own = np.unique(every, return_index=True, return_inverse=True)  # the first stands in the smallest doc_id
    goes = doc > doc[first][own]
    if len(told) and len(every):
        told = np.unique(told)
        goes |= told[np.minimum(np.searchsorted(told, every), len(told) - 1)] == every
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[at[goes]] += 1
    edge[at[goes] + window] -= 1
    parts = np.split(np.cumsum(edge[:-1]) > 0, np.cumsum(np.bincount(row, minlength=len(keys)))[:-1])
    out = [parts[0]] * len(keys)
    for i, part in zip(order, parts):
        out[i] = part
    return out


def _without(text: bytes, gone: np.ndarray) -> bytes:
    """The text without its removed words and the white space that follows each."""
    spans = [m.span() for m in WORD.finditer(text)]
    begins = [a for a, _ in spans] + [len(text)]
    return text[: begins[0]] + b"".join(text[begins[i] : begins[i + 1]] for i in np.flatnonzero(~gone))


def _finish(window: int, id_at: str, text_at: str, schema: pa.Schema, digest: bool):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        texts, keys = docs.column(text_at), docs.column(id_at).to_pylist()
        labels = [_values(x.as_py()) for x in told.column("labels")]
        gone = removed_words(texts, keys, np.concatenate(labels) if labels else np.zeros(0, np.uint64), window)
        if digest:
            kept = [b" ".join(compress((t.as_py() or b"").split(), (~g).tolist())) for t, g in zip(texts, gone)]
            return pa.table([docs.column(id_at), pa.array([len(g) for g in gone], pa.int64()), pa.array([int(g.sum()) for g in gone], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])], schema=schema)
        new = pa.array([_without(t.as_py(), g).strip() if g.any() else t.as_py() for t, g in zip(texts, gone)], pa.binary())
        out = docs.drop_columns("_block")
        out = out.set_column(out.schema.get_field_index(text_at), text_at, new.cast(pa.string()))
        return out.append_column("n_words", pa.array([len(g) for g in gone], pa.int64())).append_column("n_removed", pa.array([int(g.sum()) for g in gone], pa.int64())).cast(schema)

    return run


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group: int = GROUP, block: int = BLOCK, buckets: int = BUCKETS, cuts: int = CUTS, digest: bool = False) -> DataFrame:
    """docs with repeated passages cut out of the text, and n_words, n_removed; digest: only doc_id, these and kept_sha256."""
    docs = docs.drop(*(c for c in docs.columns if c in ("_block", "_rank", "_parts", "_mixed")))
    if digest:
        docs = docs.select(id_col, text_col)
    elif {"n_words", "n_removed"} & set(docs.columns):
        docs = docs.drop("n_words", "n_removed")
    dealt, size = _dealt(docs, id_col, text_col, block, cuts)
    # a word has some six bytes
    groups = 1 + size // 6 // group
    parts = min(PARTS, groups)
    while buckets < 16 * groups:
        buckets *= 2
    split = _split_prefixes(docs, text_col, window, group, buckets)
    schema = T.StructType([f for f in docs.schema.fields])
    dealt = dealt.withColumn(text_col, F.col(text_col).cast("binary")).repartition(min(PARTS, 1 + size // PART), "_block")
    handed = dealt.groupBy("_block").applyInArrow(_hand_out(window, split, apart(docs.sparkSession, groups, parts), buckets, text_col), "grp long, block long, prefixes binary, sizes binary, leaves binary")
    told = handed.repartition(parts, "grp").groupBy("grp").applyInArrow(_inner_nodes, "block long, labels binary").withColumnRenamed("block", "_block")
    if digest:
        out = T.StructType([schema[id_col], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    else:
        out = T.StructType([*schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    return dealt.groupBy("_block").cogroup(told.groupBy("_block")).applyInArrow(_finish(window, id_col, text_col, to_arrow_schema(out), digest), out)


def op9_substring(spark, sf_dir) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), starts AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 12), ' ')) AS h2
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)
), firsts AS (
  SELECT h2, min(doc_id) AS first FROM starts GROUP BY h2
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM starts JOIN firsts USING (h2) WHERE doc_id > first
), goes AS (
  SELECT doc_id, list(i) AS spots FROM gone GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(spots), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN spots IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(spots, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN goes USING (doc_id)
"""
