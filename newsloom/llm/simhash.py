"""SimHash near-duplicates by pigeonring filtering.

A 64-bit fingerprint is cut into one ring segment more than the bits in which two may differ (five for a limit of 4). If two fingerprints
differ in at most `limit` bits, some ring position starts a chain whose first k segments together differ in at most k * limit /
(limit + 1), so k - 1, bits, for every k (Qin and Xiao's pigeonring principle). So at that position the first segment is equal, the first two
differ in at most one bit, the first three in at most two, and so on. The index holds every fingerprint under its (position, segment,
next segment) keys; every fingerprint asks for the same keys with at most one bit of the next segment flipped. The longer chains and
then the full Hamming distance are tested where they meet.

`near_duplicates` takes any number of words a shingle, any limit from 3 to 7 bits and any number of independent fingerprints a text; `op4_simhash` takes
four words, 4 bits and one.

Equal fingerprints are one node from the start, so exact copies cost one row. A task never emits all pairs: it joins what it
finds to a star forest with at most one link a fingerprint. Keys with over BLOCK indexed fingerprints are dealt out in
blocks of index rows and of asking rows, each pair of blocks a group of its own.

Null and blank texts have fingerprint zero and link like any other. Null doc_id: never the smallest of its group, unless
all are null (then component_id is null). Repeated rows come back as often as they stand. Empty table: no rows. Other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, small_enough, table, written

WORDS, LIMIT, SEED = 4, 4, 42


def ring(limit: int) -> list[tuple[int, int]]:
    """Lowest bit and number of bits of the limit + 1 segments of a fingerprint."""
    if not 3 <= limit <= 7:
        raise ValueError("limits are 3 to 7 bits")
    edge = [-(-64 * i // (limit + 1)) for i in range(limit + 2)]
    return [(a, b - a) for a, b in zip(edge, edge[1:])]


#: Index rows and asking rows of one key that may meet in one group.
BLOCK = 20_000
PAIRS = 2_000_000
#: Rows of whole groups that a task holds at a time.
CHUNK = 500_000
#: Fingerprints whose components are broadcast at most.
NAMED = 500_000
PIECE = 1 << 19
BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes, size: int) -> Iterator[bytes]:
    """A text in pieces of about `size` bytes, cut at white space."""
    at = 0
    while at < len(text):
        cut = BLANK.search(text, min(len(text), at + size))
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def fingerprint(text: bytes | None, words: int = WORDS, seed: int = SEED, piece: int = PIECE, prints: int = 1) -> np.ndarray:
    """`prints` signed 64-bit SimHashes of the word shingles of a UTF-8 text; a very long text is never held as words at once."""
    from xxhash import xxh64_intdigest

    counts, n, tail = np.zeros((prints, 64), np.int64), 0, []
    for part in _pieces(text or b"", piece):
        found = tail + part.lower().split()
        if len(found) >= words:
            n += _add(counts, found, words, seed, xxh64_intdigest)
            found = found[len(found) - words + 1 :]
        tail = found
    if not n and tail:
        n = _add(counts, tail, len(tail), seed, xxh64_intdigest)
    return np.packbits(counts * 2 > n, axis=1, bitorder="little").view("<i8")[:, 0] if n else np.zeros(prints, np.int64)


def _add(counts: np.ndarray, found: list[bytes], words: int, seed: int, digest) -> int:
    """Adds the bits of all shingles of `found` to counts; their number. The first print takes the digests, later ones mix them anew."""
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(found) - words + 1].tolist()
    hashes = np.fromiter((digest(joined[i:j], seed) for i, j in zip(starts, (ends[words - 1 :] - 1).tolist())), "<u8", len(starts))
    for k in range(len(counts)):
        if k:
            hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
            hashes ^= hashes >> np.uint64(29)
        counts[k] += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return len(starts)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, prints: int = 1) -> DataFrame:
    """doc_id, fps (array of `prints` longs) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                found = [fingerprint(t.as_py(), words, prints=prints) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "fps"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fps array<long>")


def _segment(fp: np.ndarray, segment: tuple[int, int]) -> np.ndarray:
    low, bits = segment
    return (fp >> np.uint64(low)) & np.uint64((1 << bits) - 1)


def _keys(asking: bool, limit: int = LIMIT):
    """Rows (key, fp, asks): those of the index, one a segment, and, if `asking`, those with at most one flipped bit that ask."""

    segments = ring(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 20_000):
                fp = b.column(0).slice(at, 20_000).to_numpy(zero_copy_only=False).astype("<i8").view("<u8")
                for i, (own, after) in enumerate(zip(segments, segments[1:] + segments[:1])):
                    head = (np.uint64(i) << np.uint64(32)) | (_segment(fp, own) << np.uint64(16))
                    near = _segment(fp, after)
                    flips = [0, 0, *(1 << j for j in range(after[1]))] if asking else [0]
                    for k, flip in enumerate(flips):
                        key = head | (near ^ np.uint64(flip))
                        yield pa.RecordBatch.from_arrays([pa.array(key.view("<i8")), pa.array(fp.view("<i8")), pa.array(np.full(len(fp), k > 0))], ["key", "fp", "asks"])

    return run


def _stars(n: int, root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root with the links a-b added: the smallest index that each of n nodes reaches."""
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(up := root[root], root):
            root = up
        left = root[a] != root[b]
        a, b = a[left], b[left]
    return root


def _linked(batches: Iterator[pa.RecordBatch], limit: int = LIMIT, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Star links among the fingerprints that meet. Rows come by group, index rows first; about `most` rows are held at a time,
    whole groups of them."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n > most:
            part = pa.Table.from_batches(held).combine_chunks()
            group = part.column("group").to_numpy()
            last = int(np.searchsorted(group, group[-1]))  # the last group may go on
            if last:
                yield _stars_of(part.slice(0, last), limit)
            held, n = part.slice(last).to_batches(), n - last
    if n:
        yield _stars_of(pa.Table.from_batches(held), limit)


def _stars_of(part: pa.Table, limit: int = LIMIT) -> pa.RecordBatch:
    segments = ring(limit)
    group, fp, asks = (part.column(c).to_numpy() for c in ("group", "fp", "asks"))
    fp = fp.view("<u8")
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    ends = np.concatenate((first[1:], [len(group)]))
    asked = ends - np.add.reduceat(asks.astype(np.int64), first)  # index rows of a group stand in first..asked
    nodes, own = np.unique(fp, return_inverse=True)
    root = np.arange(len(nodes))
    # every asking row with the index rows of its group, PAIRS at a time
    rows = np.flatnonzero(asks)
    at = np.searchsorted(first, rows, "right") - 1
    n = (asked - first)[at]
    rows, at, n = rows[n > 0], at[n > 0], n[n > 0]
    done, cuts = 0, np.cumsum(n)
    while done < len(rows):
        upto = max(done + 1, int(np.searchsorted(cuts, (cuts[done - 1] if done else 0) + PAIRS, "right")))
        k = n[done:upto]
        left = np.repeat(rows[done:upto], k)
        right = np.repeat(first[at[done:upto]], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        place = (group[left] >> 32) % 8
        apart = fp[left] ^ fp[right]
        for i in range(len(segments)):  # the chain that starts at the key's ring position
            mine = np.flatnonzero(place == i)
            bad, total = np.zeros(len(mine), bool), np.zeros(len(mine), np.int64)
            for length in range(1, len(segments) + 1):
                total += np.bitwise_count(_segment(apart[mine], segments[(i + length - 1) % len(segments)]))
                bad |= total > length - 1
            place[mine[bad]] = -1
        keep = (place >= 0) & (np.bitwise_count(apart) <= limit) & (apart > 0)
        root = _stars(len(nodes), root, own[left[keep]], own[right[keep]])
        done = upto
    out = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[out].view("<i8")), pa.array(nodes[root[out]].view("<i8"))], ["a", "b"])


def links(nodes: DataFrame, block: int = BLOCK, limit: int = LIMIT) -> DataFrame:
    """a, b: links that connect the distinct fingerprints `fp` of `nodes` just as all pairs within the limit would."""
    rows = nodes.select("fp").mapInArrow(_keys(True, limit), "key long, fp long, asks boolean")
    hot = nodes.select("fp").mapInArrow(_keys(False, limit), "key long, fp long, asks boolean").groupBy("key").count().filter(F.col("count") > block)
    parts = (F.col("count") / block).cast("int") + 1
    hot = written(hot.select("key", parts.alias("parts")))
    group = F.col("key")
    if hot.head(1):
        rows = rows.join(small_enough(hot, 100_000), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        mine = F.pmod(F.xxhash64("fp"), F.col("parts").cast("long"))
        # index row: its block against every asking block; asking row: the other way round
        rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
        pair = F.when(F.col("asks"), mine * F.col("parts") + F.col("o")).otherwise(F.col("o") * F.col("parts") + mine)
        group = F.col("key") + F.shiftleft(pair.cast("long"), 35)
    return rows.select(group.alias("group"), "fp", "asks").repartition("group").sortWithinPartitions("group", "asks").mapInArrow(lambda batches: _linked(batches, limit), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, prints: int = 1, limit: int = LIMIT) -> DataFrame:
    """doc_id, fp (the first fingerprint), component_id (smallest doc_id reachable) of every row.

    Rows link if any of their `prints` fingerprints differ in at most `limit` bits. One fingerprint meets few pairs of shingle similarity
    0.8; independent ones add up.
    """
    key = F.col("fps")[0] if prints == 1 else F.xxhash64("fps")
    fps = written(fingerprints(docs, id_col, text_col, words, prints).select("doc_id", key.alias("node"), F.col("fps")[0].alias("fp"), *[F.col("fps")[t].alias(f"fp{t}") for t in range(1, prints)]))
    # equal rows of fingerprints are one node
    nodes = written(fps.groupBy("node").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in fps.columns[2:]]))
    found = None
    for c in fps.columns[2:]:
        one = nodes.select(F.col(c).alias("fp"), "node")
        if prints == 1:
            edges = links(one, limit=limit)
        else:
            own = written(one.groupBy("fp").agg(F.min("node").alias("first")))
            near = small_enough(own, NAMED)
            edges = one.join(near, "fp").filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
            over = links(own, limit=limit).join(near.select(F.col("fp").alias("a"), F.col("first").alias("_a")), "a").join(near.select(F.col("fp").alias("b"), F.col("first").alias("_b")), "b")
            edges = edges.union(over.select("_a", "_b"))
        found = edges if found is None else found.union(edges)
    found = written(components(found)).withColumnRenamed("node", "_node")
    members = found.join(nodes.select("node", "rep"), F.col("_node") == F.col("node")).select("root", "node", "rep")
    least = members.groupBy("root").agg(F.min("rep").alias("least"))
    named = members.join(least, "root").select("node", "least")
    named = nodes.select("node", "rep").join(named, "node", "left").select("node", F.when(F.col("least").isNotNull(), F.col("least")).otherwise(F.col("rep")).alias("component_id"))
    return fps.join(small_enough(named, NAMED), "node").select("doc_id", "fp", "component_id")


def op4_simhash(spark, sf_dir) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
