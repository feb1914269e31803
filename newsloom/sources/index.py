"""An inverted index of the history's token sets, so that a run compares its new items with those that share a rare token, not with the whole history.

The index is one table behind a commit log, in folders by `bucket`, with three kinds of rows: postings (a key of a set's prefix, which is a token or
two: token, key, category, size, place, low, high), sets (key, tokens) and the order (a token and how many sets had it when the index was made). Two sets that are similar share a token
of their prefixes under one order, rarest first; so the order stays as it is until the index is made anew, and tokens that it does not hold are the rarest. A run reads
of each kind only the folders of its own tokens and of the candidates' keys.

The index follows the log of the history: a commit says which parts of the history it holds. New parts add their sets; where parts have become one, or a
new part replaces a record, the index is made anew, in the same number of steps. A crash between the two logs leaves the index behind, never ahead,
and the next run catches up. Sets without a date count always; of a set that was sent again the last date counts.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.similarity import LEAST_TOKENS, SIMILAR, jaccard
from ..operators.dedupe import may_be_similar, named, prefixes, set_key, token_order, token_sets, without_sets
from .log import CommitLog, Conflict
from .tables import scratch, small_enough, written

BUCKETS = 64
#: The form of the rows; an index of another form is made anew.
FORM = 2
ROWS = T.StructType(
    [T.StructField("token", T.LongType()), T.StructField("key", T.StringType()), T.StructField("category", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("place", T.IntegerType())]
    + [T.StructField("low", T.LongType()), T.StructField("high", T.LongType())]
    + [T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("sent_at", T.TimestampType()), T.StructField("bucket", T.IntegerType())]
)
POSTING, SET, ORDER = 0, 1, 2


def _of(kind: int, value: Column) -> Column:
    """The folder of a row of a kind."""
    return (F.pmod(F.xxhash64(value), F.lit(BUCKETS)) + kind * BUCKETS).cast("int")


def _tokens(sets: DataFrame) -> DataFrame:
    return sets.select(F.explode("tokens").alias("word")).select(F.xxhash64("word").alias("token"))


class TokenIndex:
    def __init__(self, spark: SparkSession, folder: str, least: float = SIMILAR):
        self.spark, self.least = spark, least
        self.log = CommitLog(spark, folder, ROWS, None, by="bucket")

    def _read(self, kind: int, buckets: DataFrame) -> DataFrame:
        """The rows of a kind in the buckets (at most BUCKETS numbers) of a one-column table."""
        wanted = [r[0] for r in buckets.distinct().collect()]
        return self.log.load().filter(F.col("bucket").isin(wanted) if wanted else F.lit(False))

    def _order(self, tokens: DataFrame) -> DataFrame:
        """token, df of those of `tokens` (token) that the order holds."""
        rows = self._read(ORDER, tokens.select(_of(ORDER, F.col("token"))))
        return rows.select("token", F.col("size").alias("df"))

    def _rows(self, sets: DataFrame, order: DataFrame) -> DataFrame:
        """Postings and sets."""
        none = {f.name: F.lit(None).cast(f.dataType) for f in ROWS.fields}
        postings = prefixes(sets, order, self.least)
        postings = postings.withColumns({"tokens": none["tokens"], "bucket": _of(POSTING, F.col("token"))})
        kept = sets.withColumns({c: none[c] for c in ("token", "size", "place", "low", "high")} | {"bucket": _of(SET, F.col("key"))})
        return postings.select(ROWS.names).unionByName(kept.select(ROWS.names))

    @staticmethod
    def _sets(history: DataFrame) -> DataFrame:
        """category, tokens, key and last date of the sets of history records that later items are compared with."""
        rows = history.select(F.coalesce("category", F.lit("GERAL")).alias("category"), F.col("content_tokens").alias("tokens"), "sent_at").filter(F.size("tokens") >= LEAST_TOKENS)
        last = F.when(F.count(F.lit(1)) == F.count("sent_at"), F.max("sent_at")).alias("sent_at")  # without a date: for ever
        return rows.groupBy("category", "tokens").agg(last).withColumn("key", set_key())

    def rebuild(self, history: DataFrame, expected: int | None = None, note: dict | None = None) -> None:
        """The index of a history, with a new order."""
        with scratch():
            sets = written(self._sets(history))
            order = written(token_order(sets))
            none = {f.name: F.lit(None).cast(f.dataType) for f in ROWS.fields if f.name not in ("token", "size", "bucket")}
            listed = order.select("token", F.col("df").alias("size"), _of(ORDER, F.col("token")).alias("bucket")).withColumns(none)
            self.log.commit(self._rows(sets, order).unionByName(listed.select(ROWS.names)), expected, whole=True, note=note or {})

    def extend(self, records: DataFrame, expected: int | None = None, note: dict | None = None) -> None:
        """Add the sets of new records; the cost is theirs."""
        with scratch():
            sets = written(self._sets(records))
            tokens = _tokens(sets)
            self.log.commit(self._rows(sets, small_enough(self._order(tokens))), expected, note=note)

    def follow(self, history: CommitLog) -> None:
        """Catch up with the log of the history."""
        while True:
            at, now = self.log.current()
            held, parts = now.get("note", {}).get("of", []), history.current()[1]["parts"]
            new = [p for p in parts if p not in held]
            if not new and (not held or now["note"].get("form") == FORM):
                return
            note = {"of": parts, "form": FORM}
            try:
                if now.get("note", {}).get("form") != FORM or not held or held[0] != parts[0] or len(now["parts"]) > 20 or self._replaced(history, [p for p in parts if p in held], new):
                    self.rebuild(history.load(), at, note)
                else:
                    self.extend(history._table(new), at, note)
                return
            except Conflict:
                continue

    @staticmethod
    def _replaced(history: CommitLog, old: list[str], new: list[str]) -> bool:
        """Does a new part hold a record again? Reads keys only."""
        fresh = history._table(new).select(history.key).filter(F.col(history.key).isNotNull()).distinct()
        return bool(history._table(old).select(history.key).join(small_enough(fresh), history.key, "left_semi").head(1))

    def resembling(self, items: DataFrame, oldest: datetime | None = None, least: float | None = None) -> DataFrame:
        """category, tokens of the sets of items that resemble a set of their category in the index sent at `oldest` or later."""
        # sets are numbered, so that a long and not their key travels with each token
        sets = written(token_sets(items).select("category", "tokens").withColumn("n", F.monotonically_increasing_id()))
        probes = written(prefixes(sets, small_enough(self._order(_tokens(sets))), self.least))
        postings = self._read(POSTING, probes.select(_of(POSTING, F.col("token"))))
        young = F.col("sent_at").isNull() | (F.col("sent_at") >= F.lit(oldest).cast("timestamp")) if oldest else F.lit(True)
        postings = named(postings.filter(young).select("key", *[c for c in probes.columns if c != "n"]), "b_")
        found = written(postings.join(named(small_enough(probes), "a_"), may_be_similar(self.least)).select(F.col("a_n").alias("n"), "b_key").distinct())
        known = self._read(SET, found.select(_of(SET, F.col("b_key")))).select(F.col("key").alias("b_key"), F.col("tokens").alias("b_tokens")).join(small_enough(found.select("b_key").distinct()), "b_key", "left_semi")
        pairs = found.join(known.dropDuplicates(["b_key"]), "b_key").join(sets, "n")
        return pairs.filter(jaccard(F.col("tokens"), F.col("b_tokens")) >= (least or self.least)).select("category", "tokens").distinct()

    def against(self, run_at: datetime, days: int):
        """A function like unlike_history that asks the index: (items, history, least) -> items."""

        def unlike(items: DataFrame, history: DataFrame, least: float = SIMILAR) -> DataFrame:
            if least < self.least:
                raise ValueError("the index was made for a higher similarity")
            return without_sets(items, self.resembling(items, run_at - timedelta(days=days), least))

        return unlike
