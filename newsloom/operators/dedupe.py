"""De-duplication against a history and, in rank order, within a batch.

An item is dropped if its id or title fingerprint was sent before, if it resembles a sent item of its category, or if an item
that ranks before it and is itself kept has its fingerprint or resembles it. Resembling: Jaccard of significant tokens at
least SIMILAR, and the earlier side has LEAST_TOKENS tokens or more.

The batch decision depends on earlier decisions, so it is taken in rounds over a graph: an item is kept once no undecided and
no kept item before it conflicts with it, and dropped once a kept one does. Items of one fingerprint, and items of one
category and token set, are groups of which only extremes matter (the first kept, the first undecided), so copies never become
pairs. A round looks only around what the last one decided; what is open in the end and few is passed by one task. Pairs of different token sets come from a prefix-filtered similarity join: under a global order of tokens, rarest
first, two sets with the required overlap share a token among their first few, or two where the token is frequent; bits of their tokens' parity
drop most candidates before they are shuffled.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import LEAST_TOKENS, SIMILAR, jaccard, title_fingerprint, tokens
from ..functions.text import filled
from ..functions.urls import item_id
from ..sources.tables import scratch, written


#: A token that more sets hold is a key of the join only together with another one, so that a row of a key meets few others.
FREQUENT = 1000
#: Open items, and pairs of sets, that one task passes at most: some 100 MB.
FEW = 300_000


def with_keys(items: DataFrame) -> DataFrame:
    """Adds id, title_fingerprint and content_tokens."""
    text = filled(F.col("summary"), F.col("raw_text")) if "raw_text" in items.columns else F.col("summary")
    return items.withColumns({"id": item_id(F.col("url"), F.col("title")), "title_fingerprint": title_fingerprint(F.col("title")), "content_tokens": tokens(F.col("title"), text)})


def unsent(items: DataFrame, history: DataFrame) -> DataFrame:
    """Items whose id and title fingerprint the history does not hold."""
    ids = history.select("id").filter("id is not null").distinct()
    prints = history.select("title_fingerprint").filter("title_fingerprint <> ''").distinct()
    return items.join(ids, "id", "left_anti").join(prints, "title_fingerprint", "left_anti")


def token_order(sets: DataFrame) -> DataFrame:
    """token (a hash), df: the tokens that more than one set holds, and how many do."""
    words = sets.select(F.explode(F.array_distinct("tokens")).alias("word")).select(F.xxhash64("word").alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).cast("int").alias("df")).filter("df > 1")


def prefixes(sets: DataFrame, order: DataFrame, least: float, frequent: int = FREQUENT) -> DataFrame:
    """The columns of sets but for tokens, and size, place, token, low, high: of each set the keys of which two similar sets share one.

    A key is a token among the first of the set under the order, which are the rarest, or, where more than `frequent` sets hold that token, it and a next
    one: similar sets of two tokens or more have a second one in common too. place: at most so many tokens are before those that two sets can
    share if this key is their first common one. low, high: parity bits of the set's tokens. Neither the sets nor their other tokens travel with these rows.
    """
    rest, tokens = [c for c in sets.columns if c != "tokens"], F.array_distinct("tokens")
    rows = sets.select(*rest, F.size(tokens).alias("size"), F.explode(F.transform(tokens, lambda x: F.xxhash64(x))).alias("token")).join(order.select("token", "df"), "token", "left")
    parity = lambda half: F.bit_xor(F.when(F.col("token").bitwiseAND(F.lit(64)) == half, F.expr("shiftleft(1L, cast(token & 63 as int))")).otherwise(F.lit(0).cast("long")))
    ranked = F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "token")))
    rows = rows.groupBy(*rest, "size").agg(ranked.alias("ranked"), parity(0).alias("low"), parity(64).alias("high"))
    common = F.ceil(F.col("size") * least - 1e-9).cast("int")  # tokens that a similar set shares at least
    key = lambda place, token: F.struct(place.cast("int").alias("place"), token.alias("token"))
    first = F.transform(F.slice("ranked", F.lit(1), F.col("size") - common + 1), lambda x, i: F.struct(x["df"].alias("df"), x["token"].alias("token"), i.alias("i")))
    alone = F.transform(F.filter(first, lambda x: (x["df"] <= frequent) | (common < 2)), lambda x: key(x["i"], x["token"]))
    after = lambda x: F.slice("ranked", x["i"] + 2, F.col("size") - common + 1 - x["i"])
    double = F.transform(F.filter(first, lambda x: x["df"] > frequent), lambda x: F.transform(after(x), lambda y, k: key(x["i"] + k, F.xxhash64(x["token"], y["token"]))))
    return rows.select(*rest, "size", "low", "high", F.explode(F.concat(alone, F.flatten(double))).alias("_key")).select(*rest, "size", "low", "high", "_key.place", "_key.token")


def may_be_similar(least: float, a: str = "a_", b: str = "b_"):
    """May the sets of two rows of prefixes() with one key be similar? By category, sizes, the tokens that can still follow, and parity bits: an odd bit is a token that only one has."""
    (n, i), (m, j) = ((F.col(f"{x}size"), F.col(f"{x}place")) for x in (a, b))
    enough = F.least(n - i, m - j) >= (n + m) * (least / (1 + least)) - 1e-9
    odd = sum(F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in ("low", "high"))
    same = (F.col(f"{a}token") == F.col(f"{b}token")) & F.col(f"{a}category").eqNullSafe(F.col(f"{b}category"))
    return same & (n >= m * least - 1e-9) & (m >= n * least - 1e-9) & enough & (odd <= (n + m) * ((1 - least) / (1 + least)) + 1e-9)


def named(rows: DataFrame, side: str) -> DataFrame:
    """rows with `side` before the name of every column."""
    return rows.select([F.col(c).alias(f"{side}{c}") for c in rows.columns])


def similar_sets(left: DataFrame, right: DataFrame | None = None, least: float = SIMILAR, smallest: int = 1, frequent: int = FREQUENT) -> DataFrame:
    """(left key, right key, similarity) of sets of one category with Jaccard at least `least`. Sets: key (unique), category, tokens.

    Without `right`, the sets of `left` are compared with the others among them that have `smallest` tokens or more. A pair is a candidate if what
    prefixes() tells of both allows the similarity; each candidate is verified once.
    """
    # sets are numbered, so that a long and not their key travels with each token
    numbered = lambda sets: written(sets.filter(F.size("tokens") > 0).select("key", "category", "tokens").withColumn("n", F.monotonically_increasing_id()))
    one = numbered(left)
    two = one if right is None else numbered(right)
    order = token_order(one if right is None else one.select("tokens").union(two.select("tokens")))
    keys = lambda sets: prefixes(sets.select("n", "category", "tokens"), order, least, frequent)
    if right is None:
        shared = written(keys(one))
        found = named(shared, "a_").join(named(shared, "b_"), may_be_similar(least) & (F.col("a_n") < F.col("b_n")))
    else:
        found = named(keys(one), "a_").join(named(keys(two), "b_"), may_be_similar(least))
    slim = lambda sets, side: named(sets.select("n", "key", "tokens"), side)
    found = found.select("a_n", "b_n").distinct().join(slim(one, "a_"), "a_n").join(slim(two, "b_"), "b_n")
    found = found.select("a_key", "b_key", jaccard(F.col("a_tokens"), F.col("b_tokens")).alias("similarity"), F.size("a_tokens").alias("_a"), F.size("b_tokens").alias("_b")).filter(F.col("similarity") >= least)
    if right is None:
        way = lambda a, b: F.struct(F.col(f"{a}_key").alias("a_key"), F.col(f"{b}_key").alias("b_key"), "similarity", F.col(f"_{b}").alias("size"))
        found = found.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("_pair")).select("_pair.*").filter(F.col("size") >= smallest)
    return found.select("a_key", "b_key", "similarity")


def unlike_history(items: DataFrame, history: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Items that resemble no history record of their category. items: id, category and content_tokens."""
    key, sets = set_key(), written(token_sets(items))
    known = history.select(F.coalesce("category", F.lit("GERAL")).alias("category"), F.col("content_tokens").alias("tokens")).filter(F.size("tokens") >= LEAST_TOKENS).distinct().withColumn("key", key)
    return without_sets(items, similar_sets(sets, known, least).select(F.col("a_key").alias("key")).distinct().join(sets, "key"))


def set_key():
    """Name of a set: category and tokens."""
    return F.sha2(F.concat_ws("\u0001", F.coalesce("category", F.lit("\u0002")), F.array_join("tokens", " ")), 256)


def token_sets(items: DataFrame) -> DataFrame:
    """category, tokens and key of the different sets of items."""
    return items.select("category", F.col("content_tokens").alias("tokens")).filter(F.size("tokens") > 0).distinct().withColumn("key", set_key())


def without_sets(items: DataFrame, sets: DataFrame) -> DataFrame:
    """Items that have none of the sets (category, tokens)."""
    hit = sets.select(F.col("category").alias("_c"), F.col("tokens").alias("_t"))
    return items.join(hit, F.col("category").eqNullSafe(F.col("_c")) & F.col("content_tokens").eqNullSafe(F.col("_t")), "left_anti")


def _around(near: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets themselves and those that one of them, if it is kept earlier, drops. sets: _set."""
    return sets.unionByName(near.join(sets, near.b_key == sets["_set"]).select(F.col("a_key").alias("_set"))).distinct()


def _decided(candidates: DataFrame, others: DataFrame, near: DataFrame) -> DataFrame:
    """Candidates that are decided, with their _state: dropped (2) if a kept one (1) before them stands in the way, kept if no open one (0) does."""
    first = lambda s: F.min(F.when(F.col("_state") == s, F.col("_rank")))
    prints = others.join(candidates.select("_print").distinct(), "_print", "left_semi").groupBy("_print").agg(first(1).alias("_pk"), first(0).alias("_po"))
    sets = candidates.select("_set").distinct()
    rivals = near.join(sets, near.a_key == sets["_set"], "left_semi")
    wanted = sets.unionByName(rivals.select(F.col("b_key").alias("_set"))).distinct()
    each = others.filter(F.col("_n") >= LEAST_TOKENS).join(wanted, "_set", "left_semi").groupBy("_set").agg(first(1).alias("_k"), first(0).alias("_o"))
    around = rivals.join(each, rivals.b_key == each["_set"]).groupBy(F.col("a_key").alias("_set")).agg(F.min("_k").alias("_nk"), F.min("_o").alias("_no"))
    x = candidates.join(prints, "_print", "left").join(each, "_set", "left").join(around, "_set", "left")
    before = lambda *c: F.array_max(F.array(*[F.coalesce(F.col(k) < F.col("_rank"), F.lit(False)) for k in c]))
    state = F.when(before("_pk", "_k", "_nk"), 2).when(before("_po", "_o", "_no"), 0).otherwise(1)
    return x.select("_rank", "_print", "_set", "_n", state.alias("_state")).filter("_state > 0")


def _passed(rows: DataFrame, near: DataFrame) -> DataFrame:
    """_rank of the rows that the greedy pass keeps, in one task: for few rows and pairs, which the caller has counted."""
    rows = rows.select("_rank", "_print", "_set", (F.col("_n") >= LEAST_TOKENS).alias("_enough"), F.row_number().over(Window.orderBy("_rank")).alias("_place"))

    def run(rows: pa.Table, near: pa.Table) -> pa.Table:
        rows, follow = rows.sort_by("_place"), {}
        for a, b in zip(near.column("a_key").to_pylist(), near.column("b_key").to_pylist()):
            follow.setdefault(b, []).append(a)
        prints, sets, kept = set(), set(), []
        for i, (title, own, enough) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("_print", "_set", "_enough")))):
            if title not in prints and own not in sets:
                kept.append(i)
                prints.add(title)
                if enough:
                    sets.add(own)
                    sets.update(follow.get(own, ()))
        return rows.take(kept).select(["_rank"])

    schema = f"_rank {rows.schema['_rank'].dataType.simpleString()}"
    return rows.withColumn("_all", F.lit(0)).groupBy("_all").cogroup(near.withColumn("_all", F.lit(0)).groupBy("_all")).applyInArrow(run, schema)


def first_of_each_event(items: DataFrame, order: list, least: float = SIMILAR, few: int = FEW) -> DataFrame:
    """The items that the greedy pass in the given order keeps. order: columns (ascending) that rank every item apart.

    items: category, title_fingerprint, content_tokens. Of items with one fingerprint and one set only the first can stay. Rounds decide what is open:
    a round looks at the neighbours of what the last one decided and writes its decisions only, so all rounds together write each item once. As soon as at
    most `few` items and pairs are open, which a count shows, one task makes the rest of the pass.
    """
    with scratch() as keep:
        columns = items.columns
        group = F.sha2(F.concat_ws("\u0001", F.coalesce("category", F.lit("\u0002")), F.array_join("content_tokens", " ")), 256)
        rows = items.withColumn("_rank", F.struct(*order)).withColumns({"_set": group, "_print": F.coalesce("title_fingerprint", F.concat(F.lit("\u0001"), F.to_json("_rank")))})
        rows = keep(written(rows))
        sets = rows.filter(F.size("content_tokens") > 0).groupBy(F.col("_set").alias("key")).agg(F.first("category").alias("category"), F.first("content_tokens").alias("tokens"))
        near = written(similar_sets(sets, least=least, smallest=LEAST_TOKENS).filter("a_key <> b_key").select("a_key", "b_key"))
        slim = written(rows.groupBy("_print", "_set").agg(F.min("_rank").alias("_rank"), F.first(F.size("content_tokens")).alias("_n")))
        kept = keep(written(_kept(slim, near, few)))
    return rows.join(kept, "_rank", "left_semi").select(columns)


def _kept(slim: DataFrame, near: DataFrame, few: int) -> DataFrame:
    """_rank of the rows that stay. slim: _rank, _print, _set and its size _n; near: sets (a_key) that another, if it is kept earlier, drops (b_key)."""
    open_, pairs, decided, fresh = slim, near, None, None
    while True:
        n = open_.limit(few + 1).count()
        done = slim.select("_rank").limit(0) if decided is None else decided.filter("_state = 1").select("_rank")
        if not n:
            return done
        if n <= few and pairs.limit(few + 1).count() <= few:
            return done.unionByName(_passed(open_, pairs))
        candidates, every = open_, open_.withColumn("_state", F.lit(0))
        if fresh is not None:
            prints, around = fresh.select("_print").distinct(), _around(near, fresh.filter(F.col("_n") >= LEAST_TOKENS).select("_set").distinct())
            touched = lambda df, key: df.withColumn(f"_by{key}", F.lit(True))
            candidates = open_.join(touched(prints, "_print"), "_print", "left").join(touched(around, "_set"), "_set", "left").filter("_by_print or _by_set").select(slim.columns)
            every = every.unionByName(decided)
        fresh = written(_decided(candidates, every, near))
        decided = fresh if decided is None else decided.unionByName(fresh)
        open_ = slim.join(decided.select("_rank"), "_rank", "left_anti")
        left = open_.select("_set").distinct()
        pairs = near.join(left, near.a_key == left["_set"], "left_semi").join(left, near.b_key == left["_set"], "left_semi")


def _with_category(items: DataFrame) -> DataFrame:
    """Keys, and the category that a classification gave."""
    keyed = with_keys(items)
    return keyed if "category" in keyed.columns else keyed.withColumn("category", F.col("classification.category"))


def select_unseen(items: DataFrame, history: DataFrame, order: list, least: float = SIMILAR, unlike=unlike_history) -> DataFrame:
    """Keys added, sent and resembling items dropped, and the first of each event kept. unlike: what drops the resembling ones."""
    # keys are made from whole texts and read several times below
    keyed = written(unsent(_with_category(items), history))
    return first_of_each_event(unlike(keyed, history, least), order, least)


def first_unseen(items: DataFrame, history: DataFrame, order: list, most: int, least: float = SIMILAR, begin: int = 20, whole: int = 10_000, unlike=unlike_history) -> DataFrame:
    """The first `most` items, in order, that select_unseen keeps.

    A decision depends only on items that rank before, so it is taken on a prefix of `begin` times as many items, which grows until it
    yields enough; from `whole` items on, all are decided.
    """
    size = max(1, most) * begin
    while most and size < whole:
        first = written(items.orderBy(*order).limit(size))
        n = first.count()
        if not n:
            return _with_category(first)
        kept = written(select_unseen(first, history, order, least, unlike))
        if kept.count() >= most or n < size:
            return kept.orderBy(*order).limit(most)
        size *= 8
    return select_unseen(items.limit(0) if not most else items, history, order, least, unlike).orderBy(*order).limit(most)
