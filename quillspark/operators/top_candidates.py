"""The best candidates of each query without meeting all of them (TK1): a threshold algorithm over posting lists.

A posting list holds the candidates of one word of the title or the author that share language, format and size class; so the
points for those are the same in all of a list. A query reads the lists of the words that hold its tokens. A candidate is met
first in the list of the rarest of its tokens, which bounds its score: that token, the more frequent ones, the list's own
points, and an exact title if no rarer title token is missing. Lists are cut into levels in the order of the ranking's ties
(title, id), each ``GROWTH`` times as long as the one before.

Each round reads the next level of a query's lists with the highest bounds, until as many candidates are met as the round
allows (``QUOTA``, growing as the levels do), scores them and keeps the best. A list is left when its bound is below the last
kept score, or equal to it and all that is left of it comes later in the order of ties. The rounds end when no query has a
list: what was never read could not be among the best. Rounds are as many as the logarithm of the longest lists.

Levels are read in blocks of at most ``BLOCK`` candidates, and a block's queries are dealt to groups of at most ``BLOCK``, so
one group of the join never makes more than ``BLOCK`` squared pairs.

What grows with the candidates is joined by sorted merges: a written table is small beside what it holds in memory, so by its
size it would be sent to all tasks through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import search as S
from quillspark.sources.shared import Steps

BLOCK, QUOTA, GROWTH = 1024, 4096, 8
#: Rows of a part in which candidates are sorted by title.
SORTED_ROWS = 1_000_000


def ordered(candidates: DataFrame, rows: int, block: int) -> DataFrame:
    """Candidates with ``_row``, ascending in the order of ties, and ``_block``, at most ``block`` neighbours in that order."""
    parts = max(1, -(-rows // SORTED_ROWS))
    by = [F.collate("title", "UNICODE"), F.col("id")]
    placed = candidates.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id())
    within = F.col("_row").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("_block", F.shiftright("_row", 33) * (1 << 24) + F.floor(within / block))


def _lists(candidates: DataFrame, text: str, kind: str) -> DataFrame:
    """(list, kind, word, group, _block, _row): the candidates in the lists of their words."""
    return candidates.select("_row", "_block", "_l", "_f", "_named", "_fits", F.explode(F.array_distinct(S.tokens(F.col(text)))).alias("word")).select(
        F.concat_ws("|", F.lit(kind), "word", "_l", "_f", F.col("_named").cast("string"), F.col("_fits").cast("string")).alias("list"), F.lit(kind).alias("kind"), "word", "_l", "_f", "_named", "_fits", "_block", "_row")


def top_candidates(queries: DataFrame, candidates: DataFrame, limit: int = S.LIMIT, block: int = BLOCK, quota: int = QUOTA, growth: int = GROWTH) -> DataFrame:
    """TK1: each query's best ``limit`` candidates by score, then title in locale order, then id, with ``rank``; the same rows as scoring all pairs gives.

    Candidates without a token of the query's title in theirs take no part unless they share its ISBN. Null titles come first, as
    they do in a sort; rows that agree in title and id keep the order in which they were placed.
    """
    spark = queries.sparkSession
    steps = Steps(spark)
    q = steps.keep(S.prepared_queries(queries))
    c = steps.keep(ordered(S.prepared_candidates(candidates), candidates.count(), block))

    postings = steps.keep(_lists(c, "_t", "title").unionByName(_lists(c, "_a", "author")))
    group = ["list", "kind", "word", "_l", "_f", "_named", "_fits"]
    before = Window.partitionBy("list").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = postings.groupBy(*group, "_block").agg(F.count("*").alias("n"), F.min("_row").alias("first_row")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    level = F.when(F.col("before") < quota, 0).otherwise(1 + F.floor(F.log(F.col("before") / quota) / F.log(F.lit(float(growth)))).cast("int"))
    blocks = steps.keep(blocks.withColumn("level", level))
    levels = blocks.groupBy("list", "level").agg(F.sum("n").alias("n"), F.min("first_row").alias("first_row"))
    levels = levels.withColumn("number", F.row_number().over(Window.partitionBy("list").orderBy("level")))  # a level may be empty: the next is the next number

    # what a query can ask for: tokens from the rarest on, each with the words that hold it
    found = S.query_words(q, c).withColumn("kind", F.lit("title")).unionByName(S.query_words(q, c, "_qa", "_a").withColumn("kind", F.lit("author")))
    sizes = blocks.groupBy("kind", "word").agg(F.sum("n").alias("n"))
    found = steps.keep(found.join(sizes, ["kind", "word"]))
    points = F.col("times") * F.when(F.col("kind") == "title", S.WEIGHTS["title_token"]).otherwise(S.WEIGHTS["author_token"])
    tokens = found.groupBy("query_id", "kind", "token").agg(F.first("times").alias("times"), F.sum("n").alias("n")).withColumn("points", points)
    rarity = Window.partitionBy("query_id").orderBy("n", "kind", "token")
    tokens = tokens.withColumns({
        "place": F.row_number().over(rarity), "rest": F.sum("points").over(rarity.rowsBetween(0, Window.unboundedFollowing)),
        "first": F.min(F.when(F.col("kind") == "title", F.struct("n", "kind", "token"))).over(Window.partitionBy("query_id")),
        "last": F.max(F.when(F.col("kind") == "title", F.struct("n", "kind", "token"))).over(Window.partitionBy("query_id"))})
    own = F.struct("n", "kind", "token")
    tokens = tokens.where(own <= F.col("last")).withColumn("rest", F.col("rest") + F.when(own <= F.col("first"), S.WEIGHTS["title"]).otherwise(0))
    words = found.select("query_id", "kind", "token", "word").join(tokens.select("query_id", "kind", "token", "place", "rest"), ["query_id", "kind", "token"])
    words = words.groupBy("query_id", "kind", "word").agg(F.max("rest").alias("rest"))  # a word under several tokens counts for the rarest
    groups = blocks.select(*group).distinct()
    asked = words.join(groups, ["kind", "word"]).join(q.select("query_id", "q_languages", "q_formats"), "query_id")
    asked = steps.keep(asked.select("query_id", "list", (F.col("rest") + S.attribute_points()).alias("bound"), F.lit(1).alias("number")))

    best, round_, pairs = None, 0, S.isbn_pairs(q, c)
    while True:
        allowed = quota * growth**round_
        ahead = asked.join(levels, ["list", "number"])
        running = Window.partitionBy("query_id").orderBy(F.desc("bound"), "first_row", "list").rowsBetween(Window.unboundedPreceding, -1)
        now = steps.keep(ahead.withColumn("_met", F.coalesce(F.sum("n").over(running), F.lit(0))).where(F.col("_met") < allowed).select("query_id", "list", "number", "level"))
        reads = now.join(blocks.select("list", "level", "_block").hint("merge"), ["list", "level"]).select("query_id", "list", "_block")
        deals = reads.groupBy("list", "_block").agg(F.ceil(F.count("*") / block).cast("int").alias("deals"))
        rows = postings.select("list", "_block", "_row").hint("merge").join(deals, ["list", "_block"]).select("list", "_block", "_row", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
        reads = reads.join(deals, ["list", "_block"]).select("query_id", "list", "_block", F.pmod(F.xxhash64("query_id"), "deals").cast("int").alias("deal"))
        met = reads.join(rows, ["list", "_block", "deal"]).select("query_id", "_row")
        pairs = (met.unionByName(pairs) if round_ == 0 else met).distinct()

        whole = pairs.join(q, "query_id").join(c.select("_row", "_t", "_a", "_l", "_f", "_named", "_fits", "_ci").hint("merge"), "_row")
        holds = F.exists(S.tokens(F.col("_q")), lambda t: F.contains("_t", t)) | F.coalesce((F.col("q_isbn") != "") & (F.col("_qi") == F.col("_ci")), F.lit(False))
        new = S.score(whole.where(holds)).select("query_id", "_row", "score")
        every = new if best is None else new.unionByName(best.select("query_id", "_row", "score")).distinct()
        some = Window.partitionBy("query_id", F.pmod(F.xxhash64("_row"), F.lit(64))).orderBy(F.desc("score"), "_row")
        few = every.withColumn("_place", F.row_number().over(some)).where(F.col("_place") <= limit)  # of a query that met many, in parts
        last = Window.partitionBy("query_id").orderBy(F.desc("score"), "_row")
        held = steps.keep(few.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= limit).select("query_id", "_row", "score", "rank"))
        steps.drop(best)
        best = held

        full = best.where(F.col("rank") == limit).select("query_id", F.col("score").alias("least"), F.col("_row").alias("least_row"))
        moved = asked.join(now.select("query_id", "list", F.lit(1).alias("moved")), ["query_id", "list"], "left").withColumn("number", F.col("number") + F.coalesce("moved", F.lit(0))).drop("moved")
        open_ = moved.join(levels.select("list", "number", "first_row"), ["list", "number"]).join(full, "query_id", "left")
        can = F.col("least").isNull() | (F.col("bound") > F.col("least")) | ((F.col("bound") == F.col("least")) & (F.col("first_row") < F.col("least_row")))
        left = steps.keep(open_.where(can).select("query_id", "list", "bound", "number"))
        steps.drop(asked, now)
        asked, round_ = left, round_ + 1
        if asked.isEmpty():
            break
    steps.drop(asked, postings, blocks, found)
    return best.join(queries, "query_id").join(c.drop("_t", "_a", "_l", "_f", "_named", "_fits", "_ci", "_block").hint("merge"), "_row").drop("_row")
