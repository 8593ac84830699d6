"""Catalogue search: normalising, query variants, scoring, ranking, unions of sources."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.sources.batches import pieces
from quillspark.sources.shared import Steps

#: Weights and bounds of the scores. Fixed values.
WEIGHTS = {"isbn": 1000, "title": 180, "title_token": 18, "author_token": 12, "language": 25, "format": 40, "filesize": 10}
STOP_WORDS = ["the", "and", "for", "with"]
MIB = 1024 * 1024
LIMIT = 25
#: Candidates of a title word that meet a query in one group of the join; a word of more is dealt to several.
HOT_ROWS = 50_000


@F.arrow_udf(StringType())
def decomposed(text: pa.Array) -> pa.Array:
    """NFKD without the combining accents U+0300 to U+036F; Spark has no such function."""

    def plain(t: str | None) -> str | None:
        return t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not "̀" <= c <= "ͯ")

    return pa.concat_arrays([pa.array([plain(t) for t in part.to_pylist()], pa.string()) for part in pieces(text)])


def normalized(text: Column) -> Column:
    """lower case, decomposed, other characters as single spaces, trimmed; null as empty."""
    return F.trim(F.regexp_replace(decomposed(F.lower(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", " "))


def tokens(normal: Column) -> Column:
    """words of more than one character of a normalised text."""
    return F.filter(F.split(normal, " "), lambda t: F.length(t) > 1)


def name_tokens(text: Column, stop: list[str] = STOP_WORDS[:3]) -> Column:
    """words of more than two characters that aren't stop words."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(stop))


def clean_hash(value: Column) -> Column:
    """F18."""
    return F.lower(F.regexp_replace(F.regexp_replace(value, "(?i)^urn:btih:", ""), "[^a-fA-F0-9]", ""))


def query_variants(title: Column, author: Column) -> Column:
    """up to five queries from precise to loose, without repeats."""
    clean = lambda t: F.trim(F.regexp_replace(F.regexp_replace(decomposed(F.coalesce(t, F.lit(""))), r"[^a-zA-Z0-9\s]", " "), r"\s+", " "))
    title, author = clean(title), clean(author)
    surname = F.element_at(F.split(author, " "), -1)
    keys = F.filter(F.split(title, " "), lambda w: (F.length(w) > 2) & ~F.lower(w).isin(STOP_WORDS))
    joined = [(title, author), (title, surname), (title,), (F.array_join(F.slice(keys, 1, 5), " "), surname), (F.array_join(F.slice(keys, 1, 2), " "),)]
    made = F.array(*[F.trim(F.regexp_replace(F.concat_ws(" ", *p, F.lit("epub")), r"\s+", " ")) for p in joined])
    return F.slice(F.array_distinct(F.filter(made, lambda q: q != "epub")), 1, 5)


def cache_key(title: Column, author: Column, isbn: Column, languages: Column, formats: Column, limit: Column) -> Column:
    """JSON of the normalised fields, lists sorted, absent limit as null."""
    each = lambda a: F.array_sort(F.coalesce(a, F.array().cast("array<string>")))
    fields = F.struct(normalized(title).alias("title"), normalized(author).alias("author"), normalized(isbn).alias("isbn"), each(languages).alias("languages"), each(formats).alias("formats"), limit.alias("limit"))
    return F.to_json(fields, {"ignoreNullFields": "false"})


def _count_inside(words: Column, text: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda n, w: n + F.when(F.contains(text, w), 1).otherwise(0))


def prepared_queries(queries: DataFrame) -> DataFrame:
    """Queries (q_title, q_author, q_isbn, ...) with their normalised forms, each made once."""
    bare = F.regexp_replace(F.lower("q_isbn"), "[^a-z0-9]", "")
    return queries.withColumns({"_q": normalized(F.col("q_title")), "_qa": normalized(F.col("q_author")), "_qi": bare})


def prepared_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates (title, subtitle, authors, isbn, language, format, ...) with their normalised forms, each made once."""
    bare = F.regexp_replace(F.lower("isbn"), "[^a-z0-9]", "")
    whole = F.concat_ws(" ", "title", F.coalesce("subtitle", F.lit("")))
    fits = F.coalesce((F.col("filesize") > 10_000) & (F.col("filesize") < 100 * MIB), F.lit(False))
    return candidates.withColumns({
        "_t": normalized(whole), "_a": normalized(F.concat_ws(" ", "authors")), "_l": F.when(F.col("language") != "", normalized(F.col("language"))).otherwise(""), "_f": normalized(F.col("format")),
        "_named": F.coalesce(F.col("language") != "", F.lit(False)), "_fits": fits, "_ci": F.when(F.col("isbn") != "", bare)})


def attribute_points(languages: tuple[str, ...] = ("en",), formats: tuple[str, ...] = ("epub",)) -> Column:
    """F16: the points that a candidate's language, format and size give for a query (q_languages, q_formats)."""
    w = WEIGHTS
    given = lambda c, default: F.when(F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0, F.col(c)).otherwise(F.lit(list(default)))
    place = F.array_position(F.transform(given("q_formats", formats), F.lower), F.col("_f"))
    return (
        F.when(F.col("_named") & F.array_contains(F.transform(given("q_languages", languages), F.lower), F.col("_l")), w["language"]).otherwise(0)
        + F.when(place > 0, F.greatest(F.lit(1), w["format"] - 5 * (place - 1))).otherwise(0)
        + F.when(F.col("_fits"), w["filesize"]).otherwise(0)
    )


def score(pairs: DataFrame, languages: tuple[str, ...] = ("en",), formats: tuple[str, ...] = ("epub",)) -> DataFrame:
    """F16: pairs of prepared queries (with q_languages, q_formats) and prepared candidates, with ``score``."""
    w = WEIGHTS
    total = (
        F.when((F.col("q_isbn") != "") & (F.col("_qi") == F.col("_ci")), w["isbn"]).otherwise(0)
        + F.when((F.col("_q") != "") & (F.col("_t") == F.col("_q")), w["title"]).otherwise(0)
        + w["title_token"] * _count_inside(tokens(F.col("_q")), F.col("_t"))
        + w["author_token"] * _count_inside(tokens(F.col("_qa")), F.col("_a"))
        + attribute_points(languages, formats)
    )
    return pairs.withColumn("score", total.cast("int")).drop("_t", "_q", "_qa", "_a", "_l", "_f", "_qi", "_ci", "_named", "_fits")


def containing_words(found: DataFrame, words: DataFrame) -> DataFrame:
    """(token, word): every word in which a token stands, from two lists of distinct texts without blanks.

    An index of the words' runs of three letters (two for tokens of two) with their places; a token asks for the rarest
    of its own runs only, and is compared letter by letter at the place where that must lie.
    """

    def grams(text: str, size: int) -> Column:
        at = F.sequence(F.lit(1), F.length(text) - size + 1)
        made = F.transform(at, lambda i: F.struct(F.substring(text, i, F.lit(size)).alias("gram"), i.alias("at")))
        return F.when(F.length(text) >= size, made).otherwise(F.array().cast("array<struct<gram:string,at:int>>"))

    index = words.select("word", F.explode(F.concat(grams("word", 3), grams("word", 2))).alias("g")).select("word", "g.gram", "g.at")
    often = index.groupBy("gram").agg(F.count("*").alias("n"))
    own = found.select("token", F.explode(F.when(F.length("token") == 2, grams("token", 2)).otherwise(grams("token", 3))).alias("g")).select("token", "g.gram", F.col("g.at").alias("offset"))
    rarest = own.join(often, "gram", "left").groupBy("token").agg(F.min_by(F.struct("gram", "offset"), F.struct(F.coalesce("n", F.lit(0)), "offset")).alias("g")).select("token", "g.gram", "g.offset")
    start = F.col("at") - F.col("offset") + 1
    met = rarest.join(index, "gram").where((start >= 1) & (F.substring("word", start, F.length("token")) == F.col("token")))
    return met.select("token", "word").distinct()


def query_words(queries: DataFrame, candidates: DataFrame, column: str = "_q", text: str = "_t") -> DataFrame:
    """(query_id, token, times, word): the distinct tokens of prepared queries, how often each stands there, and the candidates' words that hold it."""
    asked = queries.select("query_id", F.explode(tokens(F.col(column))).alias("token")).groupBy("query_id", "token").agg(F.count("*").cast("int").alias("times"))
    words = candidates.select(F.explode(tokens(F.col(text))).alias("word")).distinct()
    return asked.join(containing_words(asked.select("token").distinct(), words), "token")


def isbn_pairs(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, _row): the prepared queries and candidates of one ISBN."""
    return queries.where((F.col("q_isbn") != "") & (F.col("_qi") != "")).select("query_id", F.col("_qi").alias("_ci")).join(candidates.where("_ci <> ''").select("_ci", "_row").hint("merge"), "_ci").select("query_id", "_row")


def blocked_pairs(queries: DataFrame, candidates: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """JN8: all prepared pairs of a query and a candidate whose title holds one of the query's title tokens (within a word too), or that share the ISBN.

    The join is on words; one that more than ``hot_rows`` candidates have is dealt to as many groups as it needs, its queries
    copied to each. A pair counts at the first word of the title that it meets at, so no pair has to be told from others or sent
    anywhere. All of them meet; for the best few of each query ``top_candidates`` meets far fewer.
    """
    steps = Steps(queries.sparkSession)
    q, c = prepared_queries(queries), steps.keep(prepared_candidates(candidates).withColumn("_row", F.monotonically_increasing_id()))
    held = lambda text: F.coalesce(F.exists("_asked", lambda t: F.contains(F.col(text), t)), F.lit(False))  # noqa: E731  as in a word: tokens have no blanks
    asked = q.select("query_id", F.explode_outer(tokens(F.col("_q"))).alias("token")).groupBy("query_id").agg(F.collect_set("token").alias("_asked"))
    whole = q.join(asked, "query_id")
    out = ["query_id", *[n for n in q.columns if n != "query_id"], *[n for n in c.columns if n != "_row"]]

    postings = c.withColumn("_words", F.array_distinct(tokens(F.col("_t")))).select(*c.columns, "_words", F.posexplode("_words").alias("_at", "word"))
    postings = postings.withColumn("_before", F.array_join(F.slice("_words", F.lit(1), F.col("_at")), " ")).drop("_words", "_at")
    hot = postings.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("word", F.ceil(F.col("n") / hot_rows).cast("int").alias("deals"))
    asks = query_words(q, c).select("query_id", "word").distinct().join(hot, "word", "left").join(whole, "query_id")
    asks = asks.withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1))).drop("deals")
    spark = queries.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = postings.join(F.broadcast(hot), "word", "left")  # a row for ``hot_rows`` postings at most
    dealt = dealt.withColumn("deal", F.pmod(F.xxhash64("_row"), F.coalesce("deals", F.lit(1))).cast("int")).drop("deals").repartition(tasks, "word", "deal")
    by_title = asks.join(dealt, ["word", "deal"]).where(~held("_before"))

    numbers = q.where((F.col("q_isbn") != "") & (F.col("_qi") != "")).select("query_id", F.col("_qi").alias("_ci")).distinct()
    by_isbn = numbers.join(whole, "query_id").join(c.where("_ci <> ''").hint("merge"), "_ci").where(~held("_t"))  # files are small beside what they hold in memory
    return by_title.select(out).unionByName(by_isbn.select(out))


def ranked(scored: DataFrame, limit: int = LIMIT) -> DataFrame:
    """TK1: the best ``limit`` candidates of each query by score, then title in locale order, then id."""
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), F.collate("title", "UNICODE"), "id")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)


def all_sources(sources: dict[str, DataFrame], enabled: list[str]) -> DataFrame:
    """UD1 and SO1: the union of the enabled sources in one schema; repeats across sources stay."""
    parts = [sources[n].withColumn("source", F.lit(n)) for n in enabled if n in sources]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def gated_pairs(queries: DataFrame, releases: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """queries (query_id, q_title, q_author) with the releases (id, name) that name the rarest token of the title, as the gate asks for all
    of them; or any token of the author, where the title has none. A token of more than ``hot_rows`` releases is dealt to several groups of the join."""
    title, author = name_tokens(F.col("q_title")), name_tokens(F.col("q_author"))
    wanted = queries.select("query_id", F.explode(F.array_distinct(F.when(F.size(title) > 0, title).otherwise(author))).alias("token"), (F.size(title) > 0).alias("all"))
    spark = queries.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = releases.withColumn("_tokens", F.array_distinct(name_tokens(F.col("name"))))
    often = rows.select(F.explode("_tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).withColumn("deals", F.ceil(F.col("n") / hot_rows).cast("int"))
    rarest = Window.partitionBy("query_id").orderBy(F.col("n").asc_nulls_first(), "token")
    asks = wanted.distinct().join(often, "token", "left").withColumn("place", F.row_number().over(rarest)).where((F.col("place") == 1) | ~F.col("all"))
    asks = asks.withColumn("_asked", F.collect_list("token").over(Window.partitionBy("query_id")))
    asks = asks.where("n IS NOT NULL").select("query_id", "token", "_asked", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
    named = rows.select(*rows.columns, F.explode("_tokens").alias("token")).join(often.where("deals > 1").select("token", "deals"), "token", "left")
    dealt = named.withColumn("deal", F.pmod(F.xxhash64("id"), F.coalesce("deals", F.lit(1))).cast("int")).drop("deals")
    # a pair counts at the least of the tokens that it shares: nothing has to be told apart over all pairs
    met = asks.join(dealt, ["token", "deal"]).where(F.col("token") == F.array_min(F.array_intersect("_asked", "_tokens")))
    return met.drop("token", "deal", "_asked", "_tokens").repartition(tasks, "id").join(queries, "query_id")  # what a small file is read in is one task


# The numbers in the release score and its gate are fixed values.
def release_score(pairs: DataFrame) -> DataFrame:
    """(q_title, q_author) against releases (name, hash, size, seeds): ``score``, and ``fits`` for the gate."""
    p = pairs.withColumns({"_n": F.lower("name"), "_nt": name_tokens(F.col("name")), "_tt": name_tokens(F.col("q_title")), "_at": name_tokens(F.col("q_author"))})
    n, size = F.col("_n"), F.coalesce("size", F.lit(0))  # unknown sizes and seeds count as none
    epub = n.rlike(r"\bepub\b")
    total = (
        F.when(epub, 50).otherwise(0) - F.when(n.rlike(r"\.pdf\b"), 20).otherwise(0) - F.when(n.rlike(r"\.mobi\b|\.azw"), 5).otherwise(0)
        - F.when(n.rlike(r"\baudiobook\b|\bmp3\b|\bm4b\b"), 40).otherwise(0)
        + 8 * _count_inside(F.col("_tt"), n) + 4 * _count_inside(F.col("_at"), n) + F.least(F.coalesce("seeds", F.lit(0)), F.lit(50))
        + F.when((size > 0) & (size < 20 * MIB), 10).otherwise(0) - F.when(size > 50 * MIB, 10).otherwise(0)
    )
    named = F.when(F.size("_tt") > 0, F.forall("_tt", lambda t: F.array_contains("_nt", t))).otherwise(F.exists("_at", lambda t: F.array_contains("_nt", t)))
    fits = (F.length("hash") >= 32) & (size <= 200 * MIB) & epub & named & (total > 0)
    return p.withColumns({"score": total.cast("int"), "fits": fits}).drop("_n", "_nt", "_tt", "_at")


def best_release(scored: DataFrame, *keys: str) -> DataFrame:
    """TK2: of each key's fitting releases the best by score, then seeds, then id."""
    by = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc(F.coalesce("seeds", F.lit(0))), "id")
    return scored.where("fits").withColumn("_place", F.row_number().over(by)).where("_place = 1").drop("_place")


def first_source(best: DataFrame) -> DataFrame:
    """TK5: each query's best release of the first source (by source_rank) that has one."""
    by = Window.partitionBy("query_id").orderBy("source_rank")
    return best.withColumn("_place", F.row_number().over(by)).where("_place = 1").drop("_place")
