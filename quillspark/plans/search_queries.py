"""Queries of catalogue search, annotations, validation and event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import validity as V
from quillspark.operators import annotations as A
from quillspark.operators import search as S
from quillspark.operators import status as O
from quillspark.operators.top_candidates import top_candidates
from quillspark.plans.registry import query
from quillspark.sources import model as M
from quillspark.sources.model import with_model
from quillspark.streaming import keyed as K
from quillspark.streaming import stateful as X

_FORMATS = ["epub", "pdf", "mobi", "azw3"]


def candidates(spark: SparkSession, d: str) -> DataFrame:
    p = M.table(spark, d, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("id"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("subtitle"), F.array("p_brand").alias("authors"), F.concat(F.lit("978-"), k.cast("string")).alias("isbn"),
        F.lower("p_type").alias("language"), F.element_at(F.lit(_FORMATS), (F.col("p_size") % 4 + 1)).alias("format"), (F.col("p_retailprice") * 1000).cast("long").alias("filesize"), (F.col("p_size") % 3).alias("source"))


def queries_in(spark: SparkSession, d: str) -> DataFrame:
    p = M.table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("query_id"))
    return p.select("query_id", F.col("p_name").alias("q_title"), F.lit("Brand#2").alias("q_author"), F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("978"), F.col("query_id").cast("string"))).alias("q_isbn"),
                    F.array(F.lit("economy"), F.lit("standard")).alias("q_languages"), F.array(F.lit("pdf"), F.lit("epub")).alias("q_formats"))


_C = f"""WITH c AS (SELECT p_partkey AS id, p_name AS title, p_brand AS author, '978-' || p_partkey AS isbn, lower(p_type) AS language, {_FORMATS}[p_size % 4 + 1] AS format, CAST(p_retailprice * 1000 AS BIGINT) AS filesize, p_size % 3 AS source FROM part),
q AS (SELECT min(p_partkey) AS query_id, p_name AS q_title, CASE WHEN min(p_partkey) % 2 = 0 THEN '978' || min(p_partkey) END AS q_isbn FROM part GROUP BY p_name),
qt AS (SELECT query_id, unnest(string_split(q_title, ' ')) AS t FROM q),
pairs AS (SELECT DISTINCT query_id, id FROM qt JOIN c ON contains(title, t) WHERE length(t) > 1 UNION SELECT query_id, id FROM q JOIN c ON q.q_isbn = replace(c.isbn, '-', '')),
scored AS (SELECT query_id, id, title, source, CASE WHEN q_isbn = replace(isbn, '-', '') THEN 1000 ELSE 0 END + CASE WHEN title = q_title THEN 180 ELSE 0 END
  + 18 * len(list_filter(string_split(q_title, ' '), lambda w: length(w) > 1 AND contains(title, w))) + 12 * CASE WHEN contains(lower(author), 'brand') THEN 1 ELSE 0 END
  + CASE WHEN language IN ('economy', 'standard') THEN 25 ELSE 0 END + CASE format WHEN 'pdf' THEN 40 WHEN 'epub' THEN 35 ELSE 0 END + CASE WHEN filesize > 10000 AND filesize < 104857600 THEN 10 ELSE 0 END AS score
  FROM pairs JOIN q USING (query_id) JOIN c USING (id))
"""
_RANKED = "SELECT query_id, id, title, CAST(score AS INTEGER) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, id) AS rank FROM {}) WHERE rank <= 25"


def scored(spark, d):
    return S.score(S.blocked_pairs(queries_in(spark, d), candidates(spark, d)))


@query("JN8_F16_scores", _C + "SELECT query_id, id, CAST(score AS INTEGER) AS score FROM scored")
def jn8(spark, d):
    return scored(spark, d).select("query_id", "id", "score")


@query("TK1_ranked", _C + _RANKED.format("scored"))
def tk1(spark, d):
    return top_candidates(queries_in(spark, d), candidates(spark, d)).select("query_id", "id", "title", "score", "rank")


@query("SO1_UD1_all_sources", _C + _RANKED.format("(SELECT * FROM scored WHERE source IN (0, 2))"))
def so1(spark, d):
    c = candidates(spark, d)
    parts = {f"s{i}": c.where(F.col("source") == i) for i in range(3)}
    return top_candidates(queries_in(spark, d), S.all_sources(parts, ["s0", "s2"])).select("query_id", "id", "title", "score", "rank")


@query("F14_normalized", """SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(lower(text))), '[^a-z0-9]+', ' ', 'g'))) AS normal_md5 FROM documents""")
def f14(spark, d):
    return M.table(spark, d, "documents").select("doc_id", F.md5(S.normalized(F.col("text")).cast("binary")).alias("normal_md5"))


@query("F15_cache_keys", """SELECT p_partkey, '{"title":"' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) || '","author":"' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) || '","isbn":"","languages":["a","' || lower(p_type) || '"],"formats":[],"limit":'
|| CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE 'null' END || '}' AS cache_key FROM part""")
def f15(spark, d):
    p = M.table(spark, d, "part")
    key = S.cache_key(F.col("p_name"), F.col("p_brand"), F.lit(None).cast("string"), F.array(F.lower("p_type"), F.lit("a")), F.lit(None).cast("array<string>"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")))
    return p.select("p_partkey", key.alias("cache_key"))


_WORDLY = r"trim(regexp_replace(regexp_replace(strip_accents({}), '[^a-zA-Z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("F18_query_variants", f"""WITH q AS (SELECT min(p_partkey) AS query_id, {_WORDLY.format('p_name')} AS title, {_WORDLY.format("'Brand#2'")} AS author FROM part GROUP BY p_name),
k AS (SELECT *, string_split(author, ' ')[-1] AS surname, list_filter(string_split(title, ' '), lambda w: length(w) > 2 AND lower(w) NOT IN {tuple(S.STOP_WORDS)}) AS keys FROM q),
v AS (SELECT query_id, unnest([title || ' ' || author, title || ' ' || surname, title, array_to_string(keys[1:5], ' ') || ' ' || surname, array_to_string(keys[1:2], ' ')]) AS v, unnest(range(5)) AS place FROM k),
d AS (SELECT query_id, trim(regexp_replace(v || ' epub', '\\s+', ' ', 'g')) AS variant, min(place) AS place FROM v GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place) - 1 AS INTEGER) AS place, variant FROM d WHERE variant <> 'epub'""")
def f18(spark, d):
    q = queries_in(spark, d)
    return q.select("query_id", F.posexplode(S.query_variants(F.col("q_title"), F.col("q_author"))).alias("place", "variant"))


def releases(spark: SparkSession, d: str) -> DataFrame:
    p = M.table(spark, d, "part")
    tail = F.element_at(F.lit([" epub", ".pdf", " audiobook mp3 epub", ".mobi epub"]), (F.col("p_size") % 4 + 1))
    return p.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), "p_brand", tail).alias("name"), F.md5(F.col("p_partkey").cast("string").cast("binary")).alias("hash"),
                    F.when(F.col("p_partkey") % 13 != 7, (F.col("p_retailprice") * 40000).cast("long")).alias("size"), F.when(F.col("p_partkey") % 11 != 5, F.col("p_size")).alias("seeds"), (F.col("p_size") % 3).alias("source_rank"))


def release_pairs(spark, d):
    """Releases scored against queries, some of whose titles have no token of their own."""
    q = queries_in(spark, d).select("query_id", F.when(F.col("query_id") % 9 == 4, "of it").otherwise(F.col("q_title")).alias("q_title"), "q_author")
    return S.release_score(S.gated_pairs(q, releases(spark, d)))


_R = """WITH r AS (SELECT p_partkey AS id, p_name || ' ' || p_brand || [' epub', '.pdf', ' audiobook mp3 epub', '.mobi epub'][p_size % 4 + 1] AS name, CASE WHEN p_partkey % 13 <> 7 THEN CAST(p_retailprice * 40000 AS BIGINT) ELSE 0 END AS size, CASE WHEN p_partkey % 11 <> 5 THEN p_size ELSE 0 END AS seeds, p_size % 3 AS source_rank FROM part),
q AS (SELECT min(p_partkey) AS query_id, CASE WHEN min(p_partkey) % 9 = 4 THEN 'of it' ELSE p_name END AS q_title FROM part GROUP BY p_name),
tok AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(lower(name), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'for')) AS nt FROM r),
qtok AS (SELECT *, list_filter(string_split(q_title, ' '), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'for')) AS tt FROM q),
sc AS (SELECT query_id, id, seeds, source_rank, CASE WHEN regexp_matches(lower(name), '\\bepub\\b') THEN 50 ELSE 0 END - CASE WHEN regexp_matches(lower(name), '\\.pdf\\b') THEN 20 ELSE 0 END - CASE WHEN regexp_matches(lower(name), '\\.mobi\\b|\\.azw') THEN 5 ELSE 0 END
 - CASE WHEN regexp_matches(lower(name), '\\baudiobook\\b|\\bmp3\\b|\\bm4b\\b') THEN 40 ELSE 0 END + 8 * len(list_filter(tt, lambda w: contains(lower(name), w))) + 4 * CASE WHEN contains(lower(name), 'brand') THEN 1 ELSE 0 END + least(seeds, 50)
 + CASE WHEN size > 0 AND size < 20971520 THEN 10 ELSE 0 END - CASE WHEN size > 52428800 THEN 10 ELSE 0 END AS score,
 size <= 209715200 AND regexp_matches(lower(name), '\\bepub\\b') AND CASE WHEN len(tt) > 0 THEN list_has_all(nt, tt) ELSE list_contains(nt, 'brand') END AS gate FROM qtok JOIN tok ON list_contains(tok.nt, coalesce(qtok.tt[1], 'brand'))),
fit AS (SELECT * FROM sc WHERE gate AND score > 0)
"""


@query("TK2_F17_best_release", _R + "SELECT query_id, id, CAST(score AS INTEGER) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seeds DESC, id) AS place FROM fit) WHERE place = 1")
def tk2(spark, d):
    return S.best_release(release_pairs(spark, d), "query_id").select("query_id", "id", "score")


@query("TK5_first_source", _R + "SELECT query_id, id, source_rank, CAST(score AS INTEGER) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source_rank, score DESC, seeds DESC, id) AS place FROM fit) WHERE place = 1")
def tk5(spark, d):
    return S.first_source(S.best_release(release_pairs(spark, d), "query_id", "source_rank")).select("query_id", "id", "source_rank", "score")


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as annotated scenes with faults: intensities above one, of wrong type or absent, unknown paces, over-long lists, bare arrays, broken JSON."""
    c = M.table(spark, d, "conversations")
    beat = F.concat(
        F.lit('{"text":"'), F.col("role"), F.lit(" "), F.col("turn").cast("string"), F.lit('","delivery":{'),
        F.when(F.col("turn") % 4 == 0, '"intensity":0.5,').when(F.col("turn") % 4 == 1, '"intensity":1.7,').when(F.col("turn") % 4 == 2, '"intensity":"x",').otherwise(""),
        F.when(F.col("turn") % 3 == 0, '"pace":"slow"').otherwise('"pace":"warp"'), F.lit("}}"))
    g = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", beat.alias("b"), F.concat("role", F.lit(" "), F.col("turn").cast("string")).alias("t")))), lambda s: s).alias("s"))
    beats = F.array_join(F.transform("s", lambda x: x["b"]), ",")
    json = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("["), beats, F.lit("]"))).when(F.col("conv_id") % 5 == 1, "{broken").otherwise(F.concat(F.lit('{"scene_summary":"s'), F.col("conv_id").cast("string"), F.lit('","beats":['), beats, F.lit("]}")))
    text = F.concat_ws(" ", F.transform("s", lambda x: x["t"]))
    return g.select("conv_id", json.alias("annotated_json"), F.when(F.col("conv_id") % 7 == 0, "other text").otherwise(text).alias("raw_text"))


_A = """WITH g AS (SELECT conv_id, string_agg(role || ' ' || turn, ' ' ORDER BY turn, role) AS joined, count(*) AS n FROM conversations GROUP BY conv_id),
t AS (SELECT conv_id, CASE WHEN conv_id % 7 = 0 THEN 'other text' ELSE joined END AS raw_text, joined, n FROM g),
b AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS INTEGER) AS place, role || ' ' || turn AS text, CASE turn % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 0.3 END AS intensity, CASE WHEN turn % 3 = 0 THEN 'slow' ELSE 'normal' END AS pace FROM conversations),
beats AS (SELECT conv_id, place, text, intensity, pace FROM b WHERE place <= 12 AND conv_id % 5 <> 1 UNION ALL SELECT conv_id, 1, raw_text, 0.3, 'normal' FROM t WHERE conv_id % 5 = 1)
"""


@query("F20_clean_annotations", _A + "SELECT conv_id, CASE WHEN conv_id % 5 > 1 THEN 's' || conv_id ELSE 'A scene in the book.' END AS scene_summary, place, text, CAST(intensity AS DOUBLE) AS intensity, pace FROM beats")
def f20(spark, d):
    c = A.cleaned(annotations(spark, d)).select("conv_id", "scene_summary", F.posexplode("beats").alias("p", "b"))
    return c.select("conv_id", "scene_summary", (F.col("p") + 1).alias("place"), "b.text", "b.delivery.intensity", "b.delivery.pace")


@query("F21_alignment", _A + "SELECT conv_id, conv_id % 5 = 1 OR (conv_id % 7 <> 0 AND n <= 12) AS is_aligned, CAST(CASE WHEN conv_id % 5 = 1 THEN 1 WHEN conv_id % 7 <> 0 AND n <= 12 THEN n ELSE 1 END AS INTEGER) AS n_beats FROM t")
def f21(spark, d):
    return A.aligned(A.cleaned(annotations(spark, d))).select("conv_id", "is_aligned", F.size("beats").alias("n_beats"))


_TERMS = [("en", 1, "the", "thee"), ("en", 2, "thee", "$thy"), ("fr", 1, "le", "la"), ("de", 1, "und", "&"), ("de", 2, "der", "die"), ("es", 1, "de", "d\\e")]


def terms(spark: SparkSession, d: str) -> DataFrame:
    """A fixed dictionary for each language of the documents."""
    pairs = F.array(*[F.struct(F.lit(a).alias("of"), F.lit(p).alias("pos"), F.lit(t).alias("term"), F.lit(h).alias("hint")) for a, p, t, h in _TERMS])
    return M.table(spark, d, "documents").select("lang").distinct().select("lang", F.explode(pairs).alias("t")).where("lang = t.of").select("lang", "t.pos", "t.term", "t.hint")


@query("F19_AG11_dictionary", r"""SELECT doc_id, md5(CASE lang WHEN 'en' THEN regexp_replace(regexp_replace(text, '\bthe\b', 'thee', 'gi'), '\bthee\b', '$thy', 'gi') WHEN 'fr' THEN regexp_replace(text, '\ble\b', 'la', 'gi')
WHEN 'de' THEN regexp_replace(regexp_replace(text, '\bund\b', '&', 'gi'), '\bder\b', 'die', 'gi') WHEN 'es' THEN regexp_replace(text, '\bde\b', 'd\\e', 'gi') ELSE text END) AS spoken_md5 FROM documents""")
def f19(spark, d):
    docs = M.table(spark, d, "documents").select("doc_id", "lang", "text")
    joined = docs.join(F.broadcast(A.dictionaries(terms(spark, d), "lang")), "lang", "left")  # a row for each language of ``_TERMS``: no text is moved
    return joined.select("doc_id", F.md5(A.substituted(F.col("text"), F.col("dictionary")).cast("binary")).alias("spoken_md5"))


@query("JN9_voice_contexts", """WITH b AS (SELECT n_nationkey AS book_id FROM nation), m AS (SELECT s_nationkey AS book_id, CASE WHEN s_suppkey % 17 = 3 THEN 'NARRATOR' ELSE s_name END AS name, CAST(s_suppkey AS VARCHAR) AS voice, s_suppkey AS pos FROM supplier)
SELECT b.book_id, coalesce(arg_min(name, (CASE WHEN lower(name) = 'narrator' THEN 0 ELSE 1 END) * 1000000000 + pos), 'Narrator') AS narrator, coalesce(arg_min(voice, (CASE WHEN lower(name) = 'narrator' THEN 0 ELSE 1 END) * 1000000000 + pos), 'default') AS voice,
CAST(any_value((SELECT count(*) FROM region WHERE r_regionkey = b.book_id)) AS INTEGER) AS n_terms FROM b LEFT JOIN m USING (book_id) GROUP BY b.book_id""")
def jn9(spark, d):
    s = M.table(spark, d, "supplier")
    cast = s.select(F.col("s_nationkey").alias("book_id"), F.when(F.col("s_suppkey") % 17 == 3, "NARRATOR").otherwise(F.col("s_name")).alias("name"), F.col("s_suppkey").cast("string").alias("voice"), F.col("s_suppkey").alias("pos"))
    words = M.table(spark, d, "region").select(F.col("r_regionkey").alias("book_id"), F.lit(1).alias("pos"), F.col("r_name").alias("term"), F.lower("r_name").alias("hint"))
    return A.voice_contexts(M.table(spark, d, "nation").select(F.col("n_nationkey").alias("book_id")), cast, words)


AS_OF = "2024-01-20 00:00:00"


@query("JN3_valid_sessions", f"""SELECT event_id, user_id FROM events JOIN customer ON user_id = c_custkey WHERE c_acctbal >= 0 AND ts <= TIMESTAMP '{AS_OF}' AND ts + to_hours(CAST(floor(value) AS BIGINT)) > TIMESTAMP '{AS_OF}' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY""")
def jn3(spark, d):
    e = M.table(spark, d, "events")
    sessions = e.select("event_id", "user_id", F.col("ts").alias("created_at"), (F.col("ts") + F.make_interval(hours=F.floor("value").cast("int"))).alias("expires_at"))
    users = M.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") < 0).alias("disabled"))
    return O.valid_sessions(sessions, users, F.lit(AS_OF).cast("timestamp")).select("event_id", "user_id")


@query("JN4_key_owners", with_model("books", "chapters", "segments") + """, b AS (SELECT *, 'cover-' || book_id AS cover_key, 'file-' || book_id AS file_key FROM books), c AS (SELECT *, 'audio-' || chapter_id AS audio_key FROM chapters),
s AS (SELECT chapter_id, 'part-' || chapter_id || '-' || segment_index AS audio_key, segment_index FROM segments),
stored AS (SELECT cover_key AS key, user_id FROM b UNION ALL SELECT file_key, user_id FROM b UNION ALL SELECT audio_key, user_id FROM c JOIN b USING (book_id) UNION ALL SELECT s.audio_key, user_id FROM s JOIN c USING (chapter_id) JOIN b USING (book_id)),
k AS (SELECT CASE chapter_id % 5 WHEN 0 THEN 'books/' || book_id || '/x' WHEN 1 THEN 'cover-' || book_id WHEN 2 THEN 'file-' || book_id WHEN 3 THEN 'audio-' || chapter_id ELSE 'books/0/' || chapter_id END AS key FROM chapters UNION ALL SELECT audio_key FROM s WHERE segment_index = 2),
o AS (SELECT DISTINCT key, user_id AS owner FROM stored)
SELECT k.key, CASE WHEN regexp_matches(k.key, '^books/') THEN b.user_id ELSE o.owner END AS owner FROM k LEFT JOIN o USING (key) LEFT JOIN b ON regexp_extract(k.key, '^books/([0-9]+)/', 1) = CAST(b.book_id AS VARCHAR)""")
def jn4(spark, d):
    text = lambda p, *c: F.concat_ws("-", F.lit(p), *[F.col(x).cast("string") for x in c])
    books = M.books(spark, d).select("book_id", "user_id", text("cover", "book_id").alias("cover_key"), text("file", "book_id").alias("file_key"))
    chapters = M.chapters(spark, d).select("chapter_id", "book_id", text("audio", "chapter_id").alias("audio_key"))
    segments = M.segments(spark, d).select("chapter_id", "segment_index", text("part", "chapter_id", "segment_index").alias("audio_key"))
    m, book, i = F.col("chapter_id") % 5, F.col("book_id").cast("string"), F.col("chapter_id").cast("string")
    key = F.when(m == 0, F.concat(F.lit("books/"), book, F.lit("/x"))).when(m == 1, text("cover", "book_id")).when(m == 2, text("file", "book_id")).when(m == 3, text("audio", "chapter_id")).otherwise(F.concat(F.lit("books/0/"), i))
    keys = chapters.select(key.alias("key")).unionByName(segments.where("segment_index = 2").select(F.col("audio_key").alias("key")))
    return O.key_owners(keys, books, chapters, segments, "^books/([0-9]+)/").select("key", "owner")


@query("PF6_row_validation", """SELECT event_id, list_filter([CASE WHEN NOT (event_id % 3 <> 0) THEN 'id' END, CASE WHEN NOT (event_type <> 'error') THEN 'email' END, CASE WHEN NOT (value * 1000 BETWEEN 0 AND 100000) THEN 'position' END,
CASE WHEN NOT (event_id >= 1) THEN 'index' END, CASE WHEN length(event_type) > 5 THEN 'name' END], lambda x: x IS NOT NULL) AS reasons FROM events""")
def pf6(spark, d):
    e = M.table(spark, d, "events")
    i = F.col("event_id")
    uid = F.concat(F.lpad(i.cast("string"), 8, "0"), F.lit("-0000-4000-8000-"), F.when(i % 3 == 0, "zz").otherwise("00000000abcd"))
    mail = F.concat("event_type", F.when(F.col("event_type") == "error", " at x").otherwise("@x.org"))
    position = F.col("value") * 1000
    return e.select(i, V.reasons(id=V.is_uuid(uid), email=V.is_email(mail), position=V.is_position(position) & (position <= 100000), index=V.is_index(i), name=V.bounded(F.col("event_type"), 5)).alias("reasons"))


@query("PF7_safe_keys", """SELECT page_id, length(k) BETWEEN 1 AND 512 AND NOT contains(k, '..') AND NOT starts_with(k, '/') AND regexp_matches(k, '^[a-zA-Z0-9/_.-]+$') AS safe FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '../' || page_id WHEN 2 THEN '/abs' ELSE 'books/' || page_id || '/a.wav' END AS k FROM pages)""")
def pf7(spark, d):
    i = F.col("page_id")
    s = i.cast("string")
    key = F.when(i % 4 == 0, F.col("url")).when(i % 4 == 1, F.concat(F.lit("../"), s)).when(i % 4 == 2, "/abs").otherwise(F.concat(F.lit("books/"), s, F.lit("/a.wav")))
    return M.table(spark, d, "pages").select(i, V.is_safe_key(key).alias("safe"))


@query("PF8_url_screening", """SELECT page_id, CASE WHEN NOT starts_with(url, 'https://') THEN 'not https' WHEN NOT (h = 'example.com' OR ends_with(h, '.example.com')) THEN 'unexpected host' END AS problem FROM (SELECT *, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS h FROM pages)""")
def pf8(spark, d):
    return M.table(spark, d, "pages").select("page_id", V.url_problem(F.col("url"), ["example.com"]).alias("problem"))


@query("PF9_private_ips", """SELECT event_id, a IN (10, 127, 0) OR a >= 224 OR a = 169 AND b = 254 OR a = 172 AND b BETWEEN 16 AND 31 OR a = 192 AND b IN (0, 168) OR a = 198 AND b IN (18, 19) OR a = 100 AND b BETWEEN 64 AND 127 AS private
FROM (SELECT event_id, event_id * 7 % 256 AS a, event_id * 13 % 256 AS b FROM events)""")
def pf9(spark, d):
    i = F.col("event_id")
    a, b = i * 7 % 256, i * 13 % 256
    dotted = F.concat_ws(".", a.cast("string"), b.cast("string"), F.lit("1.2"))
    ip = F.when(i % 3 == 0, dotted).when(i % 3 == 1, F.concat(F.lit("::ffff:"), dotted)).otherwise(F.concat(F.lit("::ffff:"), F.lower(F.hex(a * 256 + b)), F.lit(":102")))
    return M.table(spark, d, "events").select(i, V.is_private_ip(ip).alias("private"))


@query("PF10_client_ips", "SELECT event_id, CASE WHEN event_id % 4 >= 2 THEN 'h' || (event_id % 4 - 1) ELSE 'direct' END AS ip FROM events")
def pf10(spark, d):
    i = F.col("event_id")
    chain = F.array_join(F.transform(F.slice(F.lit([1, 2, 3]), 1, (i % 4).cast("int")), lambda n: F.concat(F.lit(" h"), n.cast("string"))), ",")
    return M.table(spark, d, "events").select(i, V.client_ip(chain, F.lit("direct"), 2).alias("ip"))


@query("PF11_aged_rows", f"SELECT event_id, ts < TIMESTAMP '{AS_OF}' - INTERVAL 60 MINUTE AS stuck, ts < TIMESTAMP '{AS_OF}' AS expired FROM events")
def pf11(spark, d):
    now = F.lit(AS_OF).cast("timestamp")
    return M.table(spark, d, "events").select("event_id", V.is_older(F.col("ts"), now, 3600).alias("stuck"), V.is_older(F.col("ts"), now, 0).alias("expired"))


@query("PF12_record_normalising", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'k' || event_id END AS name, CAST(CASE WHEN event_id % 4 = 0 THEN 0 ELSE json_extract(props, '$.k') END AS DOUBLE) AS size FROM events""")
def pf12(spark, d):
    i = F.col("event_id")
    k = F.get_json_object("props", "$.k")
    item = F.concat(F.lit('{"name":"'), F.when(i % 3 == 0, " ").otherwise(F.concat(F.lit("k"), i.cast("string"))), F.lit('","title":" '), F.col("event_type"), F.lit(' ","size":"'), F.when(i % 4 == 0, "-1").when(i % 4 == 1, "many").otherwise(k), F.lit('","bytes":"'), F.when(i % 4 == 1, k).otherwise("none"), F.lit('"}'))
    json = F.when(i % 2 == 0, F.concat(F.lit("["), item, F.lit("]"))).otherwise(F.concat(F.lit('{"results":['), item, F.lit("]}")))
    rows = M.table(spark, d, "events").select(i, F.explode(V.listed(json, "struct<name:string,title:string,size:string,bytes:string>")).alias("x"))
    return rows.select("event_id", V.first_text(F.col("x.name"), F.col("x.title")).alias("name"), V.first_number(F.col("x.size"), F.col("x.bytes")).alias("size"))


def _anchored_sql(hours: int, out: str) -> str:
    return f"""WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT user_id, n, ts FROM e WHERE n = 1 UNION ALL SELECT w.user_id, x.n, x.ts FROM w, LATERAL (SELECT n, ts FROM e WHERE e.user_id = w.user_id AND e.ts >= w.ts + INTERVAL {hours} HOUR AND e.n > w.n ORDER BY n LIMIT 1) x),
r AS (SELECT e.event_id, e.user_id, e.n, max(w.n) AS first FROM e JOIN w ON w.user_id = e.user_id AND w.n <= e.n GROUP BY ALL) {out}"""


@query("ST4_rate_limit", _anchored_sql(24, "SELECT event_id, user_id AS book_id, CAST(n - first + 1 AS BIGINT) AS in_window, n - first + 1 > 3 AS over_limit FROM r"))
def st4(spark, d):
    e = K.anchored(M.playback(spark, d), "book_id", 24 * 3600)
    return e.select("event_id", "book_id", "in_window", (F.col("in_window") > 3).alias("over_limit"))


@query("ST5_throttle", _anchored_sql(6, "SELECT event_id, user_id AS book_id FROM r WHERE n = first UNION ALL SELECT event_id, user_id FROM events WHERE event_id % 10 = 3").replace("FROM events),", "FROM events WHERE event_id % 10 <> 3),", 1))
def st5(spark, d):
    return K.throttled(M.playback(spark, d), "book_id", 6 * 3600, F.col("event_id") % 10 == 3).select("event_id", "book_id")


@query("ST6_cache_labels", _anchored_sql(12, "SELECT event_id, CASE WHEN n = first THEN 'miss' ELSE 'hit' END AS label FROM r"))
def st6(spark, d):
    return K.anchored(M.playback(spark, d), "book_id", 12 * 3600).select("event_id", F.when(F.col("opens"), "miss").otherwise("hit").alias("label"))


@query("ST1_subscription", with_model("event_log") + "SELECT event_id, book_id, status FROM event_log WHERE book_id = 7 AND status IN ('ready', 'failed')")
def st1(spark, d):
    return K.subscribed(M.event_log(spark, d), 7, ["ready", "failed"]).select("event_id", "book_id", "status")


def chapter_log(spark: SparkSession, d: str) -> DataFrame:
    """The event log with a duration and an audio key on some of the events that set a status."""
    given = F.col("status") != "segment_ready"
    return M.event_log(spark, d).withColumns({"duration_ms": F.when(given & (F.col("event_id") % 3 == 0), F.floor("value").cast("int")), "audio_key": F.when(given & (F.col("event_id") % 4 == 1), F.concat(F.lit("a"), F.col("event_id").cast("string")))})


@query("ST2_current_status", with_model("event_log") + """, p AS (SELECT book_id, arg_max(status, event_id) FILTER (status <> 'segment_ready') AS s, max(event_id) FILTER (status <> 'segment_ready') AS a, max(event_id) FILTER (status = 'segment_ready') AS r,
arg_max(CAST(floor(value) AS INTEGER), event_id) FILTER (status <> 'segment_ready' AND event_id % 3 = 0) AS duration_ms, arg_max('a' || event_id, event_id) FILTER (status <> 'segment_ready' AND event_id % 4 = 1) AS audio_key FROM event_log GROUP BY book_id)
SELECT book_id, CASE WHEN coalesce(s, 'queued') NOT IN ('ready', 'partial_ready', 'failed') AND r IS NOT NULL AND (a IS NULL OR r > a) THEN 'partial_ready' ELSE coalesce(s, 'queued') END AS status, duration_ms, audio_key FROM p""")
def st2(spark, d):
    return K.current_status(chapter_log(spark, d))


@query("ST3_progress", with_model("event_log") + """, p AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) % 4 * CAST(book_id % 5 > 0 AS INTEGER) AS total, CAST(floor(value) AS INTEGER) % 9 AS done FROM event_log)
SELECT book_id, total, CASE WHEN total > 0 THEN least(total, done) ELSE done END AS done FROM (
SELECT book_id, coalesce(arg_max(total, event_id) FILTER (total > 0), 0) AS total, arg_max(done, event_id) AS done FROM p GROUP BY book_id)""")
def st3(spark, d):
    e = M.event_log(spark, d)
    total = F.from_json("props", "k int")["k"] % 4 * (F.col("book_id") % 5 > 0).cast("int")
    return K.progress(e.withColumns({"total": total, "done": F.floor("value").cast("int") % 9}))


@query("ST7_once_only", """WITH p AS (SELECT user_id AS book_id, event_id % 20 AS part, bool_or(event_type = 'purchase') AS v, bool_or(event_type = 'error') AS f FROM events GROUP BY ALL)
SELECT book_id, count(*) FILTER (v) AS voiced, count(*) FILTER (NOT v AND f) AS failed FROM p GROUP BY book_id""")
def st7(spark, d):
    e = M.event_log(spark, d).withColumns({"part": F.col("event_id") % 20, "status": F.when(F.col("status") == "ready", "voiced").otherwise(F.col("status"))})
    return K.once_only(e, "book_id", "part")


@query("ST8_submissions", """SELECT event_id, book_id FROM (SELECT event_id, user_id AS book_id, event_type IN ('purchase', 'error') AS ended, lag(event_type IN ('purchase', 'error')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events
WHERE event_type IN ('purchase', 'error', 'signup', 'view')) WHERE NOT ended AND coalesce(before, true)""")
def st8(spark, d):
    e = M.event_log(spark, d)
    return K.accepted_submissions(e, "book_id", F.col("status").isin("discovering", "in_progress"), F.col("status").isin("ready", "failed")).select("event_id", "book_id")


@query("ST9_stuck", with_model("event_log") + """SELECT book_id, status, since FROM (SELECT book_id, arg_max(status, event_id) AS status, max(ts) AS since FROM event_log GROUP BY book_id) WHERE status = 'discovering' AND since < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 60 MINUTE AND book_id % 2 = 0""")
def st9(spark, d):
    e = M.event_log(spark, d)
    live = e.where("book_id % 2 <> 0").select("book_id").distinct()
    return K.stuck(e, live, F.lit("2024-01-31 00:00:00").cast("timestamp"))


@query("SS5_event_source", with_model("event_log") + "SELECT event_id, book_id, status AS type FROM event_log WHERE status <> 'in_progress'")
def ss5(spark, d):
    sent = M.event_log(spark, d).select(F.to_json(F.struct("event_id", "book_id", F.col("status").alias("type"))).alias("value"))
    return K.parsed_events(sent, "event_id long, book_id long, type string").where("type <> 'in_progress'")


@query("SS5_ST1_fan_out", with_model("event_log") + """, subs AS (SELECT 'l' || (c_custkey % 97) AS listener, CAST(c_custkey % 50 AS BIGINT) AS book_id, CASE WHEN c_custkey % 3 > 0 THEN [['ready', 'failed'], ['segment_ready']][c_custkey % 3] END AS types FROM customer)
SELECT listener, event_id, event_log.book_id, status AS type FROM event_log JOIN subs USING (book_id) WHERE types IS NULL OR list_contains(types, status)""")
def ss5_fan_out(spark, d):
    k = F.col("c_custkey")
    types = F.when(k % 3 == 1, F.lit(["ready", "failed"])).when(k % 3 == 2, F.lit(["segment_ready"]))
    subscriptions = M.table(spark, d, "customer").select(F.concat(F.lit("l"), (k % 97).cast("string")).alias("listener"), (k % 50).alias("book_id"), types.alias("types"))
    events = M.event_log(spark, d).select("event_id", "book_id", F.col("status").alias("type"))
    return X.fan_out(events, subscriptions).select("listener", "event_id", "book_id", "type")


@query("ST9_unanswered", with_model("event_log") + """, live AS (SELECT book_id, ts, event_id FROM event_log WHERE event_id % 3 = 0)
SELECT event_id, book_id FROM event_log a WHERE status = 'discovering' AND NOT EXISTS (SELECT 1 FROM (SELECT book_id, ts, event_id FROM event_log UNION ALL SELECT * FROM live) b
WHERE b.book_id = a.book_id AND (b.ts, b.event_id) > (a.ts, a.event_id) AND b.ts <= a.ts + INTERVAL 1440 MINUTE)""")
def st9_unanswered(spark, d):
    e = M.event_log(spark, d)
    jobs = e.where("event_id % 3 = 0").select("book_id", "ts", "event_id", F.lit("active").alias("state"))
    return X.stuck_stream(e, jobs, 1440).select("event_id", "book_id")
