"""The registered queries of the ten operators, over their whole tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import byte_bpe, flac_media, hard_negatives, html_blocks, kk_packing, language_id, license_scan, phrase_automata, simhash_vptree, spelling_variants, suffix_radix, token_transducer, vptree_ann
from quillspark.llm.scratch import spread, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by hyperdimensional profiles."""
    return language_id.identify(spread(table(spark, sf_dir, "documents")))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to byte-level BPE ids and decoded again."""
    return byte_bpe.round_trip(spread(table(spark, sf_dir, "documents")))


def op3_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash_vptree.near_duplicates(spread(table(spark, sf_dir, "documents")))
    return found.select("doc_id", simhash_vptree.hexadecimal("fp").alias("fingerprint"), "component_id")


def op4_kk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 4096 tokens."""
    return kk_packing.pack_documents(spread(table(spark, sf_dir, "documents")))


def op5_vptree_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    rows = table(spark, sf_dir, "embeddings")
    return vptree_ann.nearest(rows, rows.where(F.col("vec_id") % 20 == 0))


def op6_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return html_blocks.extract(pages, html_blocks.fit(pages))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without passages of 20 words that began earlier."""
    return phrase_automata.dedup_digest(table(spark, sf_dir, "documents"))


def op9_suffix_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without byte strings of 200 that begin anywhere else."""
    return suffix_radix.dedup_digest(table(spark, sf_dir, "documents"))


def op10_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a FLAC stream and read back."""
    return flac_media.round_trip(spread(table(spark, sf_dir, "documents")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every frequent word of all documents."""
    return spelling_variants.variants(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_token_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted by transducers."""
    return token_transducer.token_counts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, over whole-number vectors and some changed labels."""
    i, each = F.col("vec_id"), lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.floor(x.cast("double") * 256))
    rows = table(spark, sf_dir, "embeddings").select(i, F.when(i % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), F.transform("embedding", each).alias("embedding"))
    return hard_negatives.mine(spread(rows), F.col("vec_id") % 50 == 0)


_OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), lambda a, b: a + b) AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _op7_sql() -> str:
    phrases = ", ".join(f"({p.split()}, '{label}')" for p, label in license_scan.PHRASES.items())
    templates = ", ".join(f"({i}, {sorted(set(words.split()))}, '{label}', {2 * len(words.split())})" for i, (label, words) in enumerate(license_scan.TEMPLATES))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH phrase(words, label) AS (VALUES {phrases}),
template(id, words, label, room) AS (VALUES {templates}),
d AS (SELECT doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '{_GAP}'), lambda x: x <> '') AS words FROM d),
place AS (
  SELECT doc_id, i, phrase.label FROM (SELECT doc_id, words, unnest(range(len(words))) AS i FROM w) x, phrase
  WHERE x.words[i + 1] = phrase.words[1] AND x.words[i + 1 : i + len(phrase.words)] = phrase.words),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base FROM place GROUP BY doc_id),
sized AS (SELECT *, len(words) AS n, CAST(ceil({license_scan.THRESHOLD} * len(words) - 1e-9) AS BIGINT) AS needed FROM template),
line AS (SELECT doc_id, list_distinct(regexp_split_to_array(unnest(string_split(t, chr(10))), '{_GAP}')) AS words FROM d),
near AS (  -- texts and templates with enough common words in all, then each run of twice the template's words
  SELECT w.doc_id, w.words AS all_words, sized.* FROM w, sized WHERE n >= {license_scan.SHORT} AND len(list_intersect(w.words, sized.words)) >= needed),
run AS (SELECT doc_id, label, n, needed, words, all_words[i : i + room - 1] AS part FROM (
  SELECT *, unnest(range(1, greatest(len(all_words) - room + 1, 1) + 1)) AS i FROM near)),
met AS (
  SELECT doc_id, label, len(list_intersect(part, words)) / n AS share FROM run WHERE len(list_intersect(part, words)) >= needed
  UNION ALL
  SELECT doc_id, label, len(list_intersect(line.words, sized.words)) / n FROM line, sized WHERE n < {license_scan.SHORT} AND len(list_intersect(line.words, sized.words)) >= needed),
more AS (SELECT doc_id, list(DISTINCT label) AS more, max(share) AS score FROM met GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ',') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM w LEFT JOIN base ON w.doc_id = base.doc_id LEFT JOIN more ON w.doc_id = more.doc_id
"""


_OP8 = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(words[i + 1 : i + 20], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(len(words) - 19)) AS i FROM w WHERE len(words) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(20)) AS p FROM later),
listed AS (SELECT doc_id, list(p) AS p FROM gone GROUP BY doc_id),
one AS (SELECT doc_id, p, words[p + 1] AS word FROM (SELECT doc_id, words, unnest(range(len(words))) AS p FROM w)),
kept AS (SELECT one.doc_id, string_agg(word, ' ' ORDER BY one.p) AS t FROM one ANTI JOIN gone ON one.doc_id = gone.doc_id AND one.p = gone.p GROUP BY one.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(listed.p), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN listed ON w.doc_id = listed.doc_id LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


_OP13 = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor_id, c.id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a, v c WHERE a.id % 50 = 0 AND a.id <> c.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def _op11_sql() -> str:
    """The checksum goes byte by byte; near words meet by what is left without one letter, and are compared in an alphabet of one byte a letter."""
    upper, lower = spelling_variants.UPPER, spelling_variants.LOWER
    wide = "".join(map(chr, range(0xC0, 0x100)))
    narrow = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).islower() and chr(c) != "'")[:64]
    table = list(range(256))
    for _ in range(8):
        table = [x >> 1 ^ 0xEDB88320 * (x & 1) for x in table]
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS raw FROM documents),
crc AS (SELECT {table}::BIGINT[] AS t),
runs AS (SELECT doc_id, translate(raw, '{upper}', '{lower}') AS run, count(*) AS times FROM d WHERE length(raw) >= 7 GROUP BY ALL),
sums AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(b), 2), lambda i: ('0x' || b[i : i + 1])::BIGINT)), lambda a, x: xor(a >> 8, crc.t[(xor(a, x) & 255) + 1])), 4294967295::BIGINT) AS h
  FROM (SELECT run, times, hex(doc_id || ':' || run) AS b FROM runs), crc),
words AS (SELECT CASE WHEN h % 31 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, times FROM sums),
v AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
sig AS (SELECT word, n, word AS s FROM v UNION SELECT word, n, word[1 : i - 1] || word[i + 1 :] FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
met AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM sig a JOIN sig b USING (s) WHERE a.word <> b.word),
link AS (SELECT * FROM met WHERE levenshtein(translate(word, '{wide}', '{narrow}'), translate(near, '{wide}', '{narrow}')) = 1),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM link GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form, CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, walk.root FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NULL)
SELECT f.word, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form, f.form_n, ends.root FROM f JOIN ends USING (word)
"""


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op5_vptree_ann": _OP5, "op7_license_scan": _op7_sql(), "op8_phrase_automata": _OP8, "op11_spelling_variants": _op11_sql(), "op13_hard_negatives": _OP13}
