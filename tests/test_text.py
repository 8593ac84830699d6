"""Literal rows for rules that the driver tables don't reach."""

from pyspark.sql import functions as F

from quillspark.functions import formats, text, validity
from quillspark.operators import packing, search


def values(spark, column, *inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_clean_text_keeps_the_order_of_its_steps(spark):
    assert values(spark, text.clean_text(F.col("x")), "a [1] b", " “Hi”\n ‘x’ ", "[12]") == ["a  b", "\"Hi\" 'x'", ""]


def test_dialogue(spark):
    assert values(spark, text.is_dialogue(F.col("x")), '"Go', "go'", "— he", "- he", "-he", "he") == [True, True, True, True, False, False]


def test_sentences(spark):
    got = values(spark, text.sentences(F.col("x")), 'Mr. Fox ran. "Stop!" He did? yes. Él no.', "One. Two.")
    assert got == [["Mr. Fox ran.", '"Stop!" He did? yes. Él no.'], ["One.", "Two."]]
    assert [packing.sentences(x) for x in ('Mr. Fox ran. "Stop!" He did? yes. Él no.', "One. Two.")] == got


def test_scene_breaks_and_toc_lines(spark):
    assert values(spark, text.is_scene_break(F.col("x")), "* * *", "***", "---", "**", "a ***") == [True, True, True, False, False]
    assert values(spark, text.is_toc_line(F.col("x")), "Chapter IV. Storm", "12. Arrival", "The Start ..... 9", "He sat.", "") == [True, True, True, False, False]


def test_matter_paths_match_whole_tokens_only(spark):
    got = values(spark, text.is_matter_path(F.col("x")), "a/copyright.xhtml", "jack.xhtml", "descent.xhtml", "attack_ch2.xhtml", "half-title.html", "acknowledgments.xhtml", "x_toc.html")
    assert got == [True, False, False, False, True, True, True]


def test_file_names_and_mail(spark):
    assert values(spark, text.safe_file_name(F.col("x")), "a/b.EPUB", "../x.pdf", None) == ["b.EPUB", "uploaded.epub", "uploaded.epub"]
    assert values(spark, text.clean_email(F.col("x")), "\t A@B.c ") == ["a@b.c"]


def test_durations(spark):
    ms = F.col("x").cast("double")
    assert values(spark, formats.duration(ms), "0", "61500", "-1", None, "NaN") == ["0:00", "1:02", "--:--", "--:--", "--:--"]
    assert values(spark, formats.duration(ms, hours=True), "3661000", "59000") == ["1:01:01", "0:59"]


def test_private_addresses(spark):
    ips = ["10.1.2.3", "172.16.0.1", "172.32.0.1", "8.8.8.8", "100.64.1.1", "::1", "fe80::1", "::ffff:127.0.0.1", "::ffff:7f00:1", "::ffff:808:808", "2001:db8::1", "240.0.0.1"]
    assert values(spark, validity.is_private_ip(F.col("x")), *ips) == [True, True, False, False, True, True, True, True, True, False, True, True]


def test_url_screening(spark):
    allowed = ["files.example", "store.example"]
    urls = ["https://a.b.store.example/x?t=1", "https://cdn.files.example/f", "https://store.example/f", "http://a.store.example/x", "https://store.example.evil.com/x", "https://evil.com/?x=store.example", "not a url", "https://localhost/x", "https://192.168.1.1/x"]
    assert values(spark, validity.url_problem(F.col("x"), allowed), *urls) == [None, None, None, "not https", "unexpected host", "unexpected host", "invalid", "unexpected host", "unexpected host"]


def test_client_ip_distrusts_short_chains(spark):
    assert values(spark, validity.client_ip(F.col("x"), F.lit("direct"), 2), "a, b, c", "a", None, " , ") == ["b", "direct", "direct", "direct"]


def test_safe_keys(spark):
    assert values(spark, validity.is_safe_key(F.col("x")), "../etc/passwd", "/abs/path", "books/x/seg.wav", "", None) == [False, False, True, False, False]


def test_query_variants(spark):
    rows = spark.createDataFrame([(0, "Harry Potter and the Philosopher's Stone", "J.K. Rowling"), (1, "Dune", "Herbert")], "i int, t string, a string")
    got = [r[0] for r in rows.orderBy("i").select(search.query_variants(F.col("t"), F.col("a"))).collect()]
    assert got == [
        ["Harry Potter and the Philosopher s Stone J K Rowling epub", "Harry Potter and the Philosopher s Stone Rowling epub", "Harry Potter and the Philosopher s Stone epub", "Harry Potter Philosopher Stone Rowling epub", "Harry Potter epub"],
        ["Dune Herbert epub", "Dune epub"],
    ]


def test_cache_key_ignores_case_and_punctuation(spark):
    empty = F.lit(None).cast("array<string>")
    key = search.cache_key(F.col("x"), F.lit("LE GUIN"), F.lit(None).cast("string"), empty, empty, F.lit(None).cast("int"))
    a, b = values(spark, key, "The Left-Hand of Darkness!", "the left hand of darkness")
    assert a == b


def test_release_gate_needs_every_title_token(spark):
    names = ["Lord of the Mysteries epub", "Think Like a Lord epub", "Lord of the Mysteries.pdf"]
    rows = spark.createDataFrame([(i, "Lord of the Mysteries", "Cuttlefish", n, "a" * 32, 1000, 5) for i, n in enumerate(names)], "id int, q_title string, q_author string, name string, hash string, size long, seeds int")
    assert [r.fits for r in search.release_score(rows).orderBy("id").collect()] == [True, False, False]


def test_white_space_is_that_of_the_rules(spark):
    """The byte order mark, tabs and no-break spaces are white space, U+0085 isn't."""
    rows = spark.createDataFrame([("\ufeff",), ("\ufeff***",), ("a\u00a0b\ufeff\tc",), ("\x85",)], "t string")
    t = F.col("t")
    got = rows.select(text.clean_text(t).alias("c"), text.count_words(t).alias("n"), text.is_scene_break(t).alias("b"), validity.bounded(t, 9).alias("ok")).collect()
    assert [tuple(r) for r in got] == [("", 0, False, False), ("***", 1, True, True), ("a b c", 3, False, True), ("\x85", 1, False, True)]
    chain = spark.createDataFrame([("a,\t b\u00a0",)], "c string")
    assert chain.select(validity.client_ip(F.col("c"), F.lit("x"), 1)).first()[0] == "b"
    assert chain.select(validity.first_text(F.lit("\t\u00a0"), F.lit("\tv "))).first()[0] == "v"


def test_heading_classes(spark):
    heads = ["Contents", "  prologue one", "Chapter 2", "NOTES", "Glossary", "A note on the text", "chapters", "Sample", "", None, "About the author"]
    got = [r[0] for r in spark.createDataFrame([(h,) for h in heads], "h string").select(text.heading_class(F.col("h"))).collect()]
    assert got == ["front", "start", "start", "back", "back", "front", None, "front", None, None, "front"]
