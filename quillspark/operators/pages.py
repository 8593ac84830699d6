"""Pages of a book structured into chapters.

Only reading one page's HTML is Python (F1, F2); what is decided over a page's blocks is array functions on its row,
and what is decided along a book's pages runs on numbers and flags, in parts of a book.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import scan
from quillspark.sources.batches import pieces
from quillspark.sources.shared import Steps

BLOCK_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote"}
SILENT = {"script", "style", "svg"}
#: Tags that end an open paragraph. Fixed values.
ENDS_PARAGRAPH = (
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre search section summary table ul"
).split()
VOID = {"br", "hr", "img", "input", "link", "meta", "area", "base", "col", "embed", "source", "track", "wbr"}
#: Words of a book, words of a chapter, share of the pages behind which back matter may begin. Fixed values, as are the bounds in the page tests.
LEAST_WORDS, LEAST_PROSE, LATE = 500, 50, 0.6
_SPACE = re.compile(r"\s+")

BLOCK = "array<struct<tag:string,classes:string,kinds:string,text:string>>"
PARSED = f"raw_blocks {BLOCK}, headings array<string>, titled array<string>, page_type string, nav_links array<string>, items array<string>"


class _Reader(HTMLParser):
    """Collects text under block tags, headings, links of a contents list, and list items, in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.found: list[dict] = []
        self.quiet = 0
        self.page_type: str | None = None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in SILENT:
            self.quiet += 1
        if tag in ENDS_PARAGRAPH and self.open and self.open[-1]["tag"] == "p":  # an element left open in a paragraph holds what follows
            self.handle_endtag("p")
        if tag in VOID:
            return
        if tag == "body":
            self.page_type = a.get("epub:type", "")
        classes, kinds = a.get("class", ""), a.get("epub:type", "")
        item = {"tag": tag, "classes": classes, "kinds": kinds, "id": a.get("id", ""), "text": [], "link": tag == "a", "gone": False, "place": len(self.found)}
        item["skip"] = kinds == "pagebreak" or not {"pagebreak", "page"}.isdisjoint(classes.split())
        item["contents"] = tag != "body" and (tag == "nav" or kinds == "toc" or "toc" in classes.split() or item["id"] in ("toc", "contents"))
        item["in_list"] = tag == "li" and any(x["tag"] in ("ol", "ul") for x in self.open[-1:])
        item["within"] = [x["place"] for x in self.open if x["contents"]]
        self.open.append(item)
        self.found.append(item)

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.quiet = max(0, self.quiet - 1)
        if not any(x["tag"] == tag for x in self.open):
            return
        while (item := self.open.pop())["tag"] != tag:
            self._closed(item)
        self._closed(item)

    def _closed(self, item):
        if item["skip"] or item["tag"] == "sup" and item["link"]:  # goes with all that stands in it
            for inner in self.found[item["place"] :]:
                inner["gone"] = True
            return
        if self.open:
            self.open[-1]["text"] += item["text"]
            self.open[-1]["link"] |= item["link"]

    def handle_data(self, data):
        if self.open and not self.quiet:
            self.open[-1]["text"].append(data)


def read_page(html: str) -> tuple:
    """One page's ``PARSED`` fields."""
    r = _Reader()
    r.feed(html)
    r.close()
    while r.open:
        r._closed(r.open.pop())
    found = [x for x in r.found if not x["gone"]] if r.page_type is not None else []  # a page without a body is empty
    whole = {id(x): "".join(x["text"]) for x in found}
    blocks = [{"tag": x["tag"], "classes": x["classes"], "kinds": x["kinds"], "text": whole[id(x)]} for x in found if x["tag"] in BLOCK_TAGS]
    headings = [whole[id(x)].strip() for x in found if x["tag"] in ("h1", "h2", "h3")]
    titled = [whole[id(x)].strip() for x in found if x["tag"] in ("p", "div", "span") and re.search("title|head", x["classes"], re.I)]
    first = next((x["place"] for x in found if x["contents"]), None)  # of several contents lists only the first counts
    links = [whole[id(x)] for x in found if x["tag"] == "a" and first in x["within"]]
    items = [whole[id(x)] for x in found if x["in_list"]]
    return blocks, headings, titled, r.page_type or "", links, items


def parsed(pages: DataFrame) -> DataFrame:
    """F1 and F2's material: ``pages`` without ``html``, with the ``PARSED`` columns; no shuffle. A null page is an empty one."""
    rest = pages.drop("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = pa.list_(pa.string())
        kinds = {"raw_blocks": pa.list_(pa.struct([(name, pa.string()) for name in ("tag", "classes", "kinds", "text")])), "headings": texts, "titled": texts, "page_type": pa.string(), "nav_links": texts, "items": texts}
        for batch in batches:
            for part in pieces(batch):
                made = [read_page(h or "") for h in part["html"].to_pylist()]
                given = part.drop_columns("html")
                yield pa.RecordBatch.from_arrays([*given.columns, *(pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds.values()))], [*given.schema.names, *kinds])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return pages.mapInArrow(run, f"{fields}, {PARSED}")


def heading(title: Column) -> Column:
    """the first heading that isn't blank or the book's title, else the first short element with a title-like class."""
    fine = lambda h: (h != "") & (F.lower(h) != F.lower(title))
    return F.coalesce(F.try_element_at(F.filter("headings", fine), F.lit(1)), F.try_element_at(F.filter("titled", lambda h: fine(h) & (F.length(h) < 120)), F.lit(1)), F.lit(""))


def typed_blocks(title: Column) -> Column:
    """cleaned blocks with their types; dropped ones left out."""
    made = F.transform("raw_blocks", lambda b: F.struct(b["tag"].alias("tag"), b["classes"].alias("classes"), b["kinds"].alias("kinds"), T.clean_text(b["text"]).alias("text")))
    kept = F.filter(made, lambda b: ~T.is_dropped_block(b["text"], title))
    return F.transform(kept, lambda b: F.struct(T.block_type(b["tag"], b["classes"], b["kinds"], b["text"]).alias("type"), b["text"].alias("text"), T.count_words(b["text"]).alias("words"), T.is_toc_line(b["text"], clean=True).alias("toc")))


def _share(array: str, test) -> Column:
    return F.size(F.filter(array, test))


def is_toc_page() -> Column:
    """AG13, from ``blocks`` and ``heading``: headed as front matter, or mostly entries of a table of contents."""
    n = F.size("blocks")
    toc = F.aggregate("blocks", F.lit(0), lambda a, b: a + b["toc"].cast("int") + ((b["type"] == "heading") & b["text"].rlike(r"(?i)^(chapter|part|book)\b") & (b["words"] <= 10)).cast("int"))
    short, long = _share("blocks", lambda b: b["words"] <= 14), _share("blocks", lambda b: b["words"] >= 40)
    dense = (toc >= 4) & (toc / F.greatest(n, F.lit(1)) >= 0.45) & (long <= 1)
    return (n > 0) & (F.col("heading").rlike("(?i)" + T.FRONT_HEADINGS) | ((n >= 3) & (dense | ((n >= 5) & (short / F.greatest(n, F.lit(1)) >= 0.75) & (toc >= 3) & (long == 0)) | ((toc >= 3) & (toc / F.greatest(n, F.lit(1)) >= 0.7)))))


def is_front_matter() -> Column:
    """AG14: a dedication or a list of quotes."""
    n = F.size("blocks")
    words = F.aggregate("blocks", F.lit(0), lambda a, b: a + b["words"])
    short, long = _share("blocks", lambda b: b["words"] <= 25), _share("blocks", lambda b: b["words"] >= 60)
    quoted = _share("blocks", lambda b: b["type"].isin("poem", "letter") | b["text"].rlike('^\\s*["“]'))
    quotes = (n >= 3) & (long == 0) & ((short / F.greatest(n, F.lit(1)) >= 0.7) | (quoted / F.greatest(n, F.lit(1)) >= 0.5))
    return F.col("heading").rlike("(?i)" + T.FRONT_HEADINGS) | ((n > 0) & (((n <= 2) & (words <= 60)) | quotes))


def is_link_list() -> Column:
    """AG15: a contents element with many links, or a list of chapter names with little prose."""
    named = lambda t: T.is_toc_line(T.clean_text(t), clean=True) | t.rlike("(?i)chapter|part|book|prologue")
    links, chapterish = F.size("nav_links"), _share("nav_links", named)
    n = F.size("items")
    listed = _share("items", lambda t: T.is_toc_line(T.clean_text(t), clean=True) | ((T.count_words(t) <= 12) & t.rlike("(?i)chapter|part|book")))
    prose = F.aggregate("raw_blocks", F.lit(0), lambda a, b: a + F.when(b["tag"] == "p", T.count_words(b["text"])).otherwise(0))
    return F.col("heading").rlike("(?i)" + T.FRONT_HEADINGS) | ((links >= 4) & (chapterish >= 3)) | (links >= 8) | ((n >= 5) & (listed >= 4) & (listed / F.greatest(n, F.lit(1)) >= 0.5) & (prose < 80))


def without_leading_toc() -> Column:
    """WN4: blocks behind a leading run of three or more contents lines; pages of under four blocks stay as they are."""
    first = F.when(F.try_element_at("blocks", F.lit(1))["text"].rlike("(?i)" + T.FRONT_HEADINGS), 1).otherwise(0)
    start = F.struct(first.alias("at"), first.alias("cut"), F.lit(0).alias("run"), F.lit(False).alias("over"))

    def fold(s, b):
        entry = b["toc"] | ((b["words"] <= 10) & b["text"].rlike(r"(?i)^(chapter|part|book)\b"))
        filler = (b["words"] <= 6) & (s["run"] > 0)
        go = ~s["over"]
        return F.struct(
            (s["at"] + 1).alias("at"), F.when(go & (entry | filler), s["at"] + 1).otherwise(s["cut"]).alias("cut"),
            (s["run"] + (go & entry).cast("int")).alias("run"), (s["over"] | ~(entry | filler)).alias("over"))

    rest = F.slice("blocks", first + 1, F.greatest(F.size("blocks") - first, F.lit(0)))
    cut = F.aggregate(rest, start, fold, lambda s: F.when(s["run"] >= 3, s["cut"]).otherwise(0))
    return F.when(F.size("blocks") < 4, F.col("blocks")).otherwise(F.slice("blocks", cut + 1, F.size("blocks")))


def page_facts(pages: DataFrame, title: str | None = None) -> DataFrame:
    """Every page with its heading, blocks and tests. ``title``: the column of the book's title, if there is one."""
    name = F.col(title) if title else F.lit("")
    p = parsed(pages).withColumn("heading", heading(name)).withColumn("blocks", typed_blocks(name))
    p = p.withColumns({"toc_page": is_toc_page(), "link_list": is_link_list(), "matter_path": T.is_matter_path(F.col("path")), "landmark": F.col("page_type").rlike(r"(?i)\b(toc|contents|landmarks|loi|lot)\b"), "front_heading": F.col("heading").rlike("(?i)" + T.FRONT_HEADINGS)})
    p = p.drop("raw_blocks", "headings", "titled", "nav_links", "items", "page_type").withColumn("blocks", without_leading_toc())
    return p.withColumns({"words": F.aggregate("blocks", F.lit(0), lambda a, b: a + b["words"]), "front_body": is_front_matter()})


def chapters(pages: DataFrame, title: str | None = None, width: int = scan.WIDTH) -> DataFrame:
    """WN1 to WN3, AG4: (book_id, chapter_index, title, path, words, blocks) of the pages that are chapters; books of under 500 words have none.

    ``spine_index`` is a whole number, unique in its book. Pages are read once and written with their blocks; what is decided along a
    book runs on numbers and flags, in parts of ``width`` pages, and the blocks are joined to what is left, by page.
    """
    steps = Steps(pages.sparkSession)
    read = steps.keep(page_facts(pages, title).withColumn("_page", F.monotonically_increasing_id()))
    p = read.withColumn("n_blocks", F.size("blocks")).drop("blocks")
    counted = ~(F.col("matter_path") | F.col("front_heading") | F.col("landmark") | F.col("link_list") | F.col("toc_page")) & (F.col("n_blocks") > 0)
    p = p.withColumn("counted", counted)
    one = F.lit(1)
    p = scan.running(p, "book_id", "spine_index", width, place=scan.total(one), pages=scan.whole(one), words_before=scan.before(F.when(F.col("counted"), F.col("words")).otherwise(0)))
    ends = ~F.col("matter_path") & F.col("heading").rlike("(?i)" + T.BACK_HEADINGS) & (F.col("place") / F.col("pages") >= LATE) & (F.col("words_before") >= LEAST_WORDS)
    starts = F.col("heading").rlike("(?i)" + T.START_HEADINGS) | F.col("path").rlike("(?i)" + T.START_PATHS) | ((F.col("words") >= 400) & ~F.col("front_body"))
    p = steps.keep(p.withColumns({"ends": F.coalesce(ends, F.lit(False)), "starts": F.coalesce(starts, F.lit(False))}))

    # what is latched along a book holds from its first page on: the least index of a book, which combines before the shuffle
    over = p.where("ends").groupBy("book_id").agg(F.min("spine_index").alias("over"))
    long = p.join(over, "book_id", "left").where(F.col("counted") & (F.col("over").isNull() | (F.col("spine_index") < F.col("over"))) & (F.col("words") > LEAST_PROSE))
    begun = long.where("starts").groupBy("book_id").agg(F.min("spine_index").alias("begun"))
    told = steps.keep(long.join(begun, "book_id").where(F.col("spine_index") >= F.col("begun")))
    enough = told.groupBy("book_id").agg(F.sum("words").alias("book_words")).where(F.col("book_words") >= LEAST_WORDS).select("book_id")
    told = scan.running(told.join(enough, "book_id", "left_semi"), "book_id", "spine_index", width, number=scan.total(one))
    number = F.col("number").cast("int")
    name = F.when((F.col("heading") != "") & ~F.col("front_heading"), F.col("heading")).otherwise(F.concat(F.lit("Chapter "), number.cast("string")))
    if title:
        name = F.when(F.lower("heading") == F.lower(title), F.concat(F.lit("Chapter "), number.cast("string"))).otherwise(name)
    kept = told.select("_page", number.alias("chapter_index"), name.alias("_title"))
    return read.join(kept, "_page").select("book_id", "chapter_index", F.col("_title").alias("title"), "path", "words", "blocks")
