"""Text functions: cleaning, dialogue, word counts, sentences, line and heading classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations after which a full stop doesn't end a sentence. Fixed values.
ABBREVIATIONS = "Mr Mrs Ms Dr Prof Sr Jr vs St Jan Feb Mar Apr Jun Jul Aug Sep Oct Nov Dec".split()
#: Characters that may open a sentence. Fixed values.
OPENERS = "A-Z\"“'‘—"
#: Stem words and prefixes of front and back matter. Fixed values.
MATTER_WORDS = (
    "copyright toc ncx cx contents nav cover index biblio references about author ack acks advert adverts summary synopsis preface "
    "foreword epigraph praise imprint glossary appendix endnotes footnotes chronology intro desc blurb teaser half title excerpt sample"
).split()
MATTER_STEMS = (
    r"copy\d+|title\d+|map\d+|half[-_]?title|front[-_]?matter|frontmatter|table[-_]?of[-_]?contents|acknowledg|dedicat|synops|glossar"
    "|chronolog|illustrat|appendices|bibliograph"
)
#: Heading patterns, to be matched without regard to case. Fixed values.
FRONT_HEADINGS = (
    r"^\s*(synopsis|contents|table of contents|list of (chapters|illustrations)|index|preface|foreword|introduction|dedication|epigraph|acknowledg"
    r"|about the (author|publisher|book|novel|story|edition)|about this (book|edition|novel|story)|also by|by the same author|praise\b|reviews?"
    r"|editorial review|description|blurb|publisher'?s note|author'?s note|a note\b|note from|note on the text|copyright|illustrations|chronology"
    r"|a chronology|the editor|half title|reader'?s guide|cast of characters|dramatis personae|preview|excerpt|sample)\b"
)
BACK_HEADINGS = (
    r"^\s*(contexts|criticism|critical (essays|contexts|heritage)|appendix|appendices|bibliography|selected bibliography|works cited|endnotes|notes"
    r"|glossary|index|about the author|about the publisher|afterword|chronology|a chronology)\b"
)
START_HEADINGS = r"^\s*(prologue|chapter|volume|part|book)\s+"
START_PATHS = r"ch(?:apter)?[_-]?\d|part[_-]?\d|prologue"
#: Lines that stand in a table of contents. Fixed values.
TOC_LINES = [
    r"^(?:chapter|part|book|section|prologue|epilogue|canto|act|volume|story)\s+(?:[ivxlcdm]+|\d+|[a-z]|one|two|three|four|five|six|seven|eight|nine|ten"
    r"|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty)(?:\b|[.:)\-–—])",
    r"^(?:[ivxlcdm]+|\d{1,3})[\.\)\:\-–—]\s+\S+",
    r"^chapter\s+([ivxlcdm]+|\d+)\s*$",
    r"\S.{2,80}\s+[\.·…]{2,}\s*\d{1,4}\s*$",
]
PAGE_NUMBER = r"^\d{1,4}$"
PAGE_TAIL = r"^[.…·•\-\s]*\d{1,4}\s*$"
#: White space: Unicode's spaces and line ends, and the byte order mark, but not U+0085. Fixed values.
SPACE = r"[\p{IsWhite_Space}\ufeff&&[^\x85]]"
SPACES = SPACE + "+"
SENTENCE_GAP = r"(?<=[.!?])(?<!(?<![A-Za-z0-9_])(?:" + "|".join(ABBREVIATIONS) + r")\.)" + SPACES + "(?=[" + OPENERS + "])"  # the cheap test stands first


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACES}|{SPACES}$", "")


def clean_text(text: Column) -> Column:
    """white space collapsed, then citations cut, then trimmed, then quotes straightened."""
    text = F.regexp_replace(F.regexp_replace(text, SPACES, " "), r"\[\d+\]", "")
    return F.translate(F.trim(text), "“”‘’", "\"\"''")  # no other white space is left


def is_dialogue(text: Column, clean: bool = False) -> Column:
    """opens or closes with a quote, or opens with a dash. ``clean``: the text comes from ``clean_text`` and needs no trimming."""
    t = text if clean else trimmed(text)
    return t.startswith('"') | t.endswith('"') | t.startswith("'") | t.endswith("'") | t.startswith("—") | t.startswith("- ")


def count_words(text: Column) -> Column:
    """F7."""
    return F.size(F.filter(F.split(text, SPACES), lambda w: w != ""))


def sentences(text: Column) -> Column:
    """F8: split at white space after a stop and before an opener, but not after an abbreviation."""
    return F.filter(F.transform(F.split(text, SENTENCE_GAP), trimmed), lambda s: s != "")


def is_scene_break(text: Column) -> Column:
    """three or more stars, or --- or ___."""
    t = trimmed(text)
    return t.rlike(r"^(\*" + SPACE + "*){3,}$") | t.isin("---", "___")


def is_toc_line(text: Column, clean: bool = False) -> Column:
    """F11. ``clean`` as in ``is_dialogue``."""
    t = text if clean else trimmed(text)
    found = F.lit(False)
    for p in TOC_LINES:
        found = found | t.rlike("(?i)" + p)
    return (t != "") & (F.length(t) <= 120) & found


def is_matter_path(path: Column) -> Column:
    """the file's stem begins as matter does, or holds a matter word as a whole token."""
    stem = F.lower(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.[a-z0-9]+$", ""))
    return stem.rlike("^(?:" + MATTER_STEMS + ")") | F.arrays_overlap(F.split(stem, "[^a-z0-9]+"), F.lit(MATTER_WORDS))


def heading_class(heading: Column) -> Column:
    """'front', 'back', 'start' or null."""
    return F.when(heading.rlike("(?i)" + FRONT_HEADINGS), "front").when(heading.rlike("(?i)" + BACK_HEADINGS), "back").when(heading.rlike("(?i)" + START_HEADINGS), "start")


def block_type(tag: Column, classes: Column, kinds: Column, text: Column) -> Column:
    """by tag, class names (footnotes by type names too), then dialogue; of a clean text."""
    named = lambda *words: F.greatest(*[F.contains(classes, F.lit(w)) for w in words], F.lit(False))
    return (
        F.when(tag.rlike("^h[1-6]$"), "heading").when(named("footnote") | F.contains(kinds, F.lit("footnote")), "footnote")
        .when((tag == "blockquote") | named("poem"), "poem").when(named("letter", "epistle"), "letter")
        .when(is_dialogue(text, clean=True), "dialogue").otherwise("narration")
    )


def is_dropped_block(text: Column, title: Column) -> Column:
    """blank, a running head, a page number or its dotted tail."""
    return (text == "") | ((F.length(text) < 60) & (F.lower(text) == F.lower(title))) | text.rlike(PAGE_NUMBER) | text.rlike(PAGE_TAIL)


def clean_email(email: Column) -> Column:
    """F25."""
    return F.lower(trimmed(email))


def safe_file_name(name: Column, extension: str = ".epub", fallback: str = "uploaded.epub") -> Column:
    """the base name if it has the extension, else the fallback."""
    base = F.element_at(F.split(F.regexp_replace(F.replace(name, F.lit("\0"), F.lit("")), "/+$", ""), "/"), -1)
    return F.when(F.lower(base).endswith(extension), base).otherwise(fallback)


def without_controls(text: Column) -> Column:
    """control characters become spaces."""
    return F.regexp_replace(text, r"[\x00-\x1f\x7f]", " ")
