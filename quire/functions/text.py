"""Text predicates as Column expressions. Digits and white space are Unicode's, so the patterns carry (?U)."""

from __future__ import annotations

import sys
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the classification rules look for.
RTL_LANGUAGES = ["ar", "ur", "he"]
RTL_CHARS = "[\\u0600-\\u06FF\\u0750-\\u077F\\u08A0-\\u08FF]"
BOLD_FONTS = "bold|black|semibold|demi"
ITALIC_FONTS = "italic|oblique"
HEADING_1 = "Chapter|الفصل|فصل|باب|سورة|کتاب"
HEADING_2 = "Section|المقطع|الجزء|مبحث|تنبیہ|تمہید"
SECTION_1 = "Chapter|Chapitre|الفصل|فصل|باب|سورة|کتاب"
HADITH_WORDS = ["hadith", "حديث", "روى", "رواه"]
SENTENCE_ENDS = [".", "?", "!", "۔", "؟", "؛", ":", "»", "”"]
POETRY_STARTS = ["-", "—", "˖"]
BOLD_FLAG, ITALIC_FLAG = 16, 2
DEFAULT_SIZE, DEFAULT_WIDTH = 12.0, 595.0
ITEM_START = r"(?U)^\(?\d+[).۔]"
#: What Unicode calls white space, all 25 of them.
SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(SPACE))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def has_rtl(text: Column) -> Column:
    return text.rlike(RTL_CHARS)


def is_all_caps(text: Column) -> Column:
    """More than three characters, with letters that have case, all of them capital."""
    return (F.length(text) > 3) & (text == F.upper(text)) & (text != F.lower(text))


@cache
def single_capitals() -> dict[str, str]:
    """Characters that have one character as their capital. That of ß isn't among Python's mappings."""
    each = ((c, c.upper(), c.title()) for c in map(chr, range(sys.maxunicode + 1)))
    found = {c: u if len(u) == 1 else t for c, u, t in each if len(u) == 1 or len(t) == 1}
    return {c: x for c, x in found.items() if c != x} | {"ß": "ẞ"}


def capitals(text: Column) -> Column:
    """In capitals, character by character as DuckDB's upper: ß gives ẞ and a ligature stays, where Spark's upper gives several letters."""
    table = single_capitals()
    return F.translate(text, "".join(table), "".join(table.values()))


def starts_item(text: Column) -> Column:
    return strip(text).rlike(ITEM_START)


def ends_sentence(text: Column) -> Column:
    return F.substring(F.rtrim(text, F.lit(SPACE)), -1, 1).isin(SENTENCE_ENDS)


def is_section_break(text: Column) -> Column:
    t = strip(text)
    return (F.length(t) >= 3) & (t.rlike(f"(?iu)^({SECTION_1}|{HEADING_2})") | t.rlike("^(---+|===+)$"))


def heading_level(text: Column, size: Column, bold: Column) -> Column:
    """1 to 3 by size where bold, else 1 or 2 by the first word, else 0; without a size always 0."""
    return (
        F.when(size.isNull(), 0)
        .when(bold & (size >= 24), 1)
        .when(bold & (size >= 18), 2)
        .when(bold & (size >= 14), 3)
        .when(text.rlike(f"(?iu)^({HEADING_1})"), 1)
        .when(text.rlike(f"(?iu)^({HEADING_2})"), 2)
        .otherwise(0)
    )


def content_class(text: Column, level: Column) -> Column:
    """The first class that fits. Plain searches come before the patterns that only their finds can match."""
    verse = F.contains(text, F.lit("۝")) | (F.contains(text, F.lit(":")) & text.rlike(r"(?U)\d\s*:\s*\d")) | (F.contains(text, F.lit("﴿")) & text.rlike("﴿.*﴾"))
    hadith, poetry = F.lit(False), F.lit(False)
    for w in HADITH_WORDS:
        hadith |= F.contains(F.lower(text) if w.isascii() else text, F.lit(w))
    for w in POETRY_STARTS:
        poetry |= text.startswith(w)
    poetry |= text.rlike(r"(?U)\s{4}")
    return (
        F.when(level > 0, "heading")
        .when(text.rlike(r"^[*†‡]") | text.rlike(ITEM_START), "footnote")
        .when(verse, "quranic_verse")
        .when(hadith, "hadith")
        .when(poetry, "poetry")
        .otherwise("prose")
    )


def alignment(x0: Column, x1: Column, page_width: Column, rtl: Column) -> Column:
    """From a line's horizontal extent; without one the side on which the script begins."""
    side = F.when(rtl, "right").otherwise("left")
    w = F.when(page_width.isNull() | (page_width == 0), DEFAULT_WIDTH).otherwise(page_width)
    return (
        F.when(x0.isNull() | x1.isNull(), side)
        .when(F.abs((x0 + x1) / 2 - w / 2) < w * 0.08, "center")
        .when(x1 - x0 > w * 0.8, "justify")
        .when(x0 < w * 0.2, "left")
        .when(x1 > w * 0.8, "right")
        .otherwise(side)
    )
