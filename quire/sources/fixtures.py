"""Small inline tables, as SQL that Spark and DuckDB both read, for what the test tables don't hold."""

from __future__ import annotations

# One case for each branch of the line rules (text, font, size, flags, x0, x1, width, language).
_CASES: list[tuple] = [
    ("فصل اول: علم کی فضیلت", "NotoNaskhArabic-Bold", 20.0, 0, 180, 420, 600, "ur"),
    ("﴿اقرأ باسم ربك الذي خلق﴾", "NotoNaskhArabic-Regular", 13.0, 0, 60, 540, 600, "ur"),
    ("Chapter One", "Times", 12.0, 0, 72, 150, 595, "en"),
    ("Section 2: scope", "Times", 12.0, 2, 72, 150, 595, "en"),
    ("BIG TITLE", "Times", 24.0, 0, 72, 500, 595, "en"),
    ("Sub", "Times-Bold", 14.0, 0, 72, 150, 595, "en"),
    ("Sub", "Times-Bold", 13.9, 0, 72, 150, 595, "en"),
    ("1. first item", "Times", 12.0, 0, 72, 150, 595, "en"),
    ("۱۔ پہلا", "Naskh", 12.0, 0, 400, 590, 595, "ur"),
    ("* note", "Times", 12.0, 0, 72, 150, 595, "en"),
    ("meet at 10:30 today", "Times", 12.0, 0, 72, 150, 595, "en"),
    ("رواه مسلم", "Naskh", 12.0, 0, 400, 590, 595, "ar"),
    ("A Hadith says", "Times", 12.0, 0, 72, 150, 595, "en"),
    ("- a dash line", "Times", 12.0, 0, 72, 150, 595, "en"),
    ("half     verse", "Times-Italic", 12.0, 0, 72, 150, 595, "en"),
    ("half    verse", "Times", 12.0, 0, 72, 150, 595, "en"),
    ("plain prose", "Times", None, 16, 10, 590, 595, "en"),
    ("ABC", "Times", 12.0, 0, 200, 500, 595, "en"),
    ("ABCD", "Times", 18.0, 0, 200, 470, 595, "en"),
    ("plain", "Times", 12.0, 4, None, None, 595, "en"),
    ("سادہ", "Naskh", 12.0, 0, None, None, 595, "en"),
    ("mid", "Times", 12.0, 0, 150, 260, 595, "ur"),
    ("CHAPITRE 1", "Times", 12.0, 0, 72, 150, 595, "fr"),
    ("باب", "Naskh", None, 0, 400, 590, 595, "ur"),
    ("half    verse", "Times", 12.0, 0, 72, 150, 595, "en"),
    ("١:٢", "Naskh", 12.0, 0, 400, 590, 595, "ar"),
]
# What each case gives (type, bold, italic, rtl, alignment, class).
EXPECTED: list[tuple] = [
    ("heading_2", True, False, True, "center", "heading"), ("text", False, False, True, "center", "quranic_verse"), ("heading_1", False, False, False, "left", "heading"),
    ("heading_2", False, True, False, "left", "heading"), ("heading_1", True, False, False, "center", "heading"), ("heading_3", True, False, False, "left", "heading"),
    ("bold", True, False, False, "left", "prose"), ("text", False, False, False, "left", "footnote"), ("text", False, False, True, "right", "footnote"),
    ("text", False, False, False, "left", "footnote"), ("text", False, False, False, "left", "quranic_verse"), ("text", False, False, True, "right", "hadith"),
    ("text", False, False, False, "left", "hadith"), ("text", False, False, False, "left", "poetry"), ("italic", False, True, False, "left", "poetry"),
    ("text", False, False, False, "left", "poetry"), ("bold", True, False, False, "center", "prose"), ("text", False, False, False, "right", "prose"),
    ("heading_2", True, False, False, "center", "heading"), ("text", False, False, False, "left", "prose"), ("text", False, False, True, "right", "prose"),
    ("text", False, False, True, "right", "prose"), ("bold", True, False, False, "left", "prose"), ("text", False, False, True, "right", "prose"),
    ("text", False, False, False, "left", "poetry"), ("text", False, False, True, "right", "quranic_verse"),
]


def _value(x: object) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x)


def values(rows: list[tuple], columns: str) -> str:
    """A table of rows as SQL."""
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_value, r)) + ')' for r in rows)}) AS t({columns}))"


LINES = values([(k, *c) for k, c in enumerate(_CASES)], "id, text, font_name, font_size, flags, x0, x1, page_width, lang")
SMALL_BOOK = values([("b", 0, 0, "aaaa"), ("b", 0, 1, "bbbb."), ("b", 1, 0, "cccc"), ("b", 1, 1, "dddddddddd"), ("b", 2, 0, "eeee")], "book, page, line, text")
ANSWERS = values([(0, "not json"), (1, '{"has_issues": true, "issues": [{"phrase": "p", "suggestion": "s", "reason": "r"}]}'), (2, '{"has_issues": false, "issues": []}'), (3, "{}")], "id, answer")
FLAG_ANSWERS = values([(0, '{"term": "x"}'), (1, '[{"term": "x", "category": "c", "suggested_translation": "y", "reasoning": "z"}, {"term": "w", "suggested_translation": "v"}]'), (2, "[]"), (3, "broken [")], "id, answer")
PROGRESS = values([(0, 0, 0), (1, 1, 3), (2, 3, 3), (3, 5, 8)], "id, completed, total")
OCR = values([(0, "kept", 0.75), (0, "lost", 0.74), (0, "  ", 0.9), (1, "sure", 0.9)], "page, text, confidence")
