"""Per-line format metadata, in Column expressions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T


def classify(lines: DataFrame) -> DataFrame:
    """Adds type, bold, italic, alignment, rtl, content_class and heading_level to lines.

    lines: text, font_name, font_size, flags, x0, x1, page_width, lang; what a source doesn't have may be null.
    """
    name, flags = F.lower(F.coalesce("font_name", F.lit(""))), F.coalesce("flags", F.lit(0))
    t = T.strip(F.col("text"))
    rows = lines.withColumn("text", t)
    t = F.col("text")
    bold = name.rlike(T.BOLD_FONTS) | (flags.bitwiseAND(T.BOLD_FLAG) != 0) | T.is_all_caps(t)
    italic = name.rlike(T.ITALIC_FONTS) | (flags.bitwiseAND(T.ITALIC_FLAG) != 0)
    rtl = F.coalesce(F.col("lang").isin(T.RTL_LANGUAGES), F.lit(False)) | T.has_rtl(t)
    rows = rows.withColumns({"bold": bold, "italic": italic, "rtl": rtl})
    rows = rows.withColumn("heading_level", T.heading_level(t, F.col("font_size"), F.col("bold")))
    kind = F.when(F.col("heading_level") > 0, F.concat(F.lit("heading_"), F.col("heading_level").cast("string"))).when(F.col("bold"), "bold").when(F.col("italic"), "italic").otherwise("text")
    return rows.withColumns({"type": kind, "alignment": T.alignment(F.col("x0"), F.col("x1"), F.col("page_width"), F.col("rtl")), "content_class": T.content_class(t, F.col("heading_level"))})


def with_defaults(lines: DataFrame, lang: str = "ur") -> DataFrame:
    """Plain text lines as layout lines: default font and size, no box."""
    none = F.lit(None).cast("double")
    return lines.withColumns({"font_name": F.lit(""), "font_size": F.lit(T.DEFAULT_SIZE), "flags": F.lit(0), "x0": none, "x1": none, "page_width": none, "lang": F.lit(lang)})


def metadata(lines: DataFrame) -> DataFrame:
    """Classified lines with a struct `meta` of their format, named by page and place among all blocks."""
    line_id = F.format_string("page%d_line%d", F.col("page").cast("int"), F.col("line").cast("int"))
    return lines.withColumn("meta", F.struct(line_id.alias("line_id"), "text", "type", F.col("font_size").cast("double").alias("font_size"), "bold", "italic", "alignment", "rtl", F.col("page").cast("int").alias("page"), "content_class"))


def map_format(blocks: DataFrame) -> DataFrame:
    """Metadata of blocks (book, page, line, kind, text, ...): of text blocks alone, numbered on by ordinal.

    A line_id names a block's place among all blocks, ordinal its place among the text blocks of its page.
    """
    text = metadata(classify(blocks.filter("kind = 'text'")))
    return text.withColumn("ordinal", (F.row_number().over(Window.partitionBy("book", "page").orderBy("line")) - 1).cast("int"))
