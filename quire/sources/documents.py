"""Sources: where lines and blocks come from."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.stats import dominant, mean_or
from quire.functions.text import is_blank, strip

#: Ids that are numbered together.
RUN = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def book_pages(documents: DataFrame) -> DataFrame:
    """(book, page, text): a source's documents are a book's pages, in the order of their ids.

    Texts are numbered within runs of ids, and only the runs' counts within a source, so no task holds a source's texts.
    The key is a struct, for which null sources are equal.
    """
    run = F.struct("source", F.floor(F.col("doc_id") / RUN).alias("run"))
    counts = documents.select(run.alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("key.source").orderBy("key.run")) - F.col("n")
    place = F.row_number().over(Window.partitionBy("key").orderBy("doc_id")) - 1
    rows = documents.select(run.alias("key"), "doc_id", "text").withColumn("place", place)
    page = F.col("place") + F.col("before")
    return rows.join(counts.select("key", before.alias("before")), "key").select(F.col("key.source").alias("book"), page.cast("int").alias("page"), "text")


def text_lines(pages: DataFrame) -> DataFrame:
    """(book, page, line, text): the lines that aren't blank, stripped, each with its place on the page."""
    lines = pages.select("book", "page", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    return lines.filter(~is_blank(F.col("raw"))).select("book", "page", "line", strip(F.col("raw")).alias("text"))


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, line_index, tag, text, font_size, flags): h1, p and li elements as text blocks, without inner tags."""
    found = F.regexp_extract_all("html", F.lit(r"(?s)<(?:h1|p|li)(?:\s[^>]*)?>.*?</(?:h1|p|li)>"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("line_index", "element"))
    tag = F.regexp_extract("element", "^<(\\w+)", 1)
    text = strip(F.regexp_replace("element", "<[^>]*>", ""))
    return rows.select("page_id", "line_index", tag.alias("tag"), text.alias("text"), F.when(tag == "h1", 24.0).otherwise(12.0).alias("font_size"), F.when(tag == "h1", 16).otherwise(0).alias("flags"))


def span_text(text: Column, chars: Column) -> Column:
    """A span's text, or its characters joined."""
    return F.coalesce(text, F.array_join(F.transform(chars, lambda c: c["c"]), ""))


def span_rollup(spans: Column, chars: bool = False) -> Column:
    """A line from its spans: texts joined without a gap, the dominant font, the mean size and the largest flags.

    With chars a span that has no text is read from its characters.
    """
    pick = lambda name: F.transform(spans, lambda s: s[name])
    texts = F.transform(spans, lambda s: span_text(s["text"], s["chars"])) if chars else pick("text")
    return F.struct(strip(F.array_join(texts, "")).alias("text"), dominant(pick("font")).alias("font_name"), mean_or(pick("size")).alias("font_size"), F.coalesce(F.array_max(pick("flags")), F.lit(0)).alias("flags"))


def page_blocks(raw: DataFrame) -> DataFrame:
    """Blocks of raw(page, blocks): images as stubs, other kinds dropped, one text block for each line that isn't blank."""
    block = raw.select("page", F.posexplode("blocks").alias("block", "b")).filter("b.type in (0, 1)")
    line = block.select("page", "block", F.col("b.type").alias("kind"), "b.bbox", F.posexplode_outer("b.lines").alias("line", "l"))
    rolled = line.withColumn("r", span_rollup(F.col("l.spans")))
    kept = rolled.filter((F.col("kind") == 1) | ~is_blank(F.col("r.text")))
    return kept.select("page", "block", "line", F.when(F.col("kind") == 1, "image").otherwise("text").alias("type"), F.coalesce("l.bbox", "bbox").alias("bbox"), "r.text", "r.font_name", "r.font_size", "r.flags")


def page_texts(blocks: DataFrame) -> DataFrame:
    """(page, text, needs_ocr): a page's text lines joined; a page without any goes to character recognition."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == "text", F.struct("block", "line", "text")))), lambda x: x["text"]), "\n")
    return blocks.groupBy("page").agg(text.alias("text")).withColumn("needs_ocr", is_blank(F.col("text")))


def ocr_lines(found: DataFrame, confidence: float = 0.75) -> DataFrame:
    """Recognised lines that are sure enough and not blank, each with the rectangle around its polygon."""
    xs, ys = F.transform("polygon", lambda p: p["x"]), F.transform("polygon", lambda p: p["y"])
    kept = found.filter((F.col("confidence") >= confidence) & ~is_blank(F.col("text")))
    return kept.select("page", strip(F.col("text")).alias("text"), F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"), "confidence")


def vision_lines(pages: DataFrame) -> DataFrame:
    """Lines of a recognised page text, spread evenly over the page's height."""
    lines = F.filter(F.split("text", r"\R"), lambda x: ~is_blank(x))
    each = pages.select("page", "width", "height", F.size(lines).alias("n"), F.posexplode(lines).alias("line", "text"))
    y = F.col("height") / F.greatest("n", F.lit(1)) * F.col("line")
    return each.select("page", "line", strip(F.col("text")).alias("text"), F.lit(0.0).alias("x0"), y.alias("y0"), F.col("width").alias("x1"), (y + 14).alias("y1"))


def pdf_pages(spark: SparkSession, path: str, parse: Callable[[bytes], list[dict]]) -> DataFrame:
    """(path, page, text, error) of PDF files. parse turns a file's bytes into pages; no parser is bundled.

    A file that can't be parsed gives one row with the error, and the others go on.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [(p, k, x.get("text"), None) for k, x in enumerate(parse(content))]
                except Exception as error:  # noqa: BLE001
                    rows.append((p, None, None, str(error)))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "error"]).astype({"page": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    return files.select("path", "content").mapInPandas(work, "path string, page int, text string, error string")


def extraction(pages: DataFrame) -> DataFrame:
    """(book, page_count, is_scanned, errors) from pages (book, page, used_ocr, error): scanned if any page was."""
    errors = F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("page", "error"))))
    return pages.groupBy("book").agg(F.count("page").alias("page_count"), F.coalesce(F.bool_or("used_ocr"), F.lit(False)).alias("is_scanned"), F.transform(errors, lambda e: e["error"]).alias("errors"))


def recognise(pages: DataFrame, ladder: list[Callable[[bytes], list[dict]]]) -> DataFrame:
    """(book, page, text, confidence, error): lines of page images, from the first engine of the ladder that works.

    An engine takes an image and gives lines (text, confidence). A page that none can read has one row with the last
    error; a null image is such a page.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for book, page, image in zip(b["book"], b["page"], b["image"], strict=True):
                error = "no engine"
                for engine in ladder:
                    try:
                        rows += [(book, page, x["text"], float(x["confidence"]), None) for x in engine(image)]
                        break
                    except Exception as e:  # noqa: BLE001
                        error = str(e) or type(e).__name__
                else:
                    rows.append((book, page, None, None, error))
            yield pd.DataFrame(rows, columns=["book", "page", "text", "confidence", "error"]).astype({"page": "Int32"})

    kind = dict(pages.dtypes)["book"]
    return pages.select("book", F.col("page").cast("int").alias("page"), "image").mapInPandas(work, f"book {kind}, page int, text string, confidence double, error string")


def upload_name(name: Column, unique: Column) -> Column:
    """A stored file's name: a unique prefix and the base name; null unless it is a PDF."""
    return F.when(F.lower(name).endswith(".pdf"), F.concat(unique, F.lit("_"), F.regexp_extract(name, r"([^/\\]+)$", 1)))


def extraction_band(discrepancy: Column) -> Column:
    """How far an extracted text is off: high under 5 %, medium up to 20 %, else low."""
    return F.when(discrepancy < 0.05, "high").when(discrepancy <= 0.20, "medium").otherwise("low")
