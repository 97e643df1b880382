"""Whole runs as tables: ingest of books, translation of their pending chunks, and the append-only logs of both."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.errors import NotFound
from quire.functions import text as T
from quire.operators import agents, chunking, layout, review
from quire.sources import documents as D
from quire.sources.schema import key


@dataclass(frozen=True)
class Ingested:
    """Rows for the tables book and chunk."""

    books: DataFrame
    chunks: DataFrame


def ingest(pages: DataFrame, target: int = chunking.TARGET, lang: str = "ur", used_ocr: Column | None = None) -> Ingested:
    """Pages (book, page, text) become books and chunks.

    A page is scanned where used_ocr says so, or where it has no text. A book without a line has no chunks and is extracted all
    the same. With a column `error` (as pdf_pages gives it) a book with an error and no page is failed.
    """
    error = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    scanned = used_ocr if used_ocr is not None else T.is_blank(F.col("text")) & F.col("page").isNotNull()
    whole = pages.groupBy("book").agg(F.count("page").alias("page_count"), F.coalesce(F.bool_or(scanned), F.lit(False)).alias("is_scanned"), F.array_join(F.array_sort(F.collect_set(error)), "; ").alias("errors"))
    lines = layout.metadata(layout.classify(layout.with_defaults(D.text_lines(pages.filter("page is not null")), lang)))
    parts = chunking.assemble(chunking.scan(lines.select("book", "page", "line", "text", "type", "content_class", "meta"), target))
    chunks = parts.select(key(F.col("book"), F.col("index")).alias("id"), F.col("book").alias("book_id"), "index", "raw_text", F.lit(None).cast("string").alias("translated_text"), "format_map", "content_type", F.lit("extracted").alias("status"), "page_start", "page_end", F.lit(0).alias("retry_count"), F.lit(None).cast("string").alias("error"))
    counts = chunks.groupBy(F.col("book_id").alias("book")).agg(F.count("*").cast("int").alias("total_chunks"))
    failed = (F.col("errors") != "") & (F.col("page_count") == 0)
    books = whole.join(counts, "book", "left").select(F.col("book").alias("id"), F.when(failed, "failed").otherwise("extracted").alias("status"), F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"), F.lit(0).alias("completed_chunks"), F.col("page_count").cast("int").alias("page_count"), "is_scanned", F.when(failed, F.col("errors")).alias("error"))
    return Ingested(books, chunks)


def translate_pending(chunks: DataFrame, glossary: DataFrame | None = None, build: Callable[[], agents.Model] | None = None, page_count: Column | None = None, at_once: int | None = agents.CALLS_AT_ONCE) -> DataFrame:
    """Translates the chunks (id, book, index, raw_text, status, and optionally page_start, retry_count) that are pending.

    Neighbours are found by index among all chunks. glossary: (book, glossary) as review.glossary_map gives it. With
    page_count only the chunks of the test window are taken. A chunk whose text is null fails: it keeps its state but
    for status, error and one more retry. Adds translated_text, error, retry_count, verification and flags.
    """
    near = chunking.neighbours_by_index(chunks)
    rows = review.pending(near)
    if page_count is not None:
        rows = review.page_window(rows, page_count)
    none = F.from_json(F.lit("[]"), "array<struct<term:string,translation:string>>")
    rows = (rows.join(glossary, "book", "left") if glossary is not None else rows.withColumn("glossary", none)).withColumn("glossary", F.coalesce("glossary", none))
    tried = F.coalesce(F.col("retry_count"), F.lit(0)) if "retry_count" in chunks.columns else F.lit(0)
    rows = rows.withColumn("retry_count", tried.cast("int"))
    done = agents.translate(rows.filter("raw_text is not null"), build, at_once=at_once)
    lost = rows.filter("raw_text is null").withColumns({"error": F.lit("the chunk has no text"), "status": F.lit("failed"), "retry_count": F.col("retry_count") + 1})
    kept = ["id", "book", "index", "translation", "status", "error", "retry_count", "verification", "flags"]
    return done.select(*kept).unionByName(lost.select("id", "book", "index", "status", "error", "retry_count"), allowMissingColumns=True).withColumnRenamed("translation", "translated_text")


def outcomes(books: DataFrame, results: DataFrame) -> DataFrame:
    """(book, n_chunks, n_failed, status): of each book of the run; one with nothing pending goes to review."""
    found = review.run_outcome(results)
    return books.select("book").join(found, "book", "left").select("book", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_failed", F.lit(0)).alias("n_failed"), F.coalesce("status", F.lit("review")).alias("status"))


def verification_rows(results: DataFrame, attempt: int = 1) -> DataFrame:
    """Rows for the table verification_result, one for each chunk that was verified."""
    v = F.col("verification")
    return results.filter(v.isNotNull()).select(key(F.col("id"), F.lit(attempt)).alias("id"), F.col("id").alias("chunk_id"), v["issues"].alias("suggestions"), v["score"].alias("score"), v["summary"].alias("summary"), F.lit(attempt).alias("attempt"))


def flag_rows(results: DataFrame) -> DataFrame:
    """Rows for the table terminology_flag, one for each flagged term, in the order of the answer."""
    each = results.select(F.col("id").alias("chunk_id"), F.posexplode("flags").alias("place", "f"))
    text = lambda name: F.coalesce(F.col(f"f.{name}"), F.lit(""))
    return each.select(key(F.col("chunk_id"), F.col("place")).alias("id"), "chunk_id", text("term").alias("term"), text("suggested_translation").alias("suggested_translation"), text("reasoning").alias("rationale"), F.lit("pending").alias("human_decision"))


def append(rows: DataFrame, root: str, table: str, batch: str) -> None:
    """Adds a batch to a table's log. A batch that is written again replaces itself alone, so a run can be repeated."""
    rows.write.mode("overwrite").parquet(f"{root}/{table}/batch={batch}")


def log(spark: SparkSession, root: str, table: str) -> DataFrame:
    """All batches of a table's log, with the column batch."""
    try:
        return spark.read.option("mergeSchema", True).parquet(f"{root}/{table}").withColumn("batch", F.col("batch").cast("string"))
    except AnalysisException as error:
        raise NotFound(f"no log of {table} under {root}") from error


def commit_ingest(done: Ingested, root: str, batch: str) -> None:
    """Writes a run as one unit: chunks first, then the books that make them count."""
    append(done.chunks, root, "chunk", batch)
    append(done.books, root, "book", batch)


def commit_run(results: DataFrame, books: DataFrame, root: str, batch: str) -> None:
    """Writes a translation run; what readers go by, the status of its books, comes last. results should be a written table."""
    append(verification_rows(results), root, "verification_result", batch)
    append(flag_rows(results), root, "terminology_flag", batch)
    append(results.select("id", "book", "index", "translated_text", "status", "error", "retry_count"), root, "chunk_state", batch)
    append(outcomes(books, results).select(F.col("book").alias("id"), "status"), root, "book_status", batch)


def chunks_now(spark: SparkSession, root: str) -> DataFrame:
    """The chunks of committed batches, a later batch replacing the book's earlier ones."""
    books = log(spark, root, "book").groupBy(F.col("id").alias("book_id")).agg(F.max("batch").alias("batch"))
    return log(spark, root, "chunk").join(books, ["book_id", "batch"])


def books_now(spark: SparkSession, root: str) -> DataFrame:
    """Each book's latest row, with the status of its latest run, if there was one."""
    books = review.latest(log(spark, root, "book"), ["id"], F.col("batch"))
    try:
        status = review.latest(log(spark, root, "book_status"), ["id"], F.col("batch")).select("id", F.col("status").alias("run_status"))
    except NotFound:
        return books
    return books.join(status, "id", "left").withColumn("status", F.coalesce("run_status", "status")).drop("run_status")
