"""Whole runs, their logs, the command line, settings and the hooks for engines and endpoints."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from quire import cli, settings
from quire.errors import NotFound
from quire.operators import agents, review, runs
from quire.sources import documents as D


@pytest.fixture
def pages(spark):
    rows = [("a", 0, "Chapter One\nfirst line.\nsecond line"), ("a", 1, "third"), ("b", 0, ""), ("c", 0, None)]
    return spark.createDataFrame(rows, "book string, page int, text string")


def test_ingest(spark, pages):
    broken = spark.createDataFrame([("d", None, None, "no such file"), ("a", None, None, "odd font")], "book string, page int, text string, error string")
    done = runs.ingest(pages.withColumn("error", F.lit(None).cast("string")).unionByName(broken))
    got = {r.id: (r.status, r.total_chunks, r.page_count, r.is_scanned, r.error) for r in done.books.collect()}
    assert got == {"a": ("extracted", 1, 2, False, None), "b": ("extracted", 0, 1, True, None), "c": ("extracted", 0, 1, True, None), "d": ("failed", 0, 0, False, "no such file")}
    chunk = done.chunks.first()
    assert chunk.raw_text == "Chapter One\nfirst line.\n\nsecond line\nthird" and chunk.content_type == "prose"
    assert [(m.line_id, m.type) for m in chunk.format_map] == [("page0_line0", "heading_1"), ("page0_line1", "text"), ("page0_line2", "text"), ("page1_line0", "text")]


def chunk_rows(spark, rows):
    return spark.createDataFrame([(f"i{k}", "b", *r) for k, r in enumerate(rows)], "id string, book string, index int, raw_text string, status string, page_start int, retry_count int")


def test_a_run_fails_chunks_without_text_and_counts_tries(spark):
    chunks = chunk_rows(spark, [(0, "x", "extracted", 1, 0), (1, None, "failed", 2, 2), (2, "y", "approved", 3, 0), (4, "z", "failed", 9, 1)])
    seen = {r["index"]: r for r in runs.translate_pending(chunks, build=lambda: lambda p: "[]" if "JSON array" in p else p[-40:]).collect()}
    assert {k: (r.status, r.retry_count) for k, r in seen.items()} == {0: ("terminology_reviewed", 0), 1: ("failed", 3), 4: ("terminology_reviewed", 1)}
    assert seen[1].error == "the chunk has no text" and seen[4].translated_text.endswith("(No context)")
    window = runs.translate_pending(chunks, page_count=F.lit(2))
    assert {r["index"] for r in window.collect()} == {0, 1}
    books = spark.createDataFrame([("b",), ("other",)], "book string")
    assert {r.book: (r.n_chunks, r.n_failed, r.status) for r in runs.outcomes(books, runs.translate_pending(chunks)).collect()} == {"b": (3, 1, "review"), "other": (0, 0, "review")}
    lost = runs.translate_pending(chunks.filter("raw_text is null"))
    assert [r.status for r in runs.outcomes(books, lost).orderBy("book").collect()] == ["failed", "review"]


def test_logs(spark, pages, tmp_path):
    root = str(tmp_path)
    with pytest.raises(NotFound):
        runs.books_now(spark, root)
    for batch in ("1", "1", "2"):
        runs.commit_ingest(runs.ingest(pages if batch == "1" else pages.filter("page = 0"), 10), root, batch)
    assert runs.log(spark, root, "book").groupBy("batch").count().collect() and runs.log(spark, root, "book").count() == 6
    assert {r.batch for r in runs.chunks_now(spark, root).collect()} == {"2"}
    # chunks without their books, as a broken run leaves them, don't count
    runs.append(runs.ingest(pages).chunks, root, "chunk", "3")
    chunks = runs.chunks_now(spark, root).withColumnRenamed("book_id", "book")
    assert {r.batch for r in chunks.collect()} == {"2"}
    results = runs.translate_pending(chunks).cache()
    runs.commit_run(results, runs.books_now(spark, root).withColumnRenamed("id", "book"), root, "1")
    assert {r.status for r in runs.books_now(spark, root).collect()} == {"review"}
    assert runs.log(spark, root, "verification_result").count() == results.count() > 1
    assert runs.log(spark, root, "terminology_flag").count() == 0


def test_command_line(spark, pages, tmp_path, capsys):
    pages.write.parquet(str(tmp_path / "pages"))
    assert cli.main(["list-books", "--root", str(tmp_path / "log")], spark) == 1
    assert cli.main(["process", str(tmp_path / "pages"), "--root", str(tmp_path / "log")], spark) == 0
    assert capsys.readouterr().out.splitlines() == ["a\textracted\t1\t2", "b\textracted\t0\t1", "c\textracted\t0\t1"]


def test_settings():
    assert settings.load({}) == settings.Settings()
    found = settings.load({"QUIRE_CHUNK_TARGET_CHARS": "40", "QUIRE_OCR_CONFIDENCE_THRESHOLD": "0.5", "QUIRE_CORS_ORIGINS": " a, ,b "})
    assert (found.chunk_target_chars, found.ocr_confidence_threshold, found.origins()) == (40, 0.5, ["a", "b"])
    with pytest.raises(ValueError):
        settings.load({"QUIRE_MAX_TRANSLATION_RETRIES": "two"})


def test_recognition_takes_the_first_engine_that_works(spark):
    def first(image):
        if image != b"good":
            raise RuntimeError("blurred")
        return [{"text": "one", "confidence": 0.9}, {"text": "two", "confidence": 0.1}]

    def second(image):
        if image is None:
            raise RuntimeError("no image")
        return [{"text": "three", "confidence": 1}]

    df = spark.createDataFrame([("b", 0, b"good"), ("b", 1, b"bad"), ("b", 2, None)], "book string, page int, image binary")
    got = sorted((r.page, r.text, r.confidence, r.error) for r in D.recognise(df, [first, second]).fillna("").fillna(0.0).collect())
    assert got == [(0, "one", 0.9, ""), (0, "two", 0.1, ""), (1, "three", 1.0, ""), (2, "", 0.0, "no image")]
    assert {r.error for r in D.recognise(df, []).collect()} == {"no engine"}


def test_endpoint():
    class Reply(BaseHTTPRequestHandler):
        def do_POST(self):
            sent = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            body = json.dumps({"choices": [{"message": {"content": f"{sent['model']}:{sent['messages'][0]['content']}:{self.headers['Authorization']}"}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Reply)
    threading.Thread(target=server.handle_request, daemon=True).start()
    build = agents.model("endpoint", url=f"http://127.0.0.1:{server.server_port}/", name_of_model="m", token="t")
    assert build()("hello") == "m:hello:Bearer t"
    server.server_close()


def test_decisions_reach_the_glossary(spark):
    flags = spark.createDataFrame([(f"f{k}", "c", t, "s") for k, t in enumerate("abcd")], "flag_id string, chunk_id string, term string, suggested_translation string")
    made = spark.createDataFrame([("f0", "accepted", None, True, 1), ("f1", "edited", "", True, 1), ("f2", "edited", "e", True, 1), ("f3", "accepted", None, False, 1)], "flag_id string, decision string, final string, apply_to_book boolean, at int")
    chunks = spark.createDataFrame([("c", "book")], "id string, book string")
    got = review.decided_terms(review.decide(flags, made), chunks)
    assert sorted((r.book_id, r.original_term, r.translation) for r in got.collect()) == [("book", "a", "s"), ("book", "b", "s"), ("book", "c", "e")]


def test_html_elements_with_attributes(spark):
    df = spark.createDataFrame([(1, '<p class="x">one <b>two</b></p><pre>no</pre><h1 id=a>Top</h1><li>three</li>')], "page_id long, html string")
    assert [(r.tag, r.text, r.font_size) for r in D.html_blocks(df).orderBy("line_index").collect()] == [("p", "one two", 12.0), ("h1", "Top", 24.0), ("li", "three", 12.0)]
