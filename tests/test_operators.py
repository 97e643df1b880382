"""Edge cases of the line, chunk, model and review operators."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import stats
from quire.functions import text as T
from quire.operators import agents, chunking, layout, review
from quire.sources import documents as D
from quire.sources import schema
from quire.streaming.progress import start


def lines(spark, texts, types=None):
    rows = [("b", 0, i, t, (types or {}).get(i, "text"), "prose") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "book string, page int, line int, text string, type string, content_class string")


def chunked(spark, texts, target, types=None):
    return [r.raw_text for r in chunking.assemble(chunking.scan(lines(spark, texts, types), target)).orderBy("index").collect()]


@pytest.mark.parametrize(
    ("texts", "target", "types", "want"),
    [
        ([], 10, None, []),
        (["x" * 50], 10, None, ["x" * 50]),
        (["aaaaa", "h"], 10, {1: "heading_1"}, ["aaaaa\nh"]),  # as long as the minimum: no cut
        (["aaaaaa", "h"], 10, {1: "heading_1"}, ["aaaaaa", "h"]),
        (["aaaaaaaaa.", "b"], 10, None, ["aaaaaaaaa.", "b"]),  # as long as the target: cut
        (["aaaaaa", "---"], 10, None, ["aaaaaa", "---"]),
        (["aaaaaa", "باب"], 10, None, ["aaaaaa", "باب"]),
        (["aaa", "1. b"], 10, None, ["aaa\n\n1. b"]),
    ],
)
def test_cuts(spark, texts, target, types, want):
    assert chunked(spark, texts, target, types) == want


def by_rule(texts, target):
    """The segmentation rules, one line at a time."""
    out, now = [], ""
    for t in texts:
        para = bool(now) and (now.rstrip()[-1:] in tuple(T.SENTENCE_ENDS) or bool(re.match(r"^\(?\d+[).۔]", t)))
        longer = now + ("\n\n" if para else "\n") + t if now else t
        cut = len(now) + (2 if para else 1) + len(t) > 2 * target or (para and len(now) >= target) or (bool(re.match("^(---+|===+)$", t)) and len(now) > target // 2)
        if cut and now:
            out.append(now)
            longer = t
        now = longer
    return out + [now] if now else out


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(["a", "bb.", "1. c", "d" * 9, "---", "e؟", "f" * 30]), max_size=30))
def test_scan_follows_the_rules(spark, texts):
    assert chunked(spark, texts, 10) == by_rule(texts, 10)


def test_blocks_of_pages_are_linked(spark, monkeypatch):
    """Books of many blocks are cut as by one scan: with lines that never let the states meet, and of unlike lengths."""
    monkeypatch.setattr(chunking, "BLOCK", 3)
    parts = ["a", "bb.", "1. c", "d" * 9, "---", "e؟", "f" * 30, "g" * 5]
    books = {"even": ["x" * 4] * 60, "mixed": [parts[(i * i + i // 5) % 8] for i in range(90)], None: [parts[i * 7 % 8] for i in range(50)], "short": ["a"]}
    rows = [(b, i // 2, i % 2, t, "text", "prose") for b, texts in books.items() for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "book string, page int, line int, text string, type string, content_class string")
    got = chunking.assemble(chunking.scan(df.repartition(5), 10)).collect()
    for b, texts in books.items():
        assert [r.raw_text for r in sorted((r for r in got if r.book == b), key=lambda r: r["index"])] == by_rule(texts, 10)


def test_pages_are_numbered_across_runs(spark, monkeypatch):
    monkeypatch.setattr(D, "RUN", 4)
    rows = [(i * 3 - 20, None if i % 3 == 0 else f"s{i % 2}", str(i)) for i in range(40)]
    got = D.book_pages(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)).collect()
    for s in (None, "s0", "s1"):
        assert [(r.page, r.text) for r in sorted((r for r in got if r.book == s), key=lambda r: r.page)] == list(enumerate(t for _, x, t in rows if x == s))


def test_strip_and_classes(spark):
    """Stripping is that of the pattern it stands for, over every character that may count as white space."""
    rows = [(chr(c),) for c in (*range(0x250), 0x1680, 0x180E, *range(0x2000, 0x2070), 0x3000, 0xFEFF)]
    df = spark.createDataFrame(rows, "c string").selectExpr("concat(c, 'x', c, 'y', c, c) t")
    assert df.filter(T.strip(F.col("t")) != F.regexp_replace("t", r"(?U)^\s+|\s+$", "")).count() == 0
    texts = {"see 2 :  ٣.": "quranic_verse", "a: 3": "prose", "HADITH x": "hadith", "قال روى": "hadith", "a\u00a0 \u3000 b": "poetry", "x ﴿ y ﴾": "quranic_verse", "﴾ ﴿": "prose", "10:5": "quranic_verse"}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.content_class(F.col("t"), F.lit(0)).alias("c"))
    assert {r.t: r.c for r in df.collect()} == texts


def test_every_line_is_in_one_chunk(spark):
    scanned = chunking.scan(lines(spark, [f"line {i}." * (i % 7 + 1) for i in range(200)]), 40)
    assert scanned.count() == 200
    indexes = [r.chunk for r in scanned.orderBy("line").collect()]
    assert indexes[0] == 0 and all(b - a in (0, 1) for a, b in zip(indexes, indexes[1:], strict=False))


def test_dominant_class_ties_go_to_the_first(spark):
    rows = [("b", 0, i, "t", "text", c) for i, c in enumerate(["heading", "prose", "prose", "heading"])]
    df = spark.createDataFrame(rows, "book string, page int, line int, text string, type string, content_class string").withColumn("chunk", F.lit(0)).withColumn("sep", F.lit(""))
    assert chunking.assemble(df).first().content_type == "heading"


def test_classes_that_stand_for_others(spark):
    df = spark.createDataFrame([("b", 0, 0, "verse", 0), ("b", 0, 1, None, 1), ("b", 0, 2, "odd", 2)], "book string, page int, line int, content_class string, chunk int").selectExpr("*", "'' sep", "'t' text")
    assert [r.content_type for r in chunking.assemble(df).orderBy("index").collect()] == ["quranic_verse", "prose", "prose"]


def test_span_defaults(spark):
    r = spark.range(1).select(stats.dominant(F.array(F.lit("b"), F.lit("a"), F.lit("a"), F.lit("b"))).alias("d"), stats.mean_or(F.array(F.lit(0.0))).alias("m")).first()
    assert (r.d, r.m) == ("b", 12.0)


def test_page_blocks_and_texts(spark):
    span = "named_struct('text', '{}', 'font', 'f', 'size', 12D, 'flags', 0)"
    line = "named_struct('bbox', array(0D, 0D, 9D, 9D), 'spans', array(" + span + "))"
    raw = spark.sql(f"select 0 page, array(named_struct('type', 0, 'bbox', array(0D, 0D, 1D, 1D), 'lines', array({line.format('one')}, {line.format('  ')}, {line.format('two')}))) blocks union all select 1, array(named_struct('type', 1, 'bbox', array(0D, 0D, 1D, 1D), 'lines', cast(null as array<struct<bbox:array<double>,spans:array<struct<text:string,font:string,size:double,flags:int>>>>)))")
    blocks = D.page_blocks(raw)
    assert sorted((r.page, r.type, r.text) for r in blocks.filter("type = 'text'").collect()) == [(0, "text", "one"), (0, "text", "two")]
    assert {r.page: (r.text, r.needs_ocr) for r in D.page_texts(blocks).collect()} == {0: ("one\ntwo", False), 1: ("", True)}


def test_vision_lines(spark):
    df = spark.createDataFrame([(0, "a\n\nb\r\nc\nd", 600.0, 800.0)], "page int, text string, width double, height double")
    assert [(r.text, r.y0, r.y1) for r in D.vision_lines(df).orderBy("line").collect()] == [("a", 0.0, 14.0), ("b", 200.0, 214.0), ("c", 400.0, 414.0), ("d", 600.0, 614.0)]


def test_pdf_errors_stay_rows(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"good")
    (tmp_path / "b.pdf").write_bytes(b"bad")
    (tmp_path / "c.txt").write_bytes(b"no")

    def parse(content):
        if content == b"bad":
            raise ValueError("broken")
        return [{"text": "p0"}, {"text": "p1"}]

    got = sorted((r.path[-5:], r.page, r.text, r.error) for r in D.pdf_pages(spark, str(tmp_path), parse).collect() if r)
    assert got == [("a.PDF", 0, "p0", None), ("a.PDF", 1, "p1", None), ("b.pdf", None, None, "broken")]


def test_upload_names_and_bands(spark):
    r = spark.range(1).select(D.upload_name(F.lit("x/y.PDF"), F.lit("u")).alias("a"), D.upload_name(F.lit("y.txt"), F.lit("u")).alias("b"), D.extraction_band(F.lit(0.2)).alias("c")).first()
    assert (r.a, r.b, r.c) == ("u_y.PDF", None, "medium")


def test_models(spark):
    agents.register_model("echo", lambda **kw: lambda p: p.upper())
    agents.register_model("bad", lambda **kw: lambda p: 1 / 0)
    df = spark.createDataFrame([("a",), ("b",)], "p string")
    assert sorted(r.x.value for r in agents.ask(df, "p", "x", agents.model(" Echo ")).collect()) == ["A", "B"]
    assert {r.x.error for r in agents.ask(df, "p", "x", agents.model("bad"), at_once=2).collect()} == {"division by zero"}
    assert agents.model("mock") is None and agents.model("nobody") is None


def test_a_failing_model_leaves_its_message(spark):
    agents.register_model("bad", lambda **kw: lambda p: 1 / 0)
    chunks = spark.sql("select 't' raw_text, '' n_minus_1, '' n_plus_1, array(named_struct('term', 'x', 'translation', 'Q')) glossary")
    r = agents.translate(chunks, agents.model("bad")).first()
    assert r.translation == "[Translation error: division by zero]" and len(r.errors) == 2
    assert r.verification.score == 1.0 and r.flags == [] and r.status == "terminology_reviewed"


def test_extensions(spark):
    r = spark.range(1).select(review.in_brackets(F.lit("t"), F.lit("s"), F.lit(True)).alias("b"), review.apply_suggestions(F.lit("aab"), F.expr("array(named_struct('phrase', 'a', 'suggestion', 'c'))")).alias("s"), review.may_translate(F.lit("review")).alias("m"), schema.in_domain(F.lit("odd"), "job_kind").alias("d")).first()
    assert (r.b, r.s, r.m, r.d) == ("t (s)", "ccb", False, False)


def test_cascade_delete_and_export(spark, tmp_path):
    kids = spark.createDataFrame([("a", 1), ("b", 2)], "book_id string, n int")
    left = review.cascade_delete(kids, spark.createDataFrame([("a",)], "id string"), "book_id")
    for kind in ("json", "csv", "parquet"):
        review.export(left, str(tmp_path / kind), kind)
        assert spark.read.format(kind).options(header=True, inferSchema=True).load(str(tmp_path / kind)).first()["n"] == 2
    with pytest.raises(ValueError):
        review.export(left, str(tmp_path / "x"), "pdf")


def test_stream_gives_the_batch_rows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = start(spark, str(tmp_path / "in"), events._jdf.schema().toDDL(), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() > 0 and out.agg(F.sum("n")).first()[0] <= events.count()


def test_tables_have_schemas(spark):
    for ddl in schema.TABLES.values():
        assert spark.createDataFrame([], ddl).columns


def test_layout_of_plain_lines(spark):
    df = spark.createDataFrame([(0, 0, "HELLO")], "page int, line int, text string")
    assert layout.metadata(layout.classify(layout.with_defaults(df, "en"))).first().meta.line_id == "page0_line0"
