"""Ordered segmentation of a book's lines into chunks.

Where to cut depends on all lines before, but only through the open chunk's size and one flag. So a book is scanned in
blocks of pages at the same time, from every state that a block can be entered in, and the blocks are then linked. All
else is expressions and grouping by (book, chunk).
"""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.sources.schema import ENUMS

register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

#: Characters that a chunk aims at; it is at least half and at most twice as long where lines allow.
TARGET = 1200
#: Pages of a book that one task scans together.
BLOCK = 128
# Classes that stand for another one as a chunk's content type.
ALIASES = {"chapter_heading": "heading", "section_heading": "heading", "heading_1": "heading", "heading_2": "heading", "verse": "quranic_verse"}


def after(size: int, ended: bool, n: int, starts: bool, marks: bool, low: int, target: int) -> tuple[int, bool]:
    """Line breaks before a line of n characters that follows a chunk of that size, and whether the chunk is cut there."""
    paragraph = size > 0 and (ended or starts)
    sep = 2 if paragraph else 1
    return sep, size > 0 and (size + sep + n > 2 * target or (marks and size > low) or (paragraph and size >= target))


class Exits:
    """Where a block leads from every state that it can be entered in: (size, whether the line before ends a sentence).

    State k is size k // 2 and ended k % 2. A chunk beyond the upper bound is cut by any next line, so sizes stop there.
    States that have met, as they do at a cut that they share, go on as one: they are looked for every eight lines.
    """

    def __init__(self, target: int) -> None:
        self.low, self.target, self.high = target // 2, target, target * 2
        every = np.arange(2 * (self.high + 1))
        self.sizes, self.ended = every // 2, every % 2 == 1
        self.cuts = np.zeros(len(every), np.int64)
        self.met = every.copy()
        self.total = np.zeros(len(every), np.int64)
        self.seen = 0

    def line(self, n: int, ends: bool, starts: bool, marks: bool) -> None:
        if len(self.sizes) == 1:
            size = int(self.sizes[0])
            sep, cut = after(size, bool(self.ended[0]), n, starts, marks, self.low, self.target)
            self.sizes[0] = min(n if cut or size == 0 else size + sep + n, self.high)
            self.cuts[0] += cut
            self.ended = np.array([ends])
            return
        paragraph = (self.sizes > 0) & (self.ended | starts)
        grown = self.sizes + np.where(paragraph, 2, 1) + n
        cut = (self.sizes > 0) & ((grown > self.high) | (marks & (self.sizes > self.low)) | (paragraph & (self.sizes >= self.target)))
        self.sizes = np.minimum(np.where(cut | (self.sizes == 0), n, grown), self.high)
        self.cuts += cut
        if self.seen % 8 == 0:
            self.total += self.cuts[self.met]
            self.sizes, back = np.unique(self.sizes, return_inverse=True)
            self.met, self.cuts = back[self.met], np.zeros(len(self.sizes), np.int64)
        self.seen += 1
        self.ended = np.full(len(self.sizes), ends)

    def row(self) -> dict[str, list[int]]:
        """Runs of entry states with the same size and cuts at the end."""
        size, cuts = self.sizes[self.met], self.total + self.cuts[self.met]
        first = np.flatnonzero(np.r_[True, (np.diff(size) != 0) | (np.diff(cuts) != 0)])
        return {"first": first.tolist(), "size": size[first].tolist(), "cuts": cuts[first].tolist()}


def scan(lines: DataFrame, target: int = TARGET) -> DataFrame:
    """Adds chunk (from 0 in each book) and sep, what stands between a line and the one before it in its chunk.

    A book is dealt as blocks of BLOCK pages. A first pass finds for each block where it leads from every state of the
    scan; those rows, one a block, are followed through a book in order and give the state that each block is entered
    in; a second pass over the same shuffled lines cuts. A line without text counts as empty.
    """
    low = target // 2
    marked = lines.withColumns({
        "key": F.struct(F.col("book").alias("book"), F.floor(F.col("page") / BLOCK).alias("block")),
        "n_chars": F.coalesce(F.length("text"), F.lit(0)),
        "ends": F.coalesce(T.ends_sentence(F.col("text")), F.lit(False)),
        "starts": F.coalesce(T.starts_item(F.col("text")), F.lit(False)),
        "marks": F.coalesce(T.is_section_break(F.col("text")), F.lit(False)) | F.coalesce(F.col("type").startswith("heading_"), F.lit(False)),
    })
    names = marked.columns
    flags = ("n_chars", "ends", "starts", "marks")
    kind = lines.schema["book"].dataType.simpleString()

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, found, ended = None, None, False
        for b in batches:
            out = []
            columns = (b.column(names.index(c)).to_pylist() for c in ("key", *flags))
            for k, n, ends, starts, marks in zip(*columns, strict=True):
                if k != key:
                    if found:
                        out.append({**key, **found.row(), "ended": ended})
                    key, found = k, Exits(target)
                found.line(n, ends, starts, marks)
                ended = ends
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=exit_schema(b))
        if found:
            yield pa.RecordBatch.from_pylist([{**key, **found.row(), "ended": ended}], schema=exit_schema(b))

    def exit_schema(b: pa.RecordBatch) -> pa.Schema:
        many = pa.list_(pa.int64())
        return pa.schema([("book", b.schema.field("book").type), ("block", pa.int64()), ("first", many), ("size", many), ("cuts", many), ("ended", pa.bool_())])

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, fresh, state, chunk = None, True, 0, 0
        for b in batches:
            states, chunks = [], []
            for r in b.to_pylist():
                if fresh or r["book"] != book:
                    book, fresh, state, chunk = r["book"], False, 0, 0
                states.append(state)
                chunks.append(chunk)
                run = bisect_right(r["first"], state) - 1
                state, chunk = 2 * r["size"][run] + r["ended"], chunk + r["cuts"][run]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(states, pa.int32()), pa.array(chunks, pa.int32())], names=["book", "block", "state", "entered"])

    def cut_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, size, chunk, ended = None, 0, 0, False
        for b in batches:
            chunks, seps = [], []
            columns = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("key", *flags, "state", "entered"))
            for k, n, ends, starts, marks, state, entered in zip(*columns, strict=True):
                if k != key:
                    key, size, ended, chunk = k, state // 2, state % 2 == 1, entered
                sep, cut = after(size, ended, n, starts, marks, low, target)
                if cut:
                    chunk, size = chunk + 1, 0
                seps.append("" if size == 0 else "\n" * sep)
                size = n if size == 0 else size + sep + n
                ended = ends
                chunks.append(chunk)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(chunks, pa.int32()), pa.array(seps, pa.string())], names=[*b.schema.names, "chunk", "sep"])

    dealt = marked.repartition("key")
    led = dealt.sortWithinPartitions("key", "page", "line").mapInArrow(exits, f"book {kind}, block bigint, first array<bigint>, size array<bigint>, cuts array<bigint>, ended boolean")
    entries = led.repartition("book").sortWithinPartitions("book", "block").mapInArrow(enter, f"book {kind}, block bigint, state int, entered int")
    joined = dealt.join(entries.select(F.struct("book", "block").alias("key"), "state", "entered").hint("shuffle_hash"), "key")
    ordered = joined.sortWithinPartitions("key", "page", "line")
    out = ordered.mapInArrow(cut_lines, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema) + ", chunk int, sep string")
    return out.select(*lines.columns, "chunk", "sep")


def assemble(scanned: DataFrame) -> DataFrame:
    """(book, index, raw_text, content_type, page_start, page_end, n_lines, format_map): one row for each chunk.

    All is read off a chunk's lines, which meet once; a book without lines has no rows.
    """
    meta = ["meta"] if "meta" in scanned.columns else []
    rows = F.array_sort(F.collect_list(F.struct("page", "line", F.concat("sep", "text").alias("part"), F.coalesce("content_class", F.lit("prose")).alias("class"), *meta)))
    each = scanned.groupBy("book", F.col("chunk").alias("index")).agg(rows.alias("rows"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.count("*").alias("n_lines"))
    pick = lambda name: F.transform("rows", lambda r: r[name])
    extra = [pick("meta").alias("format_map")] if meta else []
    return each.select("book", "index", T.strip(F.array_join(pick("part"), "")).alias("raw_text"), "page_start", "page_end", "n_lines", *extra, content_type(pick("class")).alias("content_type"))


def content_type(classes: Column) -> Column:
    """The class of most of a chunk's lines, which are in order; of several the one seen first."""
    counted = F.transform(F.array_distinct(classes), lambda c: F.struct(F.size(F.filter(classes, lambda x: x == c)).alias("n"), (-F.array_position(classes, c)).alias("first"), c.alias("class")))
    top = F.array_max(counted)["class"]
    known = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    plain = top.isin(ENUMS["content_type"])
    return F.when(plain, top).otherwise(F.coalesce(F.try_element_at(known, top), F.lit("prose")))


def look_up(lines: DataFrame, metadata: DataFrame) -> DataFrame:
    """Lines (book, page, line, ...) with what metadata (book, page, ordinal, type, content_class, meta) says of them.

    ordinal counts a page's text lines from 0; a line without metadata has none: it counts as prose.
    """
    ordinal = (F.row_number().over(Window.partitionBy("book", "page").orderBy("line")) - 1).cast("int")
    return lines.withColumn("ordinal", ordinal).join(metadata.select("book", "page", "ordinal", "type", "content_class", "meta"), ["book", "page", "ordinal"], "left").drop("ordinal")


def literal_chunks(lines: DataFrame, target: int = TARGET) -> DataFrame:
    """The carry-over mode, for small fixtures: a chunk's text holds all text before it, and a cut chunk ends on the
    page of the line that cut it. Its text grows with the square of the book."""
    low, high = target // 2, target * 2
    marked = lines.withColumns({"ends": T.ends_sentence(F.col("text")), "starts": T.starts_item(F.col("text")), "breaks": T.is_section_break(F.col("text")), "heads": F.coalesce(F.col("type").startswith("heading_"), F.lit(False))})
    fields = ("page", "line", "text", "ends", "starts", "breaks", "heads")
    books = marked.groupBy("book").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))
    out = "struct<text:string,ended:boolean,n:int,first:int,last:int,chunks:array<struct<raw_text:string,n_lines:int,page_end:int>>>"
    zero = F.expr(f"cast(named_struct('text', '', 'ended', false, 'n', 0, 'first', null, 'last', 0, 'chunks', array()) as {out})")

    def step(s, x):
        paragraph = (s["text"] != "") & (s["ended"] | x["starts"])
        longer = F.concat(s["text"], F.when(paragraph, "\n\n").otherwise("\n"), x["text"])
        size = F.length(s["text"])
        cut = ((F.length(longer) > high) | ((x["heads"] | x["breaks"]) & (size > low)) | (paragraph & (size >= target))) & (s["text"] != "")
        done = F.struct(s["text"].alias("raw_text"), s["n"].alias("n_lines"), x["page"].cast("int").alias("page_end"))
        chunks = F.when(cut, F.concat(s["chunks"], F.array(done))).otherwise(s["chunks"])
        return F.struct(F.regexp_replace(longer, "^\n+", "").alias("text"), x["ends"].alias("ended"), F.when(cut, 1).otherwise(s["n"] + 1).alias("n"), F.coalesce(s["first"], x["page"].cast("int")).alias("first"), x["page"].cast("int").alias("last"), chunks.alias("chunks")).cast(out)

    state = books.select("book", F.aggregate("rows", zero, step).alias("s"))
    tail = F.struct(F.col("s.text").alias("raw_text"), F.col("s.n").alias("n_lines"), F.col("s.last").alias("page_end"))
    every = F.when(F.col("s.text") != "", F.concat("s.chunks", F.array(tail))).otherwise(F.col("s.chunks"))
    return state.select("book", F.col("s.first").alias("page_start"), F.posexplode(every).alias("index", "c")).select("book", "index", T.strip(F.col("c.raw_text")).alias("raw_text"), "c.n_lines", "page_start", "c.page_end")


def neighbours(chunks: DataFrame, key: str = "book", index: str = "index", text: str = "raw_text") -> DataFrame:
    """The texts one and two places before and after, '' where there is none."""
    w = Window.partitionBy(key).orderBy(index)
    return chunks.withColumns({f"n_{'minus' if k < 0 else 'plus'}_{abs(k)}": F.lag(text, -k, "").over(w) for k in (-2, -1, 1, 2)})


def neighbours_by_index(chunks: DataFrame, key: str = "book", index: str = "index", text: str = "raw_text") -> DataFrame:
    """The texts whose index is one or two less or more, '' where that index is missing."""
    w = Window.partitionBy(key).orderBy(index)
    return chunks.withColumns({f"n_{'minus' if k < 0 else 'plus'}_{abs(k)}": F.coalesce(F.max(text).over(w.rangeBetween(k, k)), F.lit("")) for k in (-2, -1, 1, 2)})
