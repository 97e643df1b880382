"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

Each rule is an expression of the text that says whether to reject it. On a sample the cascade measures what a rule
costs and how much it rejects, orders the rules by rejection per cost, and judges each text by the first that rejects
it: a costly rule sees only what the cheap ones let through. The order changes the cost, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
#: Rows on which cost and selectivity are estimated.
SAMPLE = 1000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def _equal_neighbours(sorted_: Column, key: str) -> Column:
    """Of structs sorted by a key, those whose key a neighbour has too."""
    return F.filter(sorted_, lambda x, i: (x[key] == F.get(sorted_, i - 1)[key]) | (x[key] == F.get(sorted_, i + 1)[key]))


def repeated_words(w: Column) -> Column:
    """How many of the words w stand in a window of WINDOW words that the text has twice or more.

    Hashes sort out the windows that can't recur; those left are compared word by word.
    """
    starts = F.size(w) - WINDOW + 1
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    windows = let(hashes, lambda h: F.transform(F.sequence(F.lit(1), starts), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))

    def exact(win: Column) -> Column:
        by_hash = F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        spelt = let(by_hash, lambda s: F.transform(_equal_neighbours(s, "h"), lambda x: F.struct(F.array_join(F.slice(w, x["p"] + 1, WINDOW), " ").alias("t"), x["p"].alias("p"))))
        places = let(F.array_sort(spelt), lambda s: F.array_sort(F.transform(_equal_neighbours(s, "t"), lambda x: x["p"])))
        covered = lambda p: F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(WINDOW), F.get(p, i + 1) - x), F.lit(WINDOW)))
        return let(places, lambda p: F.aggregate(covered(p), F.lit(0), lambda s, x: s + x))

    some = let(windows, lambda win: F.when(F.size(F.array_distinct(win)) < F.size(win), exact(win)).otherwise(0))
    return F.when(starts > 1, some).otherwise(0).cast("long")


def measures(text: Column) -> Column:
    """A struct: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words; a null text counts as empty."""
    of_words = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    of_lines = let(lines(text), lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    n_symbols = symbols(text).alias("n_symbols")
    return F.struct(of_words["n_words"].alias("n_words"), of_words["word_chars"].alias("word_chars"), n_symbols, of_lines["n_lines"].alias("n_lines"), of_lines["n_dup_lines"].alias("n_dup_lines"), of_words["n_repeat_words"].alias("n_repeat_words"))


def symbols(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Rule:
    """A name, and from a column of texts the column that is true where the rule rejects."""

    name: str
    rejects: Callable[[Column], Column]


def _n_words(t: Column) -> Column:
    return F.size(words(t))


BASE = (
    Rule("few_words", lambda t: _n_words(t) < 20),
    Rule("repeated_words", lambda t: let(words(t), lambda w: 100 * repeated_words(w) > 30 * F.size(w))),
)
FURTHER = (
    Rule("symbols", lambda t: 3 * symbols(t) > _n_words(t)),
    Rule("dup_lines", lambda t: let(lines(t), lambda x: 10 * (F.size(x) - F.size(F.array_distinct(x))) > 4 * F.size(x))),
    Rule("word_length", lambda t: let(words(t), lambda w: (F.length(F.array_join(w, "")) > 25 * F.size(w)) | (F.length(F.array_join(w, "")) < 2 * F.size(w)))),
    Rule("capitals", lambda t: 10 * F.coalesce(F.regexp_count(t, F.lit("\\p{Lu}")), F.lit(0)) > 6 * F.length(F.coalesce(t, F.lit("")))),
)


def order(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text", sample: int = SAMPLE) -> list[tuple[Rule, float, float]]:
    """The rules by rejection per cost, each with its seconds and rejected share on a sample of rows."""
    scratch = Scratch(docs.sparkSession, "rules")
    total = docs.count()
    if not total:
        return [(r, 0.0, 0.0) for r in rules]
    some = scratch.cut(docs.select(docs[text].cast("string").alias("t")).sample(min(1.0, sample / total), seed=7)).coalesce(1)
    found = []
    n = max(1, some.count())
    for r in rules:
        began = time.perf_counter()
        hits = some.agg(F.count_if(F.coalesce(r.rejects(F.col("t")), F.lit(False)))).first()[0]
        found.append((r, time.perf_counter() - began, hits / n))
    return sorted(found, key=lambda x: (-(x[2] / max(x[1], 1e-6)), x[1]))


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = BASE + FURTHER, text: str = "text", sample: int = SAMPLE, into: str = "rejected_by") -> DataFrame:
    """docs with one more column: the first rule, in the order found, that rejects the text, else null.

    A null text counts as empty; rules whose verdict is null don't reject. Which of several rules is named depends on
    the order measured, whether one is named does not. An empty table stays empty; a column that has the new one's
    name is replaced; other columns are kept.
    """
    verdict: Column | None = None
    for r, _, _ in order(docs, rules, text, sample):
        hit = F.coalesce(r.rejects(F.coalesce(docs[text].cast("string"), F.lit(""))), F.lit(False))
        verdict = F.when(hit, r.name) if verdict is None else verdict.when(hit, r.name)
    return docs.withColumn(into, verdict if verdict is not None else F.lit(None).cast("string"))


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by).

    The first two rules decide base_failed; kept is false there or where a further rule rejects. The measures are
    taken of every whole text. A null text counts as empty and fails; a null id is kept; repeated rows are judged
    each; an empty table gives none; other columns are dropped.
    """
    t = F.col("t")
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("t"))
    ranked = order(rows, FURTHER, "t")
    verdict = F.when(F.col("base_failed"), "base")
    for r, _, _ in ranked:
        verdict = verdict.when(F.coalesce(r.rejects(F.coalesce(t, F.lit(""))), F.lit(False)), r.name)
    m = rows.withColumn("m", measures(t)).select("doc_id", "t", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words")
    m = m.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    out = m.withColumn("rejected_by", verdict)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")
