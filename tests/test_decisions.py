"""Decided flags whose terms hold letters with several capitals: the rows that the SQL gives."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import review
from quire.plans import registry

TEXTS = ["Straße Weg", "ß s", "ﬁn fin", "ŉ n", "ᾳ a", "ΐ i", "ǰ j", "dž d", "plain text", "é", None]


@pytest.fixture
def both(spark, tmp_path):
    """Gives a query's rows and those of its SQL, over conversations of the texts."""
    rows = [(k, turn, "user", text) for k, text in enumerate(TEXTS) for turn in (1, 2, 3, 5, 7)]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(path)

    def run(name):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
        found = con.execute(registry.ORACLES[name])
        columns = [c[0] for c in found.description]
        got = registry.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
        return Counter(map(tuple, got)), Counter(found.fetchall())

    return run


def test_capitals_are_those_of_the_sql(spark):
    """Of every character there is."""
    known = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(known[k : k + 20_000]) for k in range(0, len(known), 20_000)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", T.capitals(F.col("text")).alias("u"))
    con = duckdb.connect()
    assert {r.k: r.u for r in df.collect()} == {k: con.execute("SELECT upper(?)", [t]).fetchone()[0] for k, t in enumerate(texts)}


def test_decide_flags_with_several_capitals(both):
    got, want = both("decide_flags")
    assert got == want
    assert "STRAẞE" in {x for r in got for x in r}


def test_decided_to_glossary_with_several_capitals(both):
    got, want = both("decided_to_glossary")
    assert got == want
    assert "STRAẞE" in {x for r in got for x in r}


def test_decided_to_glossary_with_repeated_and_null_ids(spark, tmp_path):
    """A turn that comes several times has a row for each flag, decision and chunk of its id; one without an id has none."""
    rows = [(k, turn, role, f"{word} of {k}") for k in (1, None) for turn in (0, 2, 3, 5, None) for role, word in (("user", "one"), ("user", "one"), ("user", "two"), ("assistant", "no"))]
    rows += [(2, turn, "user", "alone here") for turn in range(10)]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    found = con.execute(registry.ORACLES["decided_to_glossary"])
    columns = [c[0] for c in found.description]
    want = Counter(found.fetchall())
    got = Counter(map(tuple, registry.QUERIES["decided_to_glossary"](spark, str(tmp_path)).select(*columns).collect()))
    assert got == want
    assert max(got.values()) > 1


def test_decisions_of_the_same_time(spark):
    flags = spark.createDataFrame([("f0", "c", "t", "s"), ("f1", "c", "u", "s"), (None, "c", "v", "s")], "flag_id string, chunk_id string, term string, suggested_translation string")
    made = spark.createDataFrame([("f0", "edited", "a", True, 1), ("f0", "edited", "b", True, 1), ("f0", "edited", "old", True, 0), (None, "edited", "x", True, 1)], "flag_id string, decision string, final string, apply_to_book boolean, at int")
    values = lambda df: sorted((r.term, r.final_value or "") for r in df.collect())
    assert values(review.decide(flags, made, each=True)) == [("t", "a"), ("t", "b"), ("u", ""), ("v", "")]
    assert [t for t, _ in values(review.decide(flags, made))] == ["t", "u", "v"]
