"""A training corpus from raw documents: rules, language, near copies, repeated passages, packing.

A stage takes documents (doc_id, text, lang, source, n_chars, and whatever other columns, of any name) and all but the
last give the same columns. Rows with a null id pass the stages that compare documents as they are. An empty table
gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import language_id, ngram_join, packing, quality, suffix_dedup
from quire.llm._shared import Scratch

#: Least share of its main language that a document needs.
LEAST_SHARE = 0.4
#: Ids to leave out are broadcast up to this many, and joined by shuffle beyond.
BROADCAST_IDS = 2_000_000


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns named c0, c1, ..., which clash with no name that an operator adds, and the new name of each."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the cascade rejects.

    A null text counts as empty and is rejected, as is one under 20 words; long texts are judged whole; repeated rows are
    judged each.
    """
    rows, names = _plain(docs)
    kept = quality.cascade(rows, text=names["text"], into="rejected_by").filter("rejected_by is null")
    return kept.select(*names.values()).toDF(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language; the model is learned from the documents' own language labels.

    A text that is null or has no letter is rejected; so is one that no language has LEAST_SHARE of. Long texts are
    read whole; of languages with equal shares the first by name counts; repeated rows are judged each. Where no row
    has a label nothing can be learned, and every document stays.
    """
    rows, names = _plain(docs)
    model = language_id.fit(rows, names["doc_id"], names["text"], names["lang"])
    if not model.languages:
        return docs
    found = language_id.predict(rows, model, names["doc_id"], names["text"], keep=list(names.values()))
    kept = found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return kept.select(*names.values()).toDF(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of similar ones.

    Null or empty texts are similar to none and stay, as do rows with a null id; rows that repeat an id stay or go
    together.
    """
    groups = ngram_join.similar_groups(docs)
    others = Scratch(spark, "copies").cut(groups.filter("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(F.broadcast(others) if others.count() <= BROADCAST_IDS else others, "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what an earlier document has already; documents of which nothing is left go.

    What is left of a character that a cut splits becomes U+FFFD, and n_chars is counted anew. A null text becomes an
    empty one; rows with a null id, or with an id that stands for several texts, stay as they are.
    """
    rows, names = _plain(docs)
    rest = [x for c, x in names.items() if c not in ("doc_id", "text", "n_chars")]
    done = suffix_dedup.remove_repeats(rows, doc_id=names["doc_id"], text=names["text"], keep=rest)
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    done = done.filter("n_removed = 0 or n_removed < n_bytes")
    columns = {x: F.col(f"keep_{x}") for x in rest} | {names["doc_id"]: F.col("doc_id"), names["text"]: text}
    if "n_chars" in names:
        columns[names["n_chars"]] = F.length(text).cast("long")
    return done.select(*[columns[x].alias(c) for c, x in names.items()])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token pieces: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A null or empty text is one piece, the closing id alone; long ones are cut into pieces; rows that repeat an id are
    packed each; other columns are dropped.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("language ID", language), ("n-gram Jaccard join", near_copies), ("suffix-array dedup", repeated_passages), ("best-fit packing", packed)]

#: Language models and bin completion can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each writes its rows to the shared folder and the next one reads them."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        done = scratch.cut(stage(spark, docs, sf_dir))
        if docs is not done and hasattr(docs, "_quire_path"):
            scratch.drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
