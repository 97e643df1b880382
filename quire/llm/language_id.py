"""Language identification by mixture inference.

Every language is a table of character n-gram log-likelihoods. A text is cut into runs of n-grams; the share of each
language in it is found by expectation-maximisation over the runs' likelihoods, and the set of languages by the
penalised likelihood: as long as leaving one out costs less than the penalty for keeping it, it is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import bytes_of
from ._shared import ship, tidy

#: Slots of the hashed n-gram tables, and the lengths of n-grams that share them. With so many languages that the
#: tables had more than ROOM entries together, slots are halved until they fit: no language is left out.
SLOTS, ROOM = 1 << 17, 1 << 26
ORDERS = (2, 3, 4)
#: n-grams in a run.
RUN = 32
#: Bytes of texts whose mixtures are found together.
TEXTS = 1 << 20
#: n-grams that are looked up at once.
BLOCK = RUN * 32768
#: The model is fitted on about this many whole labelled texts of each language (those with the least hash of their
#: id); every text is predicted.
SAMPLE = 1500
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # [slot, language] log-likelihoods


def has_letter(text: str) -> bool:
    """Whether a character has one of the letter categories; fractions and the like are word characters, but none."""
    return any(m.group().isalpha() for m in _WORD.finditer(text))


def slots_for(languages: int) -> int:
    slots = SLOTS
    while slots * languages > ROOM and slots > 1:
        slots //= 2
    return slots


def _slots(data: np.ndarray, size: int = SLOTS) -> np.ndarray:
    """The slots of all n-grams, one row per order; each is at the place of its last byte."""
    x = _FOLD[data]
    out = np.zeros((len(ORDERS), len(x)), np.int64)
    for k, order in enumerate(ORDERS):
        h = np.full(len(x), order, np.uint32)
        for j in range(order):
            past = np.full(len(x), 32, np.uint32)
            past[j:] = x[: len(x) - j] if j else x
            h = (h * np.uint32(0x01000193)) ^ past
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        out[k] = h & np.uint32(size - 1)
    return out


def _blocks(one: np.ndarray, size: int = SLOTS) -> Iterator[np.ndarray]:
    """The slots of a whole text, a block of places at a time."""
    for a in range(0, len(one), BLOCK):
        back = max(0, a - max(ORDERS) + 1)
        yield _slots(one[back : a + BLOCK], size)[:, a - back :]


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Learns from rows with a text and a language, a bounded number of each language.

    Every language that a row names is learned; rows with a null text or language are left out. Repeated rows and ids
    are rows of their own; without any row the model has no language.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(docs[doc_id].cast("string").alias("id"), docs[text].cast("string").alias("text"), docs[lang].cast("string").alias("lang")).filter("text is not null and lang is not null")
    each = rows.groupBy("lang").count().collect()
    if not each:
        return Model([], np.zeros((SLOTS, 0), np.float32))
    size = slots_for(len(each))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            data, at = bytes_of(b.column(0))
            for i, name in enumerate(b.column(1).to_pylist()):
                sums.setdefault(name, np.zeros(size, np.int64))
                for slots in _blocks(data[at[i] : at[i + 1]], size):
                    sums[name] += np.bincount(slots.ravel(), minlength=size)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["lang", "counts"])

    # a sample by the hash of the id: such a share of the hash range for each language as gives `sample` rows
    least = F.create_map(*[x for r in each for x in (F.lit(r["lang"]), F.lit(min(1 << 20, (1 << 20) * sample // r["count"] + 1)))])
    taken = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.coalesce(F.try_element_at(least, F.col("lang")), F.lit(0)))

    def total(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.zeros(size, np.int64)
        for b in batches:  # one table at a time is held, however many tasks sent one
            for x in b.column("counts"):
                t += np.frombuffer(x.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([t.tobytes()], pa.binary())], names=["lang", "counts"])

    found = taken.select("text", "lang").mapInArrow(tidy(count), "lang string, counts binary").groupBy("lang").applyInArrow(total, "lang string, counts binary").collect()
    names = sorted(r["lang"] for r in found)
    table, sent = np.empty((size, len(names)), np.float32), {r["lang"]: r["counts"] for r in found}
    for k, x in enumerate(names):
        counts = np.frombuffer(sent.pop(x), np.int64)
        table[:, k] = np.log((counts + 0.5) / (counts.sum() + 0.5 * size))
    return Model(names, table)


def mixtures(like: np.ndarray, heads: np.ndarray, penalty: float = 1.0, steps: int = 12) -> np.ndarray:
    """Shares of each language in each text. like: log-likelihoods of the runs; heads: where each text's runs begin.

    Starts from all languages; then each round leaves out each text's weakest one where the log-likelihood lost is
    under penalty * log(runs + 1).
    """
    n, langs = len(heads), like.shape[1]
    size = np.diff([*heads, len(like)])
    owner = np.repeat(np.arange(n), size)
    top = like.max(axis=1, keepdims=True)
    lift = np.exp(np.maximum(like - top, -60.0)).astype(np.float64)

    def settle(share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(steps):
            part = share[owner] * lift
            part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
            new = np.add.reduceat(part, heads) / size[:, None]
            moved = np.abs(new - share).max() if n else 0.0
            share = new
            if moved < 1e-3:
                break
        fit = np.add.reduceat(np.log(np.maximum((share[owner] * lift).sum(axis=1), 1e-300)), heads)
        return share, fit

    share, fit = settle(np.full((n, langs), 1.0 / langs))
    cost = penalty * np.log(size + 1.0)
    open_ = np.ones(n, bool)
    for _ in range(langs - 1):
        active = share > 0
        open_ &= active.sum(axis=1) > 1
        if not open_.any():
            break
        weakest = np.where(active, share, 2.0).argmin(axis=1)
        less = share.copy()
        less[np.arange(n), weakest] = np.where(open_, 0.0, less[np.arange(n), weakest])
        less /= np.maximum(less.sum(axis=1, keepdims=True), 1e-300)
        less, low = settle(less)
        better = open_ & (fit - low <= cost)
        share[better], fit[better] = less[better], low[better]
        open_ &= better
    return share


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: the columns `keep`, then lang_pred, score and shares (a map of the languages found to their shares).

    lang_pred is the language with the largest share (ties: the first by name), score its share between 0 and 1.
    A null text, or one without a letter, is `und` with score 0; so is every text if the model has no language.
    Every whole text is read, in blocks if it is long; repeated rows give repeated rows, an empty table none. A kept
    column with the name of a new one stays beside it, so whoever keeps such a column must rename it first.
    """
    spark = docs.sparkSession
    ship(spark)
    keep = [doc_id] if keep is None else keep
    shared = spark.sparkContext.broadcast(model)  # ROOM entries at most
    kinds = dict(docs.dtypes)
    where = keep.index(text) if text in keep and kinds[text] == "string" else len(keep)  # a kept text travels once
    source = docs.select(*[docs[c].alias(f"c{k}") for k, c in enumerate(keep)], *([] if where < len(keep) else [docs[text].cast("string").alias("t")]))

    def runs(one: np.ndarray, table: np.ndarray) -> np.ndarray:
        out = []
        for slots in _blocks(one, len(table)):
            logs = table[slots[0]]
            for s in slots[1:]:
                logs += table[s]
            out.append(np.add.reduceat(logs, np.arange(0, len(logs), RUN), dtype=np.float64) / len(ORDERS))
        return np.concatenate(out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(where)
            data, at = bytes_of(texts)
            n = b.num_rows
            best, score, shares = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
            real = [i for i in range(n) if m.languages and at[i + 1] > at[i] and has_letter(texts[i].as_py())]
            some: list[int] = []
            size = 0
            for k, i in enumerate(real):
                some.append(i)
                size += at[i + 1] - at[i]
                if size < TEXTS and k + 1 < len(real):
                    continue
                blocks = [runs(data[at[j] : at[j + 1]], m.table) for j in some]
                heads = np.concatenate([[0], np.cumsum([len(x) for x in blocks])[:-1]]).astype(np.int64)
                share = mixtures(np.concatenate(blocks), heads)
                top = share.argmax(axis=1)
                for r, j in enumerate(some):
                    best[j], score[j] = m.languages[top[r]], min(1.0, float(share[r, top[r]]))
                    shares[j] = [(m.languages[x], float(share[r, x])) for x in np.flatnonzero(share[r] > 0)]
                some, size = [], 0
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(best, pa.string()), pa.array(score), pa.array(shares, pa.map_(pa.string(), pa.float64()))], names=[*(f"c{k}" for k in range(len(keep))), "lang_pred", "score", "shares"])

    fields = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(source.schema.fields[: len(keep)]))
    out = source.mapInArrow(tidy(work), f"{fields}, lang_pred string, score double, shares map<string,double>")
    return out.toDF(*keep, "lang_pred", "score", "shares")
