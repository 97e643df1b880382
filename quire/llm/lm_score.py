"""Cross-entropy difference: a target and a background n-gram model score each document, token by token.

Both models are bigrams backed by unigrams over one vocabulary: all the words of the whole corpus, with the counts of
every word and word pair, however many there are. They are matched: same vocabulary, same smoothing, and both are
sums over every document, the target's over the chosen ones. A document is scored by what the others have: its own
counts are taken out of both models first. Its score is the mean over its tokens of
background loss minus target loss (higher: more like the target).

Documents travel in chunks. A chunk sends each of its distinct n-grams, with its own counts, to the n-gram's bucket;
there the counts of all chunks are added up and sent back to the chunks that asked. So the tables are spread over the
buckets, and a very common n-gram is one number from each chunk. N-grams are known by hashes of 63 bits, which a chunk
sends in order, as the gaps between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import bytes_of, mix, slices, word_hashes
from ._shared import Scratch, buckets, release, tidy

#: Bytes of text in a chunk (a longer document stands alone).
CHUNK = 1 << 21
_SEED = np.uint64(0x51ED270B9F651A2D)
#: The lowest bit of a key tells pairs from words.
_PAIR = np.uint64(1)
#: Parts of a bucket's range of keys that are added up one by one.
_RANGES = 16


def _grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each token's row; whether a token of its row is before it; the distinct keys; the places of words and pairs among them."""
    h, row = word_hashes(data, at)
    h = h & ~_PAIR
    inner = np.zeros(len(h), bool)
    inner[1:] = row[1:] == row[:-1]
    past = np.zeros(len(h), np.uint64)
    past[1:] = h[:-1]
    past[~inner] = _PAIR  # no word has this key
    pair = mix(h ^ (past * _SEED + np.uint64(1))) | _PAIR
    key, place = np.unique(np.concatenate([h, pair]), return_inverse=True)
    return row, inner, key, *place.reshape(2, -1)


def _cuts(key: np.ndarray, low: int, high: int, n: int) -> np.ndarray:
    """Where the n equal parts of the range [low, high) of upper halves begin and end in keys that are in order."""
    bounds = [low + -(-(high - low) * k // n) for k in range(n + 1)]
    return np.searchsorted((key >> np.uint64(32)).astype(np.int64), bounds)


def _gaps(key: np.ndarray) -> bytes:
    """The first key, and the gaps to the next ones in as many bytes as the widest needs, byte by byte."""
    if len(key) < 2:
        return _zipped(key.tobytes())
    gap = np.diff(key)
    wide = max(1, -(-int(gap.max()).bit_length() // 8))
    return _zipped(key[:1].tobytes() + np.ascontiguousarray(gap.view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes())


def _keys(blob: pa.Scalar, k: int) -> np.ndarray:
    raw = _unzipped(blob)
    key = np.zeros(k, np.uint64)
    if k > 1:
        wide = (len(raw) - 8) // (k - 1)
        key[1:].view(np.uint8).reshape(-1, 8)[:, :wide] = np.frombuffer(raw, np.uint8, (k - 1) * wide, 8).reshape(wide, -1).T
    key[0] = np.frombuffer(raw, np.uint64, 1)[0]
    return np.cumsum(key, dtype=np.uint64)


def _own(row: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    """For each token how often its n-gram stands in its own row."""
    _, which, count = np.unique(row * size + place, return_inverse=True, return_counts=True)
    return count[which]


def _zipped(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unzipped(blob: pa.Scalar) -> memoryview:
    raw = memoryview(blob.as_buffer())
    size = int.from_bytes(raw[:4], "little")
    return memoryview(pa.decompress(raw[4:], decompressed_size=size, codec="zstd", asbytes=True)) if size else raw[:0]


def _short(counts: np.ndarray) -> bytes:
    """A byte for each count; those of 255 and more follow, with their places."""
    far = np.flatnonzero(counts >= 255)
    return _zipped(np.minimum(counts, 255).astype(np.uint8).tobytes() + far.astype(np.uint32).tobytes() + counts[far].astype(np.int64).tobytes())


def _long(blob: pa.Scalar, k: int) -> np.ndarray:
    raw = _unzipped(blob)
    far = (len(raw) - k) // 12
    counts = np.frombuffer(raw, np.uint8, k).astype(np.int64)
    counts[np.frombuffer(raw, np.uint32, far, k)] = np.frombuffer(raw, np.int64, far, k + 4 * far)
    return counts


def score(docs: DataFrame, target: DataFrame, weight: float = 0.7, doc_id: str = "doc_id", text: str = "text", target_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) for every row of docs; target: ids of the target documents.

    A token's probability is weight * count(past, word) / count(past) + (1 - weight) * (count(word) + 0.5) / (tokens +
    0.5 * words), weight under 1; where a model has never met the past, the second part alone. The past of a row's
    first word is the row's begin. All counts are those of the other rows; `words`, the size of the vocabulary, is the
    whole corpus's. Losses are nats per
    token, score their difference. A text that is null or has no word has 0 tokens and null
    losses and score. A null id is in no target. Repeated rows count, and are returned, as often as they stand
    there, each being another row to the others; an empty target makes the target model uniform; an empty table gives
    no rows; other columns are dropped, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    n = buckets(spark)
    base = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    ids = target.select(target[target_id].cast("long").alias("id")).filter("id is not null").distinct()
    size = ids.count()
    # the list of target ids is broadcast up to a checked length and joined by shuffle beyond it
    marks = ids.withColumn("aim", F.lit(True))
    marked = base.join(F.broadcast(marks) if size <= 2_000_000 else marks, F.col("doc_id") == F.col("id"), "left").select("doc_id", "text", F.coalesce("aim", F.lit(False)).alias("aim"))

    def bind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = pa.Codec("zstd", compression_level=9)
        chunk = TaskContext.get().partitionId() << 32
        for b in batches:
            aim = np.asarray(b.column(2).to_numpy(zero_copy_only=False), bool)
            data, at = bytes_of(b.column(1))
            for i, j in slices(at, CHUNK):
                rows = [pa.array([chunk], pa.int64()), pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), b.column(0)[i:j])]
                packed = zstd.compress(data[at[i] : at[j]].tobytes(), asbytes=True)
                blobs = [pa.array([x], pa.binary()) for x in ((at[i : j + 1] - at[i]).tobytes(), aim[i:j].tobytes(), packed)]
                yield pa.RecordBatch.from_arrays(rows + blobs, names=["chunk", "doc_id", "at", "aim", "text"])
                chunk += 1

    def opened(at: pa.Scalar, aim: pa.Scalar, packed: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.frombuffer(at.as_buffer(), np.int64)
        size = int(at[-1])
        data = pa.decompress(packed.as_buffer(), decompressed_size=size, codec="zstd") if size else b""
        return np.frombuffer(data, np.uint8), at, np.frombuffer(aim.as_buffer(), bool)

    # written once: a chunk must be the same when it asks and when it is scored
    chunks = scratch.cut(marked.mapInArrow(tidy(bind), "chunk long, doc_id array<long>, at binary, aim binary, text binary"))
    names = ("every", "chosen", "every_past", "chosen_past")  # the last two for words only: how often a word follows them

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, *parts in zip(*(b.column(x) for x in ("chunk", "at", "aim", "text")), strict=True):
                data, at, aim = opened(*parts)
                row, inner, key, word, pair = _grams(data, at)
                mine, is_word, follows = aim[row], (key & _PAIR) == 0, np.flatnonzero(inner)
                sums = [np.bincount(np.concatenate([word[m], pair[m]]), minlength=len(key)) for m in (slice(None), mine)]
                sums += [np.bincount(word[f - 1], minlength=len(key)) for f in (follows, follows[mine[follows]])]
                cuts = _cuts(key, 0, 1 << 32, n)
                keep = [k for k in range(n) if cuts[k] < cuts[k + 1]]
                out = {"bucket": pa.array(keep, pa.int32()), "chunk": pa.array([chunk.as_py()] * len(keep), pa.int64()), "n": pa.array([cuts[k + 1] - cuts[k] for k in keep], pa.int32())}
                out["key"] = pa.array([_gaps(key[cuts[k] : cuts[k + 1]]) for k in keep], pa.binary())
                for x, name in zip(sums, names, strict=True):
                    ranges = [slice(cuts[k], cuts[k + 1]) for k in keep]
                    out[name] = pa.array([_short(x[r][is_word[r]] if name.endswith("past") else x[r]) for r in ranges], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    def answer(bucket: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = bucket[0].as_py()
        asked, keys, counts = [], [], [[] for _ in names]
        for b in batches:
            asked += b.column("chunk").to_pylist()
            new = [_keys(x, k) for x, k in zip(b.column("key"), b.column("n").to_pylist(), strict=True)]
            keys += new
            for held, name in zip(counts, names, strict=True):
                for x, key in zip(b.column(name), new, strict=True):
                    is_word = (key & _PAIR) == 0
                    held.append(_long(x, int(is_word.sum()) if name.endswith("past") else len(key)).astype(np.uint32))
        low, high = (-(-(k << 32) // n) for k in (number, number + 1))
        cuts = np.array([_cuts(x, low, high, _RANGES) for x in keys]).T
        parts: list[list[list[np.ndarray]]] = [[[] for _ in keys] for _ in names]
        totals = [0, 0, 0]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            key = np.concatenate([x[i:j] for x, i, j in zip(keys, a, z, strict=True)])
            if not len(key):
                continue
            order = np.argsort(key)
            sorted_ = key[order]
            heads = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
            group = np.empty(len(order), np.int64)
            group[order] = np.cumsum(heads) - 1
            distinct = sorted_[heads]
            words = (distinct & _PAIR) == 0
            totals[2] += int(words.sum())
            is_word = (key & _PAIR) == 0
            for k, (held, name) in enumerate(zip(counts, names, strict=True)):
                past = name.endswith("past")
                mine = group[is_word] if past else group
                if past:  # places among the words alone
                    where = [((x[:i] & _PAIR) == 0).sum() for x, i in zip(keys, a, strict=True)]
                    size = [((x[i:j] & _PAIR) == 0).sum() for x, i, j in zip(keys, a, z, strict=True)]
                else:
                    where, size = a, z - a
                sent = np.concatenate([x[i : i + m] for x, i, m in zip(held, where, size, strict=True)])
                sums = np.bincount(mine, sent, minlength=len(distinct)).astype(np.int64)  # exact up to 2**53
                if k < 2:
                    totals[k] += int(sums[words].sum())
                back = sums[mine]
                kind = np.uint32 if len(back) == 0 or back.max() < 2**32 else np.int64
                for whole, x in zip(parts[k], np.split(back.astype(kind), np.cumsum(size)[:-1]), strict=True):
                    whole.append(x)
        out = {"chunk": pa.array([None, *asked], pa.int64()), "bucket": pa.array([number] * (1 + len(asked)), pa.int32())}
        for name, whole in zip(names, parts, strict=True):
            out[name] = pa.array([None, *(_short(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in whole)], pa.binary())
        out["totals"] = pa.array([totals] + [None] * len(asked), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_pydict(out)
        del asked, keys, counts, parts, out
        release()

    fields = ", ".join(f"{x} binary" for x in names)
    asking = chunks.select("chunk", "at", "aim", "text").mapInArrow(tidy(ask), f"bucket int, chunk long, n int, key binary, {fields}")
    told = scratch.cut(asking.groupBy("bucket").applyInArrow(answer, f"chunk long, bucket int, {fields}, totals array<long>"))
    sums = told.filter("chunk is null").agg(*(F.coalesce(F.sum(F.col("totals")[k]), F.lit(0)) for k in range(3))).first()
    tokens, vocabulary = (sums[1], sums[0]), sums[2]
    # how many rows of either model begin with a word
    worded = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    starts = marked.agg(F.count_if(F.coalesce(worded & F.col("aim"), F.lit(False))), F.count_if(F.coalesce(worded, F.lit(False)))).first()
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()), ("score", pa.float64())])

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("doc_id").combine_chunks().flatten()
        data, at, aim = opened(*(left.column(x)[0] for x in ("at", "aim", "text")))
        row, inner, key, word, pair = _grams(data, at)
        if not len(row):
            blank = pa.nulls(len(ids), pa.float64())
            return pa.Table.from_arrays([ids, pa.array(np.zeros(len(ids), np.int64)), blank, blank, blank], schema=out)
        cuts, is_word = _cuts(key, 0, 1 << 32, n), (key & _PAIR) == 0
        counts = {x: np.zeros(len(key), np.int64) for x in names}
        for bucket, *blobs in zip(right.column("bucket").to_pylist(), *(right.column(x) for x in names), strict=True):
            for name, x in zip(names, blobs, strict=True):
                here = np.arange(cuts[bucket], cuts[bucket + 1])
                here = here[is_word[here]] if name.endswith("past") else here
                counts[name][here] = _long(x, len(here))
        tally = np.bincount(row, minlength=len(ids))
        before = np.concatenate([[0], word[:-1]])
        follows = np.concatenate([inner[1:], [False]])  # the tokens that another of their row follows
        _, which, times = np.unique(row * len(key) + word, return_inverse=True, return_counts=True)
        own_word, own_pair = times[which], _own(row, pair, len(key))
        own_past = np.bincount(which, follows, minlength=len(times)).astype(np.int64)[which]
        own_past = np.where(inner, np.concatenate([[0], own_past[:-1]]), 1)
        loss = []
        for name, total, begin in (("chosen", tokens[0], starts[0]), ("every", tokens[1], starts[1])):
            less = aim[row].astype(np.int64) if name == "chosen" else np.ones(len(row), np.int64)
            past = np.where(inner, counts[f"{name}_past"][before], begin) - less * own_past
            met = counts[name][pair] - less * own_pair
            alone = (counts[name][word] - less * own_word + 0.5) / (total - less * tally[row] + 0.5 * vocabulary)
            chance = np.where(past > 0, weight * met / np.maximum(past, 1) + (1 - weight) * alone, alone)
            loss.append(np.bincount(row, -np.log(chance), minlength=len(ids)) / np.maximum(tally, 1))
        none = tally == 0
        a, z = loss
        done = pa.Table.from_arrays([ids, pa.array(tally, pa.int64()), pa.array(a, mask=none), pa.array(z, mask=none), pa.array(z - a, mask=none)], schema=out)
        del data, row, key, word, pair, counts
        release()
        return done

    replies = told.filter("chunk is not null").drop("totals")
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(judge, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
