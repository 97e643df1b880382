"""Exact removal of repeated byte strings, by column-wise construction over many strings at once.

Column-wise construction inserts one symbol per string each round, from the last column to the first, and updates
the order of the collection, its Burrows-Wheeler transform and the common prefixes of neighbours, one column after
the other. Its rounds are as many as the longest string has symbols, and each passes over
all that was inserted before, so whole documents can't be its strings. They are cut down first, without loss:

1. Among the grams in any window of `span` bytes the one with the least hash is its anchor. Equal windows have equal
   anchors at equal places, so a window can repeat only if its anchor's hash occurs twice.
2. Around each such anchor stands a context that holds all windows which may have it as their anchor. Contexts with
   the same anchor meet in one bucket and are the collection: all of one length, so the rounds are as few. Equal
   contexts travel as one string with a list of their places: only the earliest counts, the others are repeats whole.
3. After each round the windows that start in its column stand in suffix order, and neighbours with a common prefix of
   `span` bytes are equal. All but the earliest of them (smaller id, then earlier start) are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import bytes_of, mix, prefix_hash, span_hash
from ._shared import Scratch, buckets, release, tidy, to_group

GRAM = 32
_POSITION = np.uint64((1 << 24) - 1)
_CHUNK = 1 << 20
#: Anchors, and bytes of contexts, that a task holds before it sends them.
_ANCHORS, _CONTEXTS = 500_000, 24_000_000
#: A list of ids is broadcast up to this length; longer ones are joined by shuffle.
BROADCAST_IDS = 2_000_000


def anchors(data: np.ndarray, span: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all windows of one text; of equal grams in a window the first counts."""
    grams = span - gram + 1
    found, hashes = [], []
    for a in range(0, max(1, len(data) - span + 1), _CHUNK):
        part = data[a : a + _CHUNK + span - 1]
        if len(part) < span:
            break
        at = np.arange(len(part) - gram + 1)
        h = mix(span_hash(prefix_hash(part), at, at + gram))
        key = (h & ~_POSITION) | at.astype(np.uint64)
        # sliding minimum: blocks of `grams`, prefix minima of one against suffix minima of the block before
        full = -(-len(key) // grams) * grams
        pad = np.full(full, np.iinfo(np.uint64).max, np.uint64)
        pad[: len(key)] = key
        blocks = pad.reshape(-1, grams)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        low = np.minimum(behind[: len(key) - grams + 1], ahead[grams - 1 : len(key)])
        new = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        place = (low[new] & _POSITION).astype(np.int64)
        found.append(place + a)
        hashes.append(h[place])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, h = np.concatenate(found), np.concatenate(hashes)
    place, first = np.unique(place, return_index=True)
    return place, h[first]


def equal_windows(rows: np.ndarray, span: int, valid: np.ndarray) -> np.ndarray:
    """Column-wise construction over equally long strings (rows, in order of age).

    Returns for each row and each column of `valid` whether the window of `span` bytes that begins there also begins
    there in an earlier row (only valid windows count).
    """
    (m, width), starts = rows.shape, valid.shape[1]
    small = np.uint8 if width < 250 else np.uint32
    again = np.zeros((m, starts), bool)
    if m < 2:
        return again
    columns = np.ascontiguousarray(rows.T)
    order, common = np.arange(m), np.zeros(m, small)
    for column in range(width - 1, -1, -1):
        transform = columns[column][order]  # the symbols before the suffixes, in suffix order: the collection's transform
        step = np.argsort(transform, kind="stable")
        ordered = transform[step]
        least = np.zeros(m - 1, small) if column == width - 1 else _range_min(common, step)
        common = np.zeros(m, small)
        common[1:] = np.where(ordered[1:] == ordered[:-1], least + small(1), 0)
        order = order[step]
        if column < starts:
            heads = np.flatnonzero(common < span)
            fit = valid[order, column]
            oldest = np.minimum.reduceat(np.where(fit, order, m), heads)
            again[order, column] = fit & (order != oldest[np.cumsum(common < span) - 1])
    return again


def same_rows(rows: np.ndarray) -> np.ndarray:
    """For each row the number of the first row with the same bytes (its own, if there is none before)."""
    key = np.zeros(len(rows), np.uint64)
    for c in range(rows.shape[1]):
        key = key * np.uint64(0x9E3779B97F4A7C15) + rows[:, c].astype(np.uint64) + np.uint64(1)
    _, first, group = np.unique(key, return_index=True, return_inverse=True)
    like = first[group]
    odd = np.flatnonzero((rows != rows[like]).any(axis=1))  # another string with the same hash stands for itself
    like[odd] = odd
    return like


def _range_min(common: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Least common prefix between neighbours of the new order that stood in the same order before."""
    a, b = step[:-1], step[1:]
    out = np.zeros(len(a), common.dtype)
    ahead = b > a
    near = b == a + 1
    out[near] = common[b[near]]
    far = np.flatnonzero(ahead & ~near)
    if len(far):
        left, size = a[far] + 1, b[far] - a[far]
        level = np.frexp(size)[1] - 1
        table, k, res = common, 0, np.zeros(len(far), common.dtype)
        top = int(level.max())
        while True:
            mine = np.flatnonzero(level == k)
            if len(mine):
                lo, hi = left[mine], left[mine] + size[mine] - (1 << k)
                res[mine] = np.minimum(table[lo], table[hi])
            if k == top:
                break
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
            k += 1
        out[far] = res
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of true values in a matrix."""
    edge = np.zeros((flags.shape[0], flags.shape[1] + 2), np.int8)
    edge[:, 1:-1] = flags
    step = np.diff(edge, axis=1)
    row, first = np.nonzero(step == 1)
    return row, first, np.nonzero(step == -1)[1] - 1


def _merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of covered places."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    heads = np.flatnonzero(new)
    return start[heads], reach[np.concatenate([heads[1:] - 1, [len(start) - 1]])]


def repeated_spans(docs: DataFrame, scratch: Scratch, span: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, whole, spans): what of each document to remove; spans holds pairs of 32-bit starts and ends, whole marks
    documents whose text an earlier one has, all of it. Documents without repeats are left out."""
    spark = docs.sparkSession
    gram, n = min(GRAM, span), buckets(spark)
    reach = span - gram
    width = span + reach
    base = docs.select(docs[doc_id].cast("long").alias("doc"), docs[text].cast("string").alias("text")).filter("doc is not null")

    def listed(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    # an id that stands for several texts takes no part
    every = scratch.cut(base.select("doc", F.sha2("text", 256).alias("digest"), (F.octet_length("text") >= span).alias("long")))
    several = scratch.cut(every.groupBy("doc").agg(F.min(F.coalesce("digest", F.lit(""))).alias("a"), F.max(F.coalesce("digest", F.lit(""))).alias("z")).filter("a <> z").select("doc"))
    # whole copies: a digest for each, summed up before the shuffle
    digests = every.filter("long").join(listed(several), "doc", "left_anti").select("doc", "digest")
    first = digests.groupBy("digest").agg(F.min("doc").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = scratch.cut(to_group(digests, first, ["digest"], "n", every.count()).filter("doc <> first").select("doc"))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate([x[0] for x in held])
            d = np.concatenate([np.full(len(x[0]), x[1], np.int64) for x in held])
            p = np.concatenate([x[2] for x in held])
            bucket = (h % np.uint64(n)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(n + 1))
            rows = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            blob = [h[r].tobytes() + d[r].tobytes() + p[r].astype(np.uint32).tobytes() for r in rows]
            keep = [k for k, r in enumerate(rows) if len(r)]
            return pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array([blob[k] for k in keep], pa.binary())], names=["bucket", "blob"])

        for b in batches:
            data, at = bytes_of(b.column(1))
            for i, d in enumerate(b.column(0).to_pylist()):
                one = data[at[i] : at[i + 1]]
                if len(one) < span:
                    continue
                place, h = anchors(one, span, gram)
                held.append((h, d, place))
                size += len(h)
                if size > _ANCHORS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def twice(_: tuple, table: pa.Table) -> pa.Table:
        hs, ds, ps = [], [], []
        for x in table.column("blob"):
            raw = x.as_buffer()
            k = len(raw) // 20
            hs.append(np.frombuffer(raw, np.uint64, k))
            ds.append(np.frombuffer(raw, np.int64, k, 8 * k))
            ps.append(np.frombuffer(raw, np.uint32, k, 16 * k))
        h = np.concatenate(hs)
        order = np.argsort(h)
        h = h[order]
        eq = h[1:] == h[:-1]
        keep = order[np.concatenate([[False], eq]) | np.concatenate([eq, [False]])]
        d, p = np.concatenate(ds)[keep], np.concatenate(ps)[keep]
        to = (mix(d.view(np.uint64)) % np.uint64(n)).astype(np.int64)
        by = np.lexsort((p, d, to))
        to, d, p = to[by], d[by], p[by]
        cuts = np.searchsorted(to, np.arange(n + 1))
        some = np.flatnonzero(cuts[1:] > cuts[:-1])
        blobs = [d[cuts[k] : cuts[k + 1]].tobytes() + p[cuts[k] : cuts[k + 1]].tobytes() for k in some]
        out = pa.table({"to": pa.array(some, pa.int32()), "blob": pa.array(blobs, pa.binary())})
        release()
        return out

    def places(_: tuple, table: pa.Table) -> pa.Table:
        ds, ps = [], []
        for x in table.column("blob"):
            raw = x.as_buffer()
            k = len(raw) // 12
            ds.append(np.frombuffer(raw, np.int64, k))
            ps.append(np.frombuffer(raw, np.uint32, k, 8 * k))
        d, p = np.concatenate(ds), np.concatenate(ps)
        by = np.lexsort((p, d))
        d, p = d[by], p[by]
        heads = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        return pa.table({"doc": pa.array(d[heads], pa.int64()), "places": pa.array([p[a:b].tobytes() for a, b in zip(heads, [*heads[1:], len(d)], strict=True)], pa.binary())})

    # the first of equal texts sends anchors, its copies none, in whatever order they stand
    alone = base.join(listed(copies.union(several)), "doc", "left_anti")
    packed = alone.mapInArrow(tidy(collect), "bucket int, blob binary")
    # one blob for each pair of buckets, so what is sent doesn't grow with documents times buckets
    sent = packed.groupBy("bucket").applyInArrow(twice, "to int, blob binary")
    candidates = scratch.cut(sent.groupBy("to").applyInArrow(places, "doc long, places binary"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            d, p, low, high, rows = (np.concatenate([x[j] for x in held]) for j in range(5))
            key = np.zeros(len(p), np.uint64)
            for c in range(reach, reach + gram):
                key = key * np.uint64(0x9E3779B97F4A7C15) + rows[:, c].astype(np.uint64) + np.uint64(1)
            bucket = (mix(key) % np.uint64(n)).astype(np.int64)
            like = same_rows(rows)
            # a bucket's blob: how many strings, the strings, then for each place its string, document, start and bounds
            order = np.lexsort((like, bucket))
            cuts = np.searchsorted(bucket[order], np.arange(n + 1))
            keep, blobs = np.flatnonzero(cuts[1:] > cuts[:-1]), []
            for k in keep:
                r = order[cuts[k] : cuts[k + 1]]
                one, place = np.unique(like[r], return_inverse=True)
                blobs.append(np.array([len(one)], np.int64).tobytes() + d[r].tobytes() + b"".join(x.astype(np.uint32).tobytes() for x in (place, p[r], low[r], high[r])) + rows[one].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for b in batches:
            data, at = bytes_of(b.column(1))
            for i, d in enumerate(b.column(0).to_pylist()):
                one = data[at[i] : at[i + 1]]
                p = np.frombuffer(b.column(2)[i].as_buffer(), np.uint32).astype(np.int64)
                edge = np.zeros(len(one) + 2 * reach, np.uint8)
                edge[reach : reach + len(one)] = one
                for k in range(0, len(p), 100_000):
                    q = p[k : k + 100_000]
                    rows = edge[q[:, None] + np.arange(width)]
                    low, high = np.maximum(0, reach - q), np.minimum(width, len(one) - q + reach)  # what of a row is text
                    held.append((np.full(len(q), d, np.int64), q, low, high, rows))
                    size += len(q) * width
                    if size > _CONTEXTS:
                        yield flush()
                        held, size = [], 0
        if size:
            yield flush()

    def removed(_: tuple, table: pa.Table) -> pa.Table:
        strings, parts, total = [], [[] for _ in range(5)], 0
        for x in table.column("blob"):
            raw = x.as_buffer()
            m = int(np.frombuffer(raw, np.int64, 1)[0])
            k = (len(raw) - 8 - m * width) // 24
            parts[0].append(np.frombuffer(raw, np.int64, k, 8))
            for j in range(4):
                parts[j + 1].append(np.frombuffer(raw, np.uint32, k, 8 + 8 * k + 4 * j * k).astype(np.int64))
            parts[1][-1] += total
            strings.append(np.frombuffer(raw, np.uint8, m * width, 8 + 24 * k).reshape(m, width))
            total += m
        d, which, p, low, high = map(np.concatenate, parts)
        rows = np.concatenate(strings)
        which = same_rows(rows)[which]
        age = np.lexsort((p, d))
        d, which, p, low, high = d[age], which[age], p[age], low[age], high[age]
        same = np.concatenate([[False], (d[1:] == d[:-1]) & (p[1:] == p[:-1]) & (which[1:] == which[:-1])])
        d, which, p, low, high = d[~same], which[~same], p[~same], low[~same], high[~same]  # a place that is there twice
        # of equal strings with equal bounds the earliest is the only one that can hold something new
        _, first, group = np.unique(np.stack([which, low, high]), axis=1, return_index=True, return_inverse=True)
        alone = np.sort(first)
        column = np.arange(reach + 1)
        valid = (column >= low[alone, None]) & (column + span <= high[alone, None])
        row, left, right = _runs(equal_windows(rows[which[alone]], span, valid))
        late = np.setdiff1d(np.arange(len(d)), alone, assume_unique=True)
        late = late[np.maximum(low[late], 0) + span <= high[late]]
        owner = np.concatenate([d[alone[row]], d[late]])
        start = np.concatenate([p[alone[row]] - reach + left, p[late] - reach + low[late]])
        end = np.concatenate([p[alone[row]] - reach + right + span, p[late] - reach + high[late]])
        by = np.argsort(owner, kind="stable")
        owner, start, end = owner[by], start[by], end[by]
        ids, heads = np.unique(owner, return_index=True)
        spans = []
        for a, z in zip(heads, [*heads[1:], len(owner)] if len(heads) else [], strict=True):
            s, e = _merge(start[a:z], end[a:z])
            spans.append(np.stack([s, e]).astype(np.uint32).T.tobytes())
        out = pa.table({"doc": pa.array(ids, pa.int64()), "spans": pa.array(spans, pa.binary())})
        release()
        return out

    windows = base.join(candidates, "doc").select("doc", "text", "places").mapInArrow(tidy(contexts), "bucket int, blob binary")
    spans = scratch.cut(windows.groupBy("bucket").applyInArrow(removed, "doc long, spans binary"))
    scratch.drop(every, several, candidates)
    none = F.lit(None)
    rows = spans.select("doc", "spans", F.lit(False).alias("whole")).union(copies.select("doc", none.cast("binary"), F.lit(True)))
    return rows.groupBy("doc").agg(F.max("whole").alias("whole"), F.collect_list("spans").alias("spans"))


def remove_repeats(docs: DataFrame, span: int = 100, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Removes each byte that a string of `span` bytes covers which also starts earlier in the collection.

    Returns per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes; a cut may fall inside a
    character) and n_removed = 0 where nothing repeats. A null text counts as empty; texts under span bytes are left as they are; a row with a
    null id takes no part and is kept whole; rows that repeat an id and its text are one
    document that stands there more than once, none of them earlier than the other; an id with several texts takes no
    part, and all its rows are kept whole; an empty table gives none; the columns `keep` are carried
    along under keep_<name>, others are dropped.
    """
    spark = docs.sparkSession
    spans = repeated_spans(docs, Scratch(spark, "repeats"), span, doc_id, text)
    rest = F.struct(*[docs[c].alias(f"c{k}") for k, c in enumerate(keep or [])]) if keep else F.lit(0)
    base = docs.select(docs[doc_id].cast("long").alias("doc"), docs[text].cast("string").alias("text"), rest.alias("rest"))
    kind = base.schema["rest"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = bytes_of(b.column(1))
            whole, lists = b.column(2).to_pylist(), b.column(3)
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for i, w in enumerate(whole):
                one = data[at[i] : at[i + 1]]
                pairs = np.concatenate([np.frombuffer(x, np.uint32) for x in lists[i].as_py() or []] or [np.zeros(0, np.uint32)]).reshape(-1, 2).astype(np.int64)
                if w:
                    pairs = np.array([[0, len(one)]])
                count = 0
                if len(pairs):
                    s, e = _merge(pairs[:, 0], pairs[:, 1])
                    count = len(s)
                    left = b"".join(one[a:z].tobytes() for a, z in zip([0, *e], [*s, len(one)], strict=True))
                else:
                    left = one.tobytes()
                for k, v in (("n_bytes", len(one)), ("n_removed", len(one) - len(left)), ("n_spans", count), ("kept_sha256", hashlib.sha256(left).hexdigest()), ("kept", left)):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out["n_bytes"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.binary()), b.column(4)], names=["doc_id", *out, "rest"])

    joined = base.join(spans, "doc", "left").select("doc", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "spans", "rest")
    done = joined.mapInArrow(tidy(cut), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, rest {kind}")
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *[F.col(f"rest.c{k}").alias(f"keep_{c}") for k, c in enumerate(keep or [])])
