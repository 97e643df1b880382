"""Best-fit packing of token pieces into sequences by bin completion with branch and bound.

What is packed is known by its length alone, so the search runs on how many pieces there are of each length: at
most `capacity` numbers, however many documents there are. The plan is a short list of fillings with the number of
times each is used; pieces then find their place by their rank among those of the same length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch, buckets, tidy
from .bpe import codec

#: So many fillings are looked at together, and the fullest of them tried first; then the next ones.
AHEAD = 24

Filling = tuple[int, ...]
Plan = list[tuple[Filling, int]]


class Budget:
    """Steps that a search may still take."""

    def __init__(self, steps: int):
        self.left = steps


def fillings(room: int, counts: np.ndarray, budget: Budget) -> Iterator[Filling]:
    """All undominated fillings of a room beside the largest piece, one by one, larger pieces first.

    One piece that fits exactly dominates all others, and is the only one. A filling is left out if another piece would
    still fit, or if a longer unused piece could replace one of its pieces. Each step of the search takes one of the
    budget, and with none left it ends.
    """
    if room <= 0:
        yield ()
        return
    if counts[room] > 0:
        yield (room,)
        return
    have = [int(x) for x in np.flatnonzero(counts[: room + 1])[::-1]]
    if not have:
        yield ()
        return

    def undominated(used: Filling, left: int) -> bool:
        free = [x for x in have if counts[x] > used.count(x)]
        if free and free[-1] <= left:
            return False
        return not left or not any(x < y <= x + left for x in set(used) for y in free)

    # a frame: room left, where in `have` to go on, the pieces so far
    stack: list[list] = [[room, 0, ()]]
    while stack and budget.left > 0:
        budget.left -= 1
        left, k, used = stack[-1]
        while k < len(have) and (have[k] > left or counts[have[k]] <= used.count(have[k])):
            k += 1
        if k == len(have):
            stack.pop()
            if undominated(used, left):
                yield used
            continue
        stack[-1][1] = k + 1  # later: without another piece of this size
        stack.append([left - have[k], k, (*used, have[k])])


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing, one block of equal bins at a time: the first incumbent."""
    left, plan = counts.copy(), []
    for size in range(capacity, 0, -1):
        while left[size]:
            left[size] -= 1
            used, room = [size], capacity - size
            while room:
                fits = np.flatnonzero(left[: room + 1])
                if not len(fits):
                    break
                used.append(int(fits[-1]))
                left[fits[-1]] -= 1
                room -= int(fits[-1])
            again = min([int(left[x]) // used.count(x) for x in set(used)])
            for x in used:
                left[x] -= again
            plan.append((tuple(used), 1 + again))
    return plan


def bins(plan: Plan) -> int:
    return sum(n for _, n in plan)


def least_bins(counts: np.ndarray, capacity: int) -> int:
    """Martello and Toth's second bound: no packing needs fewer."""
    sizes = np.arange(len(counts))
    total, best = int((counts * sizes).sum()), 0
    for k in range(capacity // 2 + 1):
        large, middle, small = counts[capacity - k + 1 :], counts[capacity // 2 + 1 : capacity - k + 1], counts[k : capacity // 2 + 1]
        n1, n2 = int(large.sum()), int(middle.sum())
        free = n2 * capacity - int((middle * sizes[capacity // 2 + 1 : capacity - k + 1]).sum())
        need = int((small * sizes[k : capacity // 2 + 1]).sum()) - free
        best = max(best, n1 + n2 + max(0, -(-need // capacity)))
    return max(best, -(-total // capacity))


def complete_bins(counts: np.ndarray, capacity: int, steps: int = 50_000) -> Plan:
    """Bin completion: branch over all undominated fillings around the largest piece left, depth first.

    A branch ends when the waste so far leaves no way to beat the incumbent. The search ends when the incumbent meets
    the lower bound, when every branch has been seen (then the incumbent is the best there is), or after `steps` steps:
    a bound on time, not on what is packed, as the incumbent is always a whole packing. Of equal bins as many as there
    can be are filled as one block first, and one alone after that.
    """
    total = int((counts * np.arange(len(counts))).sum())
    best, low, budget = best_fit(counts, capacity), least_bins(counts, capacity), Budget(steps)

    def moves(left: np.ndarray, size: int) -> Iterator[tuple[Filling, int, int]]:
        left = left.copy()
        left[size] -= 1
        more = fillings(capacity - size, left, budget)
        for used in (u for few in iter(lambda: list(islice(more, AHEAD)), []) for u in sorted(few, key=lambda u: (-sum(u), len(u)))):
            whole = (size, *used)
            again = min(int(left[x] + (x == size)) // whole.count(x) for x in set(whole))
            yield whole, again, capacity - sum(whole)
            if again > 1:
                yield whole, 1, capacity - sum(whole)

    def frame(left: np.ndarray, plan: tuple, waste: int) -> tuple:
        return left, plan, waste, moves(left, int(np.flatnonzero(left)[-1]))

    # a plan is a chain (filling, times, the chain before, bins so far): branches share what they have in common
    slack = (bins(best) - 1) * capacity - total
    stack = [frame(counts, (None, 0, None, 0), 0)] if counts.any() else []
    while stack and bins(best) > low and budget.left > 0:
        left, plan, waste, more = stack[-1]
        move = next(more, None)
        if move is None:
            stack.pop()
            continue
        whole, again, lost = move
        if waste + lost * again > slack:
            continue
        rest = left.copy()
        for x in whole:
            rest[x] -= again
        chain = (whole, again, plan, plan[3] + again)
        if rest.any():
            stack.append(frame(rest, chain, waste + lost * again))
        elif chain[3] < bins(best):
            best, at = [], chain
            while at[0] is not None:
                best.append((at[0], at[1]))
                at = at[2]
            slack = (bins(best) - 1) * capacity - total
    return best


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's ids followed by end_id, cut into pieces of at most capacity: (doc_id, piece, start, length, ids_crc32)."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in batches:
            rows: list[tuple] = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(c.ids(t.as_py() or ""), np.array([end_id], "<u4")).astype("<u4")
                view, n = memoryview(ids.tobytes()), len(ids)
                first = n - capacity * ((n - 1) // capacity)
                cuts = [0, *range(first, n + 1, capacity)]
                rows += [(d, k, a, z - a, zlib.crc32(view[4 * a : 4 * z])) for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, schema, strict=True)], schema=schema)
        c.forget()

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(tidy(work), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs all documents into as few sequences of at most capacity tokens as the search finds.

    Returns (doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece. A null text
    counts as empty (one piece: end_id alone); rows with the same or a null id are packed as documents of their
    own; an empty table gives none. Documents longer than capacity are cut, the first piece being the short one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    salts = buckets(spark)
    pieces = scratch.cut(token_pieces(docs, vocabulary, capacity, end_id, doc_id, text).withColumn("salt", F.pmod(F.xxhash64("doc_id", "ids_crc32", "piece"), F.lit(salts)).cast("int")))
    # at most capacity x salts rows (salts grow with the shuffle partitions): ranks are counted per length and salt, so no length is ranked in one task
    share = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    base = share.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("base"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in share.groupBy("length").agg(F.sum("n")).collect():  # at most capacity rows
        counts[length] = n
    plan = complete_bins(counts, capacity)
    ranked = pieces.withColumn("place", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    ranked = ranked.join(F.broadcast(base), ["length", "salt"])
    # slot tables: for each length, from which rank on a filling takes pieces
    used, keys, seq, off, first = np.zeros(capacity + 1, np.int64), [], [], [], 0
    for filling, times in plan:
        at = 0
        for x in filling:
            keys.append((x, int(used[x])))
            seq.append(first)
            off.append(at)
            used[x] += times
            at += x
        first += times
    order = sorted(range(len(keys)), key=keys.__getitem__)
    length_at = np.array([keys[i][0] for i in order], np.int64)
    rank_at, seq_at, off_at = (np.array(x, np.int64) for x in ([keys[i][1] for i in order], [seq[i] for i in order], [off[i] for i in order]))
    shared = spark.sparkContext.broadcast((length_at, rank_at, seq_at, off_at))  # as long as the plan: a few times capacity
    out = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks, seqs, offs = shared.value
        begin = np.searchsorted(lengths, np.arange(capacity + 2))
        for b in batches:
            n, rank = (np.asarray(b.column(k)) for k in (3, 5))
            slot = np.zeros(len(n), np.int64)
            for x in np.unique(n):
                mine = n == x
                slot[mine] = begin[x] + np.searchsorted(ranks[begin[x] : begin[x + 1]], rank[mine], "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), pa.array(seqs[slot] + rank - ranks[slot]), pa.array(offs[slot])], schema=out)

    rows = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank"))
    return rows.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
