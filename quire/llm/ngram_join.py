"""Similarity join on word shingles by vertical partitioning.

All shingles have one global order: by hash, with those that are frequent in the corpus last. A set's rarest
shingles are its prefix, and two sets that are similar enough share one there. Pairs that meet are thinned by size
and by a bound on the overlap from bit signatures. Then the order is cut into fragments; the overlap of a pair is
counted in each fragment by itself, and the partial counts are summed per pair.

Documents with the same set are one class. Only what decides the groups is tested: first each set with the hub of
every shingle it shares, then the pairs that are still in different groups. No link between them is lost, and copies are never
paired with each other one by one. How many links each document has is counted afterwards, if asked for: links never
leave a group, so a group's sets are dealt to blocks and each pair of blocks is a matrix of overlaps in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import bytes_of, shingle_sets, slices
from ._shared import Scratch, buckets, release, tidy, to_group
from .components import components

#: Words of 64 bits in a signature. Each shingle flips one bit, so what two sets share cancels out, and no more bits
#: differ than shingles do. Sets with more shingles than that has bits have a wide signature too, of the next power of
#: two of bits: in a short one the differences of two long sets would cancel out as well.
BITS = 32
#: At most this many shingles count as frequent, at any corpus size; they only change the order, never the result.
FREQUENT = 1 << 18
#: A list of ids is broadcast up to this length; longer ones are joined by shuffle.
BROADCAST_IDS = 2_000_000
FRAGMENTS = 4
#: Hashes that a task holds before it sends them.
_HASHES = 400_000
#: Sets and shingles that a block of a group holds on average; a larger group has more blocks.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 20
#: Shingles whose overlaps are counted at once.
_COLUMNS = 4096


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(docs[doc_id].cast("long").alias("doc"), docs[text].cast("string").alias("text"))


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int | None, np.ndarray]]:
    ids = batch.column(0).to_pylist()
    data, at = bytes_of(batch.column(1))
    for i, j in slices(at):
        with np.errstate(over="ignore"):
            yield from zip(ids[i:j], shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], k), strict=True)


class Block:
    """Sets of one group as a block of bytes: ids, copies and sizes, then all hashes.

    An id that comes several times counts once, with its smallest set (the smallest hashes decide a tie).
    """

    def __init__(self, blobs: list[bytes]) -> None:
        heads, hashes = [], []
        for raw in blobs:
            k = int(np.frombuffer(raw, np.int64, 1)[0])
            heads.append(np.frombuffer(raw, np.int64, 3 * k, 8).reshape(3, k))
            hashes.append(np.frombuffer(raw, np.uint64, -1, 8 + 24 * k))
        docs, copies, sizes = np.concatenate(heads, axis=1) if heads else np.zeros((3, 0), np.int64)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        by = sorted(range(len(docs)), key=lambda i: (docs[i], sizes[i]))
        if len(np.unique(docs)) < len(docs):
            by.sort(key=lambda i: (docs[i], sizes[i], h[at[i] : at[i + 1]].tolist()))
            by = [i for k, i in enumerate(by) if not k or docs[i] != docs[by[k - 1]]]
        self.docs, self.copies, self.sizes = docs[by], copies[by], sizes[by]
        self.hashes = np.concatenate([h[at[i] : at[i + 1]] for i in by]) if by else h
        self.owner = np.repeat(np.arange(len(by)), self.sizes)

    @staticmethod
    def pack(rows: list[tuple[int, int, np.ndarray]]) -> bytes:
        head = np.array([[d, copies, len(s)] for d, copies, s in rows], np.int64).T
        return np.int64(len(rows)).tobytes() + np.ascontiguousarray(head).tobytes() + b"".join(s.tobytes() for _, _, s in rows)


def overlaps(a: Block, b: Block) -> np.ndarray:
    """How many shingles each set of a shares with each of b: fragment by fragment of the order, summed per pair."""
    total = np.zeros((len(a.docs), len(b.docs)))
    for f in range(FRAGMENTS):
        x, y = (np.flatnonzero((z.hashes >> np.uint64(62)).astype(np.int64) * FRAGMENTS // 4 == f) for z in (a, b))
        both = np.intersect1d(a.hashes[x], b.hashes[y])
        parts = []
        for z, at in ((a, x), (b, y)):
            h, row = z.hashes[at], z.owner[at]
            place = np.minimum(np.searchsorted(both, h), max(len(both) - 1, 0))
            kept = both[place] == h if len(both) else np.zeros(len(h), bool)
            by = np.argsort(place[kept], kind="stable")
            parts.append((place[kept][by], row[kept][by], len(z.docs)))
        for first in range(0, len(both), _COLUMNS):
            wide = min(_COLUMNS, len(both) - first)
            dense = []
            for place, row, sets in parts:
                i, j = np.searchsorted(place, [first, first + wide])
                m = np.zeros((sets, wide), np.float32)
                m[row[i:j], place[i:j] - first] = 1
                dense.append(m)
            total += dense[0] @ dense[1].T
    return total.astype(np.int64)


def _links_between(a: Block, b: Block | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, links): with how many documents of the other block each one links; b is None for links within a."""
    other = a if b is None else b
    common = overlaps(a, other)
    linked = 100 * common >= percent * (a.sizes[:, None] + other.sizes[None, :] - common)
    if b is None:
        np.fill_diagonal(linked, False)
        return a.docs, linked @ a.copies
    return np.concatenate([a.docs, b.docs]), np.concatenate([linked @ b.copies, linked.T @ a.copies])


def _count_links(base: DataFrame, groups: DataFrame, sets: DataFrame, scratch: Scratch, words: int, percent: int) -> DataFrame:
    """(rep, others): how many documents of other classes each class links with.

    groups(node, component) holds the classes that have a link at all, sets(doc, n, copies) every class. A group's
    classes are dealt to blocks by hash, as many as its sets and shingles need, and every pair of its blocks is one
    key of the shuffle. So a group of any size is many tasks; pairs become numbers where they are counted.
    """
    inside = groups.selectExpr("node doc", "component").join(sets, "doc")
    room = inside.groupBy("component").agg(F.count("*").alias("sets"), F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    dealt = to_group(inside, room, ["component"], "sets", groups.count())
    wanted = scratch.cut(dealt.select("doc", "component", "copies", "parts", F.expr("cast(pmod(xxhash64(doc), parts) as int)").alias("block")))
    near = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], list[tuple[int, int, np.ndarray]]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            component, parts, block = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(component, pa.int64()), pa.array(parts, pa.int32()), pa.array(block, pa.int32()), pa.array(map(Block.pack, held.values()), pa.binary())], names=["component", "parts", "block", "blob"])

        for b in batches:
            keys = zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True)
            for (d, s), (component, copies, parts, block) in zip(_sets(b, words), keys, strict=True):
                if not len(s):
                    continue
                held.setdefault((component, parts, block), []).append((d, copies, s))
                size += len(s)
                if size > _HASHES:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [])

        def done() -> tuple[np.ndarray, np.ndarray]:
            a, b = Block(sides[0]), None if key[1] == key[2] else Block(sides[1])
            return _links_between(a, b, percent)

        def rows(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            ids, links = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(ids[links > 0]), pa.array(links[links > 0])], names=["rep", "others"])

        for b in batches:
            found = []
            for component, low, high, block, blob in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (component, low, high) != key:
                    if key:
                        found.append(done())
                    key, sides = (component, low, high), ([], [])
                sides[block != low].append(blob)
            if found:
                yield rows(found)
        if key:
            yield rows([done()])

    packed = base.join(near, "doc").select("doc", "text", "component", "copies", "parts", "block").mapInArrow(tidy(pack), "component long, parts int, block int, blob binary")
    met = packed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("component", F.least("block", "j").alias("low"), F.greatest("block", "j").alias("high"), "block", "blob")
    keyed = met.repartition("component", "low", "high").sortWithinPartitions("component", "low", "high")
    return keyed.mapInArrow(tidy(tally), "rep long, others long").groupBy("rep").agg(F.sum("others").alias("others"))


def similar_groups(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents link when 100 * intersection >= percent * union.

    component_id is the smallest id reachable by links. With links, a further column n_links counts the other
    documents that the document links with, its copies included; the work for it grows with the square of a group's
    different texts. A null or wordless text has no shingles, links with nothing and is its own component; with
    fewer words than a shingle has, the whole sequence is one. A null id keeps its row, with a null component and no
    links. Rows that share an id share a component and are one document for n_links; if their texts differ, n_links is
    that of one of them. Repeated rows give repeated rows; an empty table gives none; other columns are dropped. Ties
    in size or hash don't matter: the groups are the same in any order.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "join")
    n = buckets(spark)
    base = _texts(docs, doc_id, text)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def frequent() -> pa.RecordBatch:
            h, count = np.unique(np.concatenate(held), return_counts=True)
            h, count = h[count > 1], count[count > 1]
            k = len(h)
            return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.list_(pa.int64())), pa.array(h.view(np.int64)), pa.array(count)], names=names)

        names = ["doc", "n", "mark", "bits", "wide", "shingle", "count"]
        for b in batches:
            rows: list[tuple] = []
            for d, s in _sets(b, words):
                bits = (np.bincount((s >> np.uint64(53)).astype(np.int64), minlength=64 * BITS) & 1).astype(np.uint8)
                with np.errstate(over="ignore"):
                    mark = np.array([s.sum(dtype=np.uint64), (s * s | np.uint64(1)).sum(dtype=np.uint64)] if len(s) else [0, 0], np.uint64).tobytes()
                wide = None
                if len(s) > 64 * BITS:
                    room = 1 << (len(s) - 1).bit_length()
                    wide = np.packbits((np.bincount((s & np.uint64(room - 1)).astype(np.int64), minlength=room) & 1).astype(np.uint8)).view(np.int64)
                rows.append((d, len(s), mark, np.packbits(bits).view(np.int64), wide))
                held.append(s)
                size += len(s)
            columns = list(zip(*rows, strict=True))
            k = len(rows)
            if k:
                bits = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(columns[3])), BITS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), bits, pa.array(columns[4], pa.list_(pa.int64())), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=names)
            if size > _HASHES:
                yield frequent()
                held, size = [], 0
        if held:
            yield frequent()

    seen = scratch.cut(base.mapInArrow(tidy(describe), "doc long, n long, mark binary, bits array<long>, wide array<long>, shingle long, count long"))
    rows = seen.filter("mark is not null").select("doc", "n", "mark", "bits", "wide")
    often = seen.filter("shingle is not null").groupBy("shingle").agg(F.sum("count").alias("count"))
    often = scratch.cut(often)
    total = often.agg(F.sum("count")).first()[0] or 0
    least = max(16, -(-total // FREQUENT))  # no more than FREQUENT shingles can be as frequent as that
    top = often.filter(F.col("count") >= least).orderBy("count", "shingle").toPandas()
    keys = top["shingle"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(keys)
    order = spark.sparkContext.broadcast((keys[by], (np.arange(len(keys)) + 1)[by].astype(np.int64)))

    # a class: the documents with one set; the smallest id stands for it
    marked = rows.filter("doc is not null and n > 0").select("doc", "n", "mark")
    first = scratch.cut(marked.groupBy("mark", "n").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")))
    # hot classes are broadcast: their copies stay where they are
    classes = scratch.cut(to_group(marked, first, ["mark", "n"], "copies", marked.count()).groupBy("doc").agg(F.min("rep").alias("rep")))
    signed = scratch.cut(rows.filter("doc is not null and n > 0").select("doc", "n", "bits", "wide").join(classes.filter("doc = rep"), "doc").dropDuplicates(["doc"]).select("doc", "n", "bits", "wide"))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = order.value
        met: set[bytes] = set()
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate([x[0] for x in held])
            d = np.concatenate([np.full(len(x[0]), x[1], np.int64) for x in held])
            c = np.concatenate([np.full(len(x[0]), x[2], np.uint32) for x in held])
            bucket = (h % np.uint64(n)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by], np.arange(n + 1))
            parts = [by[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
            keep = [k for k, r in enumerate(parts) if len(r)]
            return pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array([h[parts[k]].tobytes() + d[parts[k]].tobytes() + c[parts[k]].tobytes() for k in keep], pa.binary())], names=["bucket", "blob"])

        for b in batches:
            for d, s in _sets(b, words):
                if d is None or not len(s):
                    continue
                mark = s.tobytes() if len(s) < 3 else s[:2].tobytes() + s.sum(dtype=np.uint64).tobytes()
                if mark in met:  # a copy of what this task has sent already
                    continue
                if len(met) < 200_000:
                    met.add(mark)
                p = len(s) - -(-percent * len(s) // 100) + 1
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    late = np.where(known[at] == s, place[at], 0)
                    s = s[np.argsort(late, kind="stable")[:p]] if late.any() else s[:p]
                else:
                    s = s[:p]
                held.append((s, d, np.uint32(0)))
                size += len(s)
                if size > _HASHES:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def shared(_: tuple, table: pa.Table) -> pa.Table:
        hs, ds = [], []
        for x in table.column("blob"):
            raw = x.as_buffer()
            k = len(raw) // 20
            hs.append(np.frombuffer(raw, np.uint64, k))
            ds.append(np.frombuffer(raw, np.int64, k, 8 * k))
        h, d = np.concatenate(hs), np.concatenate(ds)
        by = np.argsort(h)
        h, d = h[by], d[by]
        eq = h[1:] == h[:-1]
        keep = np.concatenate([[False], eq]) | np.concatenate([eq, [False]])
        return pa.table({"shingle": pa.array(h[keep].view(np.int64)), "doc": pa.array(d[keep])})

    met = scratch.cut(base.mapInArrow(tidy(prefixes), "bucket int, blob binary").groupBy("bucket").applyInArrow(shared, "shingle long, doc long"))
    sizes = classes.join(signed.select(F.col("doc").alias("rep"), "n"), "rep")
    met_of = scratch.cut(met.join(sizes, "doc").groupBy("shingle", "rep").agg(F.max("n").alias("n")).withColumnRenamed("rep", "doc"))

    # the hub of a shingle: of the sets that have it, the one whose shingles most sets have. Near copies of one text
    # differ from each other twice as much as from that text, and it is the one that lacks none of what they share.
    # Only sums and maxima are grouped, so a shingle of any number of sets is summed up before the shuffle.
    spread = met_of.groupBy("shingle").agg(F.count("*").alias("sets"))
    strength = met_of.join(spread, "shingle").groupBy("doc").agg((F.sum("sets") / F.max("n")).alias("strength"))
    strong = met_of.join(strength, "doc").groupBy("shingle").agg(F.max(F.struct("strength", (-F.col("doc")).alias("hub"), "n")).alias("best"))
    hubs = met_of.join(strong, "shingle").select(F.col("doc"), "n", (-F.col("best.hub")).alias("hub"), F.col("best.n").alias("m"))
    pairs = hubs.filter(f"doc <> hub and 100 * least(n, m) >= {percent} * greatest(n, m)").select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b")).distinct()
    bits = signed.selectExpr("doc", "n", "bits w")
    wide = signed.filter("wide is not null").select("doc", "wide")

    def hopeful(p: DataFrame) -> DataFrame:
        """Pairs whose signatures leave room for enough overlap: it is at most (n + m - differing bits) / 2."""
        x = p.join(bits.selectExpr("doc a", "n na", "w wa"), "a").join(bits.selectExpr("doc b", "n nb", "w wb"), "b")
        apart = F.expr("aggregate(zip_with(wa, wb, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)").cast("long")
        most = F.floor((F.col("na") + F.col("nb") - apart) / 2)
        return x.filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").filter((100 + percent) * most >= percent * (F.col("na") + F.col("nb"))).select("a", "b", "na", "nb")

    def narrowed(p: DataFrame) -> DataFrame:
        """Pairs that pass the same bound by their wide signatures, where both have one of about the same length.

        A signature's lower half and upper half make, bit by bit, the signature of half the length.
        """
        x = p.join(wide.selectExpr("doc a", "wide wa"), "a", "left").join(wide.selectExpr("doc b", "wide wb"), "b", "left")

        def fitted(w: str, other: str) -> str:
            k = f"size({other})"
            return f"if(size({w}) > {k}, zip_with(slice({w}, 1, {k}), slice({w}, {k} + 1, {k}), (x, y) -> x ^ y), {w})"

        apart = F.expr(f"aggregate(zip_with({fitted('wa', 'wb')}, {fitted('wb', 'wa')}, (x, y) -> bit_count(x ^ y)), 0L, (s, x) -> s + x)")
        fits = (100 + percent) * F.floor((F.col("na") + F.col("nb") - apart) / 2) >= percent * (F.col("na") + F.col("nb"))
        known = F.expr("wa is not null and wb is not null and greatest(size(wa), size(wb)) <= 2 * least(size(wa), size(wb))")
        return x.filter(F.when(known, fits).otherwise(F.lit(True))).select("a", "b", "na", "nb")

    def linked(p: DataFrame) -> DataFrame:
        """The pairs of p (a written table) that are links: partial overlaps per fragment, summed per pair."""
        wanted = p.selectExpr("a doc").union(p.selectExpr("b doc")).distinct()
        count = wanted.count()
        chosen = base.join(F.broadcast(wanted) if count <= BROADCAST_IDS else wanted, "doc", "left_semi")

        def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ds, fs, blobs = [], [], []
                for d, s in _sets(b, words):
                    part = (s >> np.uint64(62)).astype(np.int64) * FRAGMENTS // 4
                    cuts = np.searchsorted(part, np.arange(FRAGMENTS + 1))
                    for f in range(FRAGMENTS):
                        if cuts[f] < cuts[f + 1]:
                            ds.append(d)
                            fs.append(f)
                            blobs.append(s[cuts[f] : cuts[f + 1]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ds, pa.int64()), pa.array(fs, pa.int32()), pa.array(blobs, pa.binary())], names=["doc", "f", "s"])

        def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                each = [len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True)) for x, y in zip(b.column(4), b.column(5), strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(each, pa.int64())], names=["a", "b", "na", "nb", "common"])

        frag = scratch.cut(chosen.mapInArrow(tidy(fragments), "doc long, f int, s binary").dropDuplicates(["doc", "f"]))
        each = p.withColumn("f", F.explode(F.array([F.lit(f) for f in range(FRAGMENTS)])))
        both = each.join(frag.selectExpr("doc a", "f", "s sa"), ["a", "f"]).join(frag.selectExpr("doc b", "f", "s sb"), ["b", "f"])
        partial = both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(tidy(overlap), "a long, b long, na long, nb long, common long")
        sums = partial.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
        out = scratch.cut(sums.filter(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b"))
        scratch.drop(frag)
        return out

    tested = scratch.cut(narrowed(hopeful(pairs)))
    found = linked(tested)
    groups = scratch.cut(components(found, scratch))

    # what is left: pairs under one shingle in different groups, thinned before they leave the task
    label = signed.select("doc").join(groups, signed["doc"] == groups["node"], "left").select("doc", F.coalesce("component", "doc").alias("label"))
    labelled = met_of.join(label, "doc")
    split = labelled.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("shingle")
    rest = labelled.join(split, "shingle", "left_semi").join(bits.select("doc", "w"), "doc")

    def remaining(_: tuple, table: pa.Table) -> pa.Table:
        h, d, c, g = (table.column(x).to_numpy() for x in ("shingle", "doc", "n", "label"))
        ids, at = np.unique(d, return_index=True)
        w = np.stack([np.array(table.column("w")[int(i)].as_py(), np.int64) for i in at]).view(np.uint64)
        by = np.lexsort((d, c, h))
        h, d, c, g = h[by], d[by], c[by], g[by]
        slot = np.searchsorted(ids, d)
        group = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
        end = np.searchsorted(group, group, "right")
        kept: list[np.ndarray] = []
        live, step = np.arange(len(h)), 1
        while len(live):
            live = live[live + step < end[live]]
            live = live[100 * c[live] >= percent * c[live + step]]  # sizes only grow from here
            x, y = live, live + step
            m = g[x] != g[y]
            x, y = x[m], y[m]
            for k in range(0, len(x), 1 << 18):
                i, j = x[k : k + (1 << 18)], y[k : k + (1 << 18)]
                apart = np.bitwise_count(w[slot[i]] ^ w[slot[j]]).sum(axis=1, dtype=np.int64)
                ok = (100 + percent) * ((c[i] + c[j] - apart) // 2) >= percent * (c[i] + c[j])
                if ok.any():
                    kept.append(np.unique(np.stack([np.minimum(d[i], d[j]), np.maximum(d[i], d[j])])[:, ok], axis=1))
            step += 1
        pairs = np.unique(np.concatenate(kept, axis=1), axis=1) if kept else np.zeros((2, 0), np.int64)
        return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})

    more = rest.withColumn("bucket", F.pmod(F.hash("shingle"), F.lit(n))).groupBy("bucket").applyInArrow(remaining, "a long, b long").distinct()
    sized = signed.select("doc", "n")
    more = more.join(tested.select("a", "b"), ["a", "b"], "left_anti").join(sized.selectExpr("doc a", "n na"), "a").join(sized.selectExpr("doc b", "n nb"), "b").select("a", "b", "na", "nb")
    more = scratch.cut(narrowed(more))
    if not more.isEmpty():
        found = scratch.cut(found.union(linked(more)))
        groups = scratch.cut(components(found, scratch))
    # a hot class's row is broadcast: its copies stay where they are
    copies = scratch.cut(classes.groupBy("rep").agg(F.count("*").alias("copies")))
    about = copies.join(groups.selectExpr("node rep", "component"), "rep", "left").select("rep", "copies", F.coalesce("component", "rep").alias("component"))
    if links:
        sets = signed.select("doc", "n").join(copies.withColumnRenamed("rep", "doc"), "doc")
        others = _count_links(base, groups, sets, scratch, words, percent)
        about = about.join(others, "rep", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("others", F.lit(0))).drop("others")
    about = scratch.cut(about)
    of = to_group(classes, about, ["rep"], "copies", classes.count()).drop("rep")
    out = rows.select("doc", "n").join(of, "doc", "left")
    number = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if links else []
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"), *number)
