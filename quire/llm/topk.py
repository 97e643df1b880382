"""Exact search for the k largest inner products by two cover trees.

Queries and data are indexed together: both are dealt to the same pivots, whose balls are the top level, and below
that each block has a cover tree, built once and kept with the block. A pair of nodes can be left out if no vector of
the one can reach, with any of the other, the worst kth score of that group of queries: <q, r> <= <c, d> + |c| s +
|d| t + t s for centres c, d and covering radii t, s. Blocks of queries meet blocks of data; a first pass over the most
promising pairs sets the scores to beat, a second one takes the pairs that may still hold better ones.

A tree's levels come from farthest-first order: level i has the points that were taken at a distance of 2^i or more. So
levels nest, the points of level i are at least 2^i apart, and each point of level i has a parent of a higher level
that is nearer than 2^(i+1). Taking points ends when there is one for every LEAF vectors; those left are leaves of the nearest point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch

#: Vectors in a block of data, and queries in one of queries.
BLOCK, ASKED = 4096, 1024
#: Pivots: one for each block, between these bounds; they are broadcast.
PIVOTS = 32, 4096
LEAF = 96
#: Parts of the blocks that each block of queries meets in a task of its own.
SHARES = 16


def matrix(column: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Lists of integers as rows, filled up with zeros to the longest, or to width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, int)
    out = np.zeros((len(column), max(width, size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = np.asarray(column.flatten())
    return out


def cover_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The points taken (rows of x, farthest first), their levels, their parents among them, and each row's nearest point."""
    n = len(x)
    most = max(1, -(-n // LEAF))
    points, levels, parents = [0], [np.iinfo(np.int32).max], [0]
    away, owner = ((x - x[0]) ** 2).sum(axis=1), np.zeros(n, np.int32)
    while len(points) < most:
        far = int(away.argmax())
        if away[far] == 0:
            break
        level = int(np.floor(np.log2(away[far]) / 2))
        above = np.flatnonzero(np.array(levels) > level)
        parents.append(int(above[((x[np.array(points)[above]] - x[far]) ** 2).sum(axis=1).argmin()]))
        d = ((x - x[far]) ** 2).sum(axis=1)
        owner[d < away] = len(points)
        away = np.minimum(away, d)
        points.append(far)
        levels.append(level)
    return np.array(points, np.int32), np.array(levels, np.int32), np.array(parents, np.int32), owner


class Node:
    """A point at a level, with the vectors below it, its children one level down and the radius that covers them all."""

    __slots__ = ("centre", "children", "norm", "radius", "rows")

    def __init__(self, x: np.ndarray, point: int, rows: np.ndarray, children: list[Node]):
        self.rows, self.children, self.centre = rows, children, x[point]
        self.norm = float(np.linalg.norm(self.centre))
        self.radius = float(np.sqrt(((x[rows] - self.centre) ** 2).sum(axis=1).max(initial=0.0)))


def nodes(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> Node:
    """The root. A point's node has the point itself one level down among its children; levels where nothing joins are left out."""
    points, levels, parents, owner = tree
    by = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[by], np.arange(len(points) + 1))
    below: list[list[int]] = [[] for _ in points]
    for k in range(1, len(points)):
        below[parents[k]].append(k)
    made: dict[int, Node] = {}
    # a child is of a lower level than its parent, so by levels upwards all children are there
    for k in sorted(range(len(points)), key=lambda k: levels[k]):
        node = Node(x, points[k], by[cuts[k] : cuts[k + 1]], [])
        for level in sorted({levels[c] for c in below[k]}):
            children = [node, *(made.pop(c) for c in below[k] if levels[c] == level)]
            node = Node(x, points[k], np.concatenate([c.rows for c in children]), children)
        made[k] = node
    return made[0]


def dual_search(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray, trees: tuple | None = None) -> list[list[tuple[int, int]]]:
    """For each query the (score, id) pairs that may be among its k best: k at most, none under its floor.

    trees: those of q and x, if they are known already.
    """
    best: list[list[tuple[int, int]]] = [[] for _ in q]
    worst = floor.astype(np.float64).copy()
    exact = q.astype(np.float64), x.astype(np.float64)
    if max(np.abs(exact[0]).max(initial=0), 1) * max(np.abs(exact[1]).max(initial=0), 1) * max(q.shape[1], 1) >= 2**53:
        exact = q, x
    fq, fx = q.astype(np.float64), x.astype(np.float64)

    def bound(a: Node, b: Node) -> float:
        most = float(a.centre @ b.centre) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
        return most + 1e-6 * (abs(most) + a.norm * b.norm + 1.0)

    a, b = trees or (cover_tree(fq), cover_tree(fx))
    stack = [(nodes(fq, a), nodes(fx, b))]
    while stack:
        a, b = stack.pop()
        if bound(a, b) < worst[a.rows].min():
            continue
        if not a.children and not b.children:
            scores = exact[0][a.rows] @ exact[1][b.rows].T
            for r in np.flatnonzero((scores >= worst[a.rows][:, None]).any(axis=1)):
                i = a.rows[r]
                mine = np.flatnonzero(scores[r] >= worst[i])
                if len(mine) > 4 * k:  # the kth largest of these already bounds the rest
                    mine = mine[scores[r][mine] >= np.partition(scores[r][mine], -(k + 1))[-(k + 1)]]
                new = [(int(scores[r][m]), int(ids[b.rows[m]])) for m in mine if ids[b.rows[m]] != q_ids[i]]
                if new:
                    best[i] = sorted([*best[i], *new], key=lambda t: (-t[0], t[1]))[:k]
                    if len(best[i]) == k:
                        worst[i] = max(worst[i], best[i][-1][0])
            continue
        if a.children and (not b.children or a.radius * b.norm > b.radius * a.norm):
            pairs = [(c, b) for c in a.children]
        else:
            pairs = [(a, c) for c in b.children]
        stack += sorted(pairs, key=lambda p: bound(*p))
    return best


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products over floor(scale * component).

    Queries are the rows whose id is divisible by `every`; candidates are all rows but those with the query's own id.
    Ties go to the smaller id; a query with fewer candidates has fewer rows. Rows whose id or vector is null, or that
    hold a null or non-finite component, take no part; vectors of different length are compared as if filled
    up with zeros. Components beyond 63 bits are cut to them. Rows that repeat an id are candidates each, and as queries
    they are one (the first by components). An empty table gives no rows; other columns are dropped.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    v = vectors.select(vectors[vec_id].cast("long").alias("id"), F.transform(vectors[embedding].cast("array<double>"), lambda x: x).alias("e")).filter("id is not null and e is not null")
    v = v.filter(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    whole = scratch.cut(v.select("id", F.transform("e", lambda x: F.floor(x * F.lit(float(scale)))).alias("e")))
    total = whole.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # pivots: a bounded sample (the vectors with the least hashes) that decides only which block a vector is in
    some = min(PIVOTS[1], max(PIVOTS[0], total // BLOCK))
    sample = whole.select("e", F.xxhash64("id", "e").alias("h")).orderBy("h").limit(some).select("e").toArrow()
    shared = spark.sparkContext.broadcast(matrix(sample.column("e")).astype(np.float64))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for b in batches:
            group = np.zeros(b.num_rows, np.int32)
            for k in range(0, b.num_rows, 2048):
                x = matrix(b.column(1).slice(k, 2048), pivots.shape[1]).astype(np.float64)
                p = np.pad(pivots, ((0, 0), (0, x.shape[1] - pivots.shape[1])))
                group[k : k + 2048] = ((p**2).sum(axis=1) - 2 * (x @ p.T)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(group), b.column(1)], names=["id", "g", "e"])

    dealt = scratch.cut(whole.mapInArrow(deal, "id long, g int, e array<bigint>"))

    def parted(rows: DataFrame, sizes: dict[int, int], most: int) -> DataFrame:
        """rows with their block: pivots with few rows share one, those with many have several."""
        block, held, parts = -1, most, {}
        for g in sorted(sizes):
            if held + sizes[g] > most:
                block, held = block + 1, 0
            parts[g] = (block, max(1, -(-sizes[g] // most)))
            held += sizes[g]
            block += parts[g][1] - 1
        if not parts:
            return rows.withColumn("part", F.lit(0))
        first, n = (F.create_map(*[F.lit(x) for g, v in parts.items() for x in (g, v[k])])[F.col("g")] for k in (0, 1))
        return rows.withColumn("part", (first + F.pmod(F.xxhash64("id", "e"), n)).cast("int"))

    def block(key: tuple, table: pa.Table) -> pa.Table:
        x = matrix(table.column("e"))
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))
        tree = cover_tree(x.astype(np.float64))
        blobs = {"ids": table.column("id").to_numpy(), "x": x, "points": np.stack(tree[:3]), "owner": tree[3]}
        return pa.table({"part": [key[0]], "width": pa.array([x.shape[1]], pa.int32()), **{k: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in blobs.items()}, "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": pa.array([radius])})

    # PIVOTS numbers at most
    count = lambda df: {r["g"]: r["count"] for r in df.groupBy("g").count().collect()}
    kind = "part int, width int, ids binary, x binary, points binary, owner binary, centre array<double>, radius double"
    data = scratch.cut(parted(dealt, count(dealt), BLOCK).groupBy("part").applyInArrow(block, kind).withColumn("block", F.col("part").cast("long")))
    asked = scratch.cut(dealt.filter(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("e", "g")).alias("v")).select("id", "v.g", "v.e"))
    asked = parted(asked, count(asked), ASKED)
    asks = scratch.cut(asked.groupBy("part").applyInArrow(block, kind).withColumn("ask", F.col("part").cast("long")))

    # pairs of block heads (centre and radius only), the stated queries against all rows
    heads = data.select("block", "centre", "radius").withColumn("share", F.pmod("block", F.lit(SHARES)).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share")
    pairs = asks.select("ask", F.col("centre").alias("qc"), F.col("radius").alias("qr"), each).join(heads, "share")
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    dot = F.aggregate(F.zip_with("qc", "centre", lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    pairs = pairs.withColumn("most", dot + norm("qc") * F.col("radius") + norm("centre") * F.col("qr") + F.col("qr") * F.col("radius"))
    pairs = pairs.withColumn("most", F.col("most") + F.lit(1e-6) * (F.abs("most") + norm("qc") * norm("centre") + 1.0)).select("ask", "block", "most")
    pairs = scratch.cut(pairs.withColumn("turn", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("most"), "block"))))

    def meet(p: DataFrame, floors: DataFrame | None) -> DataFrame:
        left = asks.selectExpr("ask", "ids qi", "x qx", "width qw", "points qp", "owner qo")
        if floors is not None:
            left = left.join(floors, "ask", "left")
        else:
            left = left.withColumn("floors", F.lit(None).cast("map<bigint,bigint>"))
        both = p.join(left, "ask").join(data.selectExpr("block", "ids", "x", "width", "points", "owner"), "block")

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for qi, qx, qw, qp, qo, fl, ids, x, w, p, o in zip(*b.columns, strict=True):
                    qi, ids = (np.frombuffer(y.as_buffer(), np.int64) for y in (qi, ids))
                    a = np.frombuffer(qx.as_buffer(), np.int64).reshape(len(qi), qw.as_py())
                    z = np.frombuffer(x.as_buffer(), np.int64).reshape(len(ids), w.as_py())
                    n = max(a.shape[1], z.shape[1])
                    a, z = (np.pad(y, ((0, 0), (0, n - y.shape[1]))) for y in (a, z))
                    known = dict(fl.as_py() or [])
                    floor = np.array([known.get(int(i), -(2**63)) for i in qi], np.float64)
                    trees = [(*np.frombuffer(y.as_buffer(), np.int32).reshape(3, -1), np.frombuffer(own.as_buffer(), np.int32)) for y, own in ((qp, qo), (p, o))]
                    found = dual_search(a, qi, z, ids, k, floor, tuple(trees))
                    rows = [(int(i), r[1], r[0]) for i, best in zip(qi, found, strict=True) for r in best]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int64()) for y in zip(*rows, strict=True)], names=["query_id", "vec_id", "score"])

        return both.select("qi", "qx", "qw", "qp", "qo", "floors", "ids", "x", "width", "points", "owner").mapInArrow(search, "query_id long, vec_id long, score long")

    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    place = F.row_number().over(ranked)
    early = scratch.cut(meet(pairs.filter("turn <= 2"), None).withColumn("rank", place).filter(F.col("rank") <= k))
    kth = early.filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    where = asked.select(F.col("id").alias("query_id"), F.col("part").cast("long").alias("ask"))
    known = where.join(kth, "query_id", "left")
    floors = scratch.cut(known.groupBy("ask").agg(F.map_from_entries(F.collect_list(F.when(F.col("kth").isNotNull(), F.struct("query_id", "kth")))).alias("floors"), F.when(F.count("*") == F.count("kth"), F.min("kth")).alias("worst")))
    rest = pairs.filter("turn > 2").join(floors.select("ask", "worst"), "ask").filter("worst is null or most >= worst").select("ask", "block")
    late = meet(rest, floors.select("ask", "floors"))
    every_one = early.select("query_id", "vec_id", "score").union(late)
    out = every_one.withColumn("rank", place.cast("int")).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
