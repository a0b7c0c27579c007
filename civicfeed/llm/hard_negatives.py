"""Hard negatives by score windows: a vantage-point tree over norm-augmented vectors.

A vector x of squared norm n is raised by one coordinate, sqrt(M - n), where M is the greatest squared norm; a query q by 0.
Then |q' - x'|² = |q|² + M - 2 q·x: the higher an inner product, the nearer the point, and a window of scores is a ring of
distances around the query. A vantage-point tree on a sample of the points cuts space into cells; each cell's points are a
block with a tree of its own, kept as a row of the index. A search goes through nodes and points nearest first, leaves out
nodes that lie inside or outside the ring, and stops after k rows. Its first round asks the nearest cell of each query;
what that finds narrows the rings with which the second asks the others.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize

#: Points of a cell, about; of a leaf in a cell's tree; of a block, beyond which a cell is cut in pieces; cells at most.
CELL, LEAF, BLOCK, CELLS = 4096, 128, 16_384, 4096
#: Queries of a task at most and, where tasks would be fewer than the session's shuffle partitions, at least.
ASKS, ASKS_LEAST = 2048, 64
#: Scores beyond all inner products; squared norms of vectors are below it.
FAR = 1 << 62


def raised(x: np.ndarray, top: int) -> np.ndarray:
    """Vectors with the coordinate that brings their squared norm to ``top``."""
    y = x.astype(np.float64)
    return np.column_stack([y, np.sqrt((top - (y**2).sum(1)).clip(min=0))])


@dataclass
class Tree:
    """Inner node i: ``vantage[i]``, and for either child its node or ~leaf and the least and greatest distance of its points.

    Leaf j holds ``order[starts[j]:starts[j + 1]]``. A tree without inner nodes is one leaf.
    """

    vantage: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray
    order: np.ndarray
    starts: np.ndarray

    @classmethod
    def build(cls, y: np.ndarray, leaf: int, seed: int = 3) -> Tree:
        """Halves at the median distance from the one of eight random points whose distances vary most."""
        rng = np.random.default_rng(seed)
        nodes: list[list] = []
        leaves: list[np.ndarray] = []

        def cut(own: np.ndarray) -> int:
            if len(own) > leaf:
                some = y[rng.choice(own, min(64, len(own)), replace=False)]
                spread = [np.linalg.norm(some - v, axis=1).var() for v in some[:8]]
                v = some[int(np.argmax(spread))]
                d = np.linalg.norm(y[own] - v, axis=1)
                near = d <= np.median(d)
                if near.all():
                    near = d < d.max()
                if near.any():  # else all are equally far, as copies are
                    at = len(nodes)
                    nodes.append([v, [0, 0], [d[near].min(), d[~near].min()], [d[near].max(), d[~near].max()]])
                    nodes[at][1] = [cut(own[near]), cut(own[~near])]
                    return at
            leaves.append(own)
            return ~(len(leaves) - 1)

        cut(np.arange(len(y)))
        width = y.shape[1]
        part = lambda i, kind, w: np.array([n[i] for n in nodes], kind).reshape(-1, w)
        starts = np.concatenate([[0], np.cumsum([len(x) for x in leaves])]).astype(np.int64)
        return cls(part(0, float, width), part(1, np.int64, 2), part(2, float, 2), part(3, float, 2), np.concatenate(leaves).astype(np.int64), starts)

    def path(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For points that may be new: the leaf of each, and by node the distance to its vantage point (nan off the way)."""
        leaf, d = np.zeros(len(y), np.int64), np.full((len(y), len(self.child)), np.nan)
        todo = [(0, np.arange(len(y)))] if len(self.child) else []
        while todo:
            i, own = todo.pop()
            d[own, i] = np.linalg.norm(y[own] - self.vantage[i], axis=1)
            far = d[own, i] > (self.high[i, 0] + self.low[i, 1]) / 2
            for s, mine in ((0, own[~far]), (1, own[far])):
                to = int(self.child[i, s])
                if to >= 0 and len(mine):
                    todo.append((to, mine))
                elif to < 0:
                    leaf[mine] = ~to
        return leaf, d


@dataclass
class Block:
    """The points of one piece of a cell with their tree: vectors, labels, and the ids of each, ascending."""

    tree: Tree
    x: np.ndarray
    label: np.ndarray
    ids: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, points: pd.DataFrame, top: int) -> Block:
        x = np.stack(points["v"].to_numpy()).astype(np.int64)
        tree = Tree.build(raised(x, top), LEAF)
        rows = [points["ids"].iloc[i] for i in tree.order]  # in the leaves' order, so that a leaf is a slice
        starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        return cls(tree, x[tree.order], points["label"].to_numpy(np.int64)[tree.order], np.concatenate(rows).astype(np.int64), starts)

    def pack(self) -> bytes:
        out, t = io.BytesIO(), self.tree
        np.savez(out, t.vantage, t.child, t.low, t.high, t.starts, self.x, self.label, self.ids, self.starts)
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> Block:
        with np.load(io.BytesIO(data), allow_pickle=False) as f:
            a = [f[n] for n in f.files]
        return cls(Tree(*a[:4], np.arange(len(a[5])), a[4]), *a[5:])

    def search(self, q: np.ndarray, own: int, label: int, same: bool, rings: list[tuple[int, int]], k: int, top: int) -> list[list[tuple[int, int]]]:
        """For each ring (highest, lowest score) its first k (score, id): scores descending, then ids; ``own`` is left out."""
        tree, square = self.tree, int(q @ q)
        exact = self._exact(top)
        yq, qx = np.append(q.astype(float), 0.0), q.astype(exact.dtype)
        whole = float(square + top)
        slack = 1e-6 + 1e-9 * whole  # distances are rounded, scores are not
        first = self.ids[self.starts[:-1]]
        second = np.where(np.diff(self.starts) > 1, self.ids[(self.starts[:-1] + 1).clip(max=len(self.ids) - 1)], -1)
        lead = np.where(first == own, second, first)
        fits = ((self.label == label) if same else (self.label != label)) & ~((first == own) & (np.diff(self.starts) == 1))
        scores: dict[int, np.ndarray] = {}
        gaps: dict[int, float] = {}
        out = []
        for high, low in rings:
            # (what it can score at most, negated; 0 node or leaf, 1 row; node, ~leaf or id; nearest and farthest)
            heap = [(-high, 0, 0 if len(tree.child) else -1, 0.0, np.inf)]
            found: list[tuple[int, int]] = []
            while heap and len(found) < k:
                bound, is_row, at, near, far = heapq.heappop(heap)
                if is_row:
                    found.append((-bound, at))
                elif at < 0:
                    a, b = tree.starts[~at], tree.starts[~at + 1]
                    if at not in scores:
                        scores[at] = (exact[a:b] @ qx).astype(np.int64)
                    s = scores[at]
                    hit = np.flatnonzero((s <= high) & (s >= low) & fits[a:b])
                    for i in hit[np.lexsort((lead[a:b][hit], -s[hit]))[:k]]:
                        for n in self.ids[self.starts[a + i] : self.starts[a + i + 1]]:
                            if n != own:
                                heapq.heappush(heap, (-int(s[i]), 1, int(n), 0.0, 0.0))
                else:
                    if at not in gaps:
                        gaps[at] = float(np.linalg.norm(yq - tree.vantage[at]))
                    d = gaps[at]
                    for side in (0, 1):
                        n, f = max(near, tree.low[at, side] - d, d - tree.high[at, side]), min(far, d + tree.high[at, side])
                        most, least = (whole - n * n) / 2 + slack, (whole - f * f) / 2 - slack
                        if most >= low and least <= high:
                            heapq.heappush(heap, (-min(most, high), 0, int(tree.child[at, side]), n, f))
            out.append(found)
        return out

    def _exact(self, top: int) -> np.ndarray:
        """Vectors in a type that holds all inner products; no sum within one is beyond ``top``."""
        return self.x.astype(np.float64) if top < 1 << 52 else self.x


def points_of(rows: DataFrame, k: int) -> DataFrame:
    """(v, label, ids): the distinct vectors of each label with their k + 1 least ids, as one of these may be the query's own."""
    order = Window.partitionBy("v", "label").orderBy("id")
    few = rows.select("v", "label", "id").distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    return few.groupBy("v", "label").agg(F.sort_array(F.collect_list("id")).alias("ids"))


class Index:
    """Blocks of points, as a table, and the cells' bounds: for each node over a cell its distances from the vantage point."""

    def __init__(self, points: DataFrame, sample: int) -> None:
        """``points``: v, label, ids. At most ``sample`` of them shape the cells; all are indexed."""
        spark = points.sparkSession
        self.spark = spark
        norm = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
        told = points.agg(F.count("*").alias("n"), F.max(norm).alias("top"), F.max(F.size("v")).alias("width")).first()
        self.n, self.top, width = told.n, int(told.top or 0), told.width or 1
        cells = min(CELLS, max(1, -(-self.n // CELL)))
        chosen = points.select("v").orderBy(F.xxhash64("v"), "v").limit(min(sample, 32 * cells) if cells > 1 else 1).collect()
        y = raised(np.array([r.v for r in chosen], np.int64).reshape(-1, width), self.top)
        tree = Tree.build(y, max(1, -(-len(y) // cells))) if len(y) else Tree.build(np.zeros((1, width + 1)), 1)
        self.tree = shared = spark.sparkContext.broadcast(tree)
        top = self.top

        def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for at in range(0, len(f), 4096):
                    part = f.iloc[at : at + 4096]
                    yield part.assign(cell=shared.value.path(raised(np.stack(part["v"].to_numpy()), top))[0])

        schema = "v array<long>, label long, ids array<long>, cell long"
        routed = points.mapInPandas(route, schema)
        pieces = routed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("pieces"))
        piece = F.pmod(F.xxhash64("v", "label"), F.col("pieces")).cast("int")
        dealt = routed.join(F.broadcast(pieces), "cell").withColumn("piece", piece).drop("pieces")

        def block(own: pd.DataFrame) -> pd.DataFrame:
            packed = Block.of(own, top).pack()
            _, d = shared.value.path(raised(np.stack(own["v"].to_numpy()), top))
            way = np.flatnonzero(~np.isnan(d[0])) if d.shape[1] else np.zeros(0, int)
            at = dict(cell=own["cell"].iloc[0], piece=own["piece"].iloc[0], block=packed)
            return pd.DataFrame([at | dict(node=way, low=d[:, way].min(0) if len(way) else [], high=d[:, way].max(0) if len(way) else [])])

        made = dealt.groupBy("cell", "piece").applyInPandas(block, "cell long, piece int, block binary, node array<long>, low array<double>, high array<double>")
        self.blocks = materialize(made, "blocks")
        bounds = self.blocks.select("cell", F.explode(F.arrays_zip("node", "low", "high")).alias("b")).groupBy("cell", "b.node")
        bounds = bounds.agg(F.min("b.low").alias("low"), F.max("b.high").alias("high")).collect()  # cells times the tree's depth
        own = {r.cell: i for i, r in enumerate(self.blocks.select("cell").distinct().orderBy("cell").collect())}
        low, high = np.full((len(own), len(tree.child)), -np.inf), np.full((len(own), len(tree.child)), np.inf)
        for r in bounds:
            low[own[r.cell], r.node], high[own[r.cell], r.node] = r.low, r.high
        self.bounds = spark.sparkContext.broadcast((np.array(list(own), np.int64), low, high))

    def _reach(self, asks: DataFrame, nearest: bool | None) -> DataFrame:
        """``asks`` with each cell that their rings touch: the nearest one, or all but the nearest one."""
        tree, bounds, top = self.tree, self.bounds, self.top

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cells, low, high = bounds.value
            for f in frames:
                which, to = [], []
                for i, (v, rings) in enumerate(zip(f["v"], f["rings"], strict=True)):
                    q = np.asarray(v, np.int64)
                    d = np.linalg.norm(np.append(q.astype(float), 0.0) - tree.value.vantage, axis=1)
                    near = np.maximum(low - d, d - high).max(1, initial=0.0)
                    far = (d + high).min(1, initial=np.inf)
                    whole = float(q @ q + top)
                    most, least = (whole - near**2) / 2 + 1e-6 + 1e-9 * whole, (whole - far**2) / 2 - 1e-6 - 1e-9 * whole
                    touched = np.zeros(len(cells), bool)
                    for r in rings:
                        touched |= (most >= r["low"]) & (least <= r["high"])
                    first = int(np.lexsort((far, near))[0]) if len(cells) else 0
                    mine = [first] if nearest else [c for c in np.flatnonzero(touched) if c != first]
                    which += [i] * len(mine)
                    to += [cells[c] for c in mine] if len(cells) else []
                if len(cells):
                    yield f.iloc[which].assign(cell=to)

        return asks.mapInPandas(run, ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in asks.schema.fields) + ", cell long")

    def _ask(self, asks: DataFrame, nearest: bool, k: int, same: bool, n_asks: int) -> DataFrame:
        top, spark = self.top, self.spark
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        blocks = max(1, self.blocks.count())
        chunks = max(1, -(-n_asks // ASKS), min(-(-n_asks // ASKS_LEAST), -(-tasks // blocks)))
        pieces = self.blocks.groupBy("cell").agg(F.max("piece").alias("last"))
        right = self._reach(asks, nearest).join(F.broadcast(pieces), "cell").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("last"))))
        right = right.withColumn("chunk", F.pmod(F.xxhash64("ask"), F.lit(chunks)).cast("int")).drop("last")
        left = self.blocks.select("cell", "piece", "block", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))

        def run(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            rows = []
            if len(own) and len(asked):
                block = Block.unpack(own["block"].iloc[0])
                for ask, v, mine, label, rings in asked[["ask", "v", "own", "label", "rings"]].itertuples(index=False):
                    got = block.search(np.asarray(v, np.int64), mine, label, same, [(r["high"], r["low"]) for r in rings], k, top)
                    rows += [(ask, r["turn"], s, n) for r, found in zip(rings, got, strict=True) for s, n in found]
            return pd.DataFrame(rows, columns=["ask", "turn", "score", "id"])

        by = ("cell", "piece", "chunk")
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(run, "ask long, turn int, score long, id long")

    def search(self, asks: DataFrame, k: int, same: bool) -> DataFrame:
        """(ask, turn, score, id, rank): each ring's first k rows of the same label, or of others.

        ``asks``: ask, v, own (an id that is not returned), label, rings (array of turn, high, low).
        """
        n = asks.count()
        best = Window.partitionBy("ask", "turn").orderBy(F.desc("score"), "id")
        first = materialize(self._ask(asks, True, k, same, n), "nearest")
        kth = first.withColumn("n", F.row_number().over(best)).filter(F.col("n") == k).select("ask", "turn", F.col("score").alias("least"))
        rings = asks.select("ask", F.explode("rings").alias("r")).select("ask", "r.*").join(kth, ["ask", "turn"], "left")
        rings = rings.withColumn("low", F.greatest("low", F.coalesce("least", "low")))
        rings = rings.groupBy("ask").agg(F.sort_array(F.collect_list(F.struct("turn", "high", "low"))).alias("rings"))
        more = self._ask(asks.drop("rings").join(rings, "ask"), False, k, same, n)
        found = first.unionByName(more)
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def mine(
    df: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 5,
    percent: int = 80,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
    sample: int = 131_072,
) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Each component x becomes floor(scale * x); scores are integer inner products. An anchor's positives are its first
    ``positives`` other rows of the same label; for each, the first ``negatives`` rows of other labels whose score is from
    ``percent`` % of the positive's to all of it. First means highest score, then least id. Rows with a null id or label,
    a null vector, one of another length than most, one with null or non-finite components, or one whose
    squared integer norm is beyond 2**62 take no part. Rows equal in id, vector and label are one; an id never meets itself;
    an id that repeats with another vector or label is an anchor for each. Anchors without positives, and rings without
    rows, give no rows; an empty frame gives an empty one. Other columns are ignored.
    """
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 4e9 / scale))
    rows = df.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("x"), is_anchor.alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.withColumn("v", F.transform("x", lambda c: F.floor(c * scale).cast("long"))).drop("x")
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    rows = materialize(rows.filter(square < float(FAR)), "vectors")
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    rows = rows.filter(F.size("v") == (lengths[0].d if lengths else 0))
    index = Index(materialize(points_of(rows, max(positives, negatives)), "points"), sample)
    asks = rows.filter(F.coalesce("asks", F.lit(False))).select(F.col("id").alias("own"), "label", "v").distinct()
    asks = materialize(asks.withColumn("ask", F.monotonically_increasing_id()), "anchors")
    every = F.array(F.struct(F.lit(0).alias("turn"), F.lit(FAR).alias("high"), F.lit(-FAR).alias("low")))
    near = index.search(asks.withColumn("rings", every), positives, True)
    near = materialize(near.select("ask", F.col("rank").alias("turn"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    score = F.col("positive_score")
    ring = F.struct("turn", score.alias("high"), F.expr(f"({percent} * positive_score + 99) div 100").alias("low"))
    rings = near.filter(score >= 0).groupBy("ask").agg(F.sort_array(F.collect_list(ring)).alias("rings"))
    far = index.search(asks.join(rings, "ask"), negatives, False)
    out = far.join(near, ["ask", "turn"]).join(broadcast_if_small(asks.select("ask", "own")), "ask")
    return out.select(F.col("own").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
