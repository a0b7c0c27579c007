"""Nearest neighbours by inner product: score-aware quantisation, four-bit table scans, exact reranking.

Codes spend more on the part of the residual that is parallel to a vector, since that part moves inner products
with the queries that score it high. Equal vectors are one point with its least ids; points and query
vectors are dealt into blocks of bounded size, and each task scans one block of codes for one block of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Dimensions of a subspace, and codes of each (four bits).
WIDTH, CODES = 2, 16
#: Points of a block, which decide what is found, and distinct query vectors of a block at most and, where tasks are
#: fewer than the session's shuffle partitions, at least; these only deal out the work.
POINT_BLOCK, QUERY_BLOCK, QUERY_LEAST = 16_384, 16_384, 256


@dataclass(frozen=True)
class Quantiser:
    """``books`` (subspaces, CODES, WIDTH); ``parallel`` is how much more the parallel part of a residual weighs."""

    books: np.ndarray
    parallel: float

    @property
    def subspaces(self) -> int:
        return len(self.books)

    def split(self, x: np.ndarray) -> np.ndarray:
        full = np.zeros((len(x), self.subspaces * WIDTH), np.float32)
        full[:, : x.shape[1]] = x
        return full.reshape(len(x), self.subspaces, WIDTH)

    def encode(self, x: np.ndarray, rounds: int = 3) -> np.ndarray:
        """The codes of vectors (n, subspaces), by descent over one subspace at a time.

        The loss of a vector is its squared residual, plus ``parallel`` - 1 times the square of the residual's
        component along the vector.
        """
        parts = self.split(x)
        unit = parts / np.linalg.norm(parts.reshape(len(x), -1), axis=1).clip(min=1e-30)[:, None, None]
        gap = parts[:, :, None, :] - self.books[None]
        square = (gap**2).sum(3)
        along = (gap * unit[:, :, None, :]).sum(3)
        codes = square.argmin(2)
        each = np.arange(len(x))
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(rounds):
            for m in range(self.subspaces):
                rest = total - along[each, m, codes[:, m]]
                loss = square[:, m] + (self.parallel - 1) * (rest[:, None] + along[:, m]) ** 2
                codes[:, m] = loss.argmin(1)
                total = rest + along[each, m, codes[:, m]]
        return codes.astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.books[np.arange(self.subspaces), codes].reshape(len(codes), -1)


def train(x: np.ndarray, threshold: float = 0.2, rounds: int = 8, seed: int = 5) -> Quantiser:
    """Codebooks for a sample of vectors.

    ``threshold``: cosines from which an inner product matters; it sets the weight of the parallel residual to
    (d - 1) t² / (1 - t²). Codes and books are improved in turn; each code's centre solves its own two-by-two
    system with the other subspaces held. An empty sample gives books of zeros.
    """
    d = max(1, x.shape[1])
    eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    m = -(-d // WIDTH)
    empty = Quantiser(np.zeros((m, CODES, WIDTH), np.float32), eta)
    if not len(x):
        return empty
    rng = np.random.default_rng(seed)
    parts = empty.split(x.astype(np.float32))
    books = np.stack([parts[rng.choice(len(x), CODES, replace=len(x) < CODES), k] for k in range(m)])
    q = Quantiser(books, eta)
    unit = parts / np.linalg.norm(parts.reshape(len(x), -1), axis=1).clip(min=1e-30)[:, None, None]
    for _ in range(rounds):
        codes = q.encode(x, rounds=1)
        books = q.books.copy()
        gap = parts - books[np.arange(m), codes]
        along = (gap * unit).sum(2)
        total = along.sum(1)
        for k in range(m):
            rest = total - along[:, k]
            u, v = unit[:, k], parts[:, k]
            for c in range(CODES):
                own = codes[:, k] == c
                if own.any():
                    uo = u[own]
                    left = own.sum() * np.eye(WIDTH) + (eta - 1) * uo.T @ uo
                    right = v[own].sum(0) + (eta - 1) * (uo * (rest[own] + (v[own] * uo).sum(1))[:, None]).sum(0)
                    books[k, c] = np.linalg.solve(left, right)
            along[:, k] = ((v - books[k, codes[:, k]]) * u).sum(1)
            total = rest + along[:, k]
        q = Quantiser(books.astype(np.float32), eta)
    return q


def pack(codes: np.ndarray) -> np.ndarray:
    """Two codes in a byte; an odd last one has 0 beside it."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], 1)
    return codes[:, ::2] << 4 | codes[:, 1::2]


def scan(query: np.ndarray, q: Quantiser, index: np.ndarray) -> np.ndarray:
    """Approximate inner products of one vector with the points whose packed codes, each raised by 256 times its place, are ``index``."""
    table = np.einsum("md,mcd->mc", q.split(query[None])[0], q.books)
    if len(table) % 2:
        table = np.concatenate([table, np.zeros((1, CODES), table.dtype)])
    pairs = (table[::2, :, None] + table[1::2, None, :]).astype(np.float32).ravel()
    return pairs[index].sum(1)


def inner(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the components."""
    out = np.zeros(len(x))
    for d in range(len(query)):
        out += x[:, d] * query[d]
    return out


def search_block(points: pd.DataFrame, queries: pd.DataFrame, q: Quantiser, k: int, rerank: int) -> pd.DataFrame:
    """For each query vector its k first ids among the block's points by (score descending, id)."""
    found: dict[str, list] = {"qkey": [], "score": [], "vec_id": []}
    if len(points) and len(queries):
        x = np.stack(points["v"].to_numpy())
        codes = np.frombuffer(b"".join(points["codes"]), np.uint8).reshape(len(x), -1)
        index = codes.astype(np.int32) + 256 * np.arange(codes.shape[1], dtype=np.int32)
        ids = points["ids"].to_numpy()
        first = np.array([i[0] for i in ids])
        for key, query in zip(queries["qkey"], queries["v"], strict=True):
            best = np.arange(len(x))
            if len(x) > rerank:
                best = np.argpartition(scan(query, q, index), len(x) - rerank)[len(x) - rerank :]
            exact = inner(x[best], query)
            order = np.lexsort((first[best], -exact))[:k]
            entries = sorted((-exact[i], int(n)) for i in order for n in ids[best[i]])[:k]
            found["qkey"] += [key] * len(entries)
            found["score"] += [-s for s, _ in entries]
            found["vec_id"] += [n for _, n in entries]
    return pd.DataFrame(found).astype({"score": "float64", "vec_id": "int64"})


def nearest(
    df: DataFrame,
    is_query,
    k: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    rerank: int = 256,
    sample: int = 4096,
) -> DataFrame:
    """For each row of ``df`` that ``is_query`` (a Column) marks, its k nearest others: query_id, rank, vec_id, score.

    Nearness is the inner product in double precision; ties go to the smaller id. The quantiser is fitted to
    at most ``sample`` distinct vectors (those of least hash); all vectors are indexed, and in each block of
    POINT_BLOCK points the ``rerank`` best by code are scored exactly. Vectors that are null, zero, of another
    length than most, or hold null or non-finite components take no part, nor do rows with a null id; rows
    equal in id and vector count once; a query never finds its own id. Fewer candidates than k give fewer
    rows. An empty frame gives an empty frame. Other columns are ignored.
    """
    spark = df.sparkSession
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v"), is_query.alias("asks")).filter(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = lengths[0].d if lengths else 1
    rows = rows.filter(F.size("v") == dim).withColumn("vkey", F.concat_ws(":", F.xxhash64("v"), F.hash("v")))
    # k + 1 ids of each distinct vector are enough, as one of them may be the query's own
    ids = rows.select("vkey", "id").distinct()
    few = ids.withColumn("n", F.row_number().over(Window.partitionBy("vkey").orderBy("id"))).filter(F.col("n") <= k + 1)
    few = few.groupBy("vkey").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = rows.groupBy("vkey").agg(F.first("v").alias("v"), F.max(F.coalesce("asks", F.lit(False))).alias("asks"))
    points = materialize(distinct.join(few, "vkey"), "points")
    chosen = points.select("v", F.xxhash64("vkey").alias("h"), "vkey").orderBy("h", "vkey").limit(sample).collect()
    model = spark.sparkContext.broadcast(train(np.array([r.v for r in chosen]).reshape(-1, dim)))

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), 2048):
                part = f.iloc[i : i + 2048]
                codes = pack(model.value.encode(np.stack(part["v"].to_numpy())))
                yield part.assign(codes=[c.tobytes() for c in codes])

    index = points.select("vkey", "v", "ids").mapInPandas(encode, "vkey string, v array<double>, ids array<long>, codes binary")
    asking = points.filter("asks").select(F.col("vkey").alias("qkey"), "v")
    n, nq = points.count(), asking.count()
    point_blocks = max(1, -(-n // POINT_BLOCK))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    query_blocks = max(1, -(-nq // QUERY_BLOCK), min(-(-nq // QUERY_LEAST), -(-tasks // point_blocks)))
    left = index.withColumn("i", F.pmod(F.xxhash64("vkey"), F.lit(point_blocks)).cast("int"))
    left = left.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = asking.withColumn("j", F.pmod(F.xxhash64("qkey"), F.lit(query_blocks)).cast("int"))
    right = right.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(point_blocks - 1))))
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(
        lambda p, a: search_block(p, a, model.value, k + 1, rerank), "qkey string, score double, vec_id long"
    )
    place = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("n", F.row_number().over(place)).filter(F.col("n") <= k + 1).drop("n")
    asked = rows.filter("asks").select(F.col("id").alias("query_id"), F.col("vkey").alias("qkey")).distinct()
    own = asked.join(best, "qkey").filter(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id"))
    return own.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
