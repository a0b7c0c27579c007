"""N-gram Jaccard join: MinHash buckets, Bayesian pruning on growing signatures, exact verification.

Documents with the same set of shingles are one class from the start and are represented once. Signatures of
representatives give buckets; a pair is looked at in the first bucket that it shares. Pairs of small buckets
become rows. A large bucket is cut into blocks, and a task compares two blocks and keeps counts and one tree
of links, so that nothing grows with the square of a bucket but the comparing itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, free_name, materialize, words
from .components import connected
from .token_store import Recent

#: Signature: BANDS buckets of ROWS values each. At similarity 0.8 all buckets differ once in 20 million pairs.
ROWS, BANDS = 4, 32
HASHES = ROWS * BANDS
#: Values compared between two looks at the posterior.
STEP = 32
#: Members of a bucket whose pairs become rows, and of a block of a larger one.
SMALL, BLOCK = 32, 512
#: Distinct words that each of a Python worker's two generations keeps.
CACHE = 50_000

_RNG = np.random.default_rng(20_240_601)
_MUL = (_RNG.integers(0, 1 << 31, HASHES, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


@lru_cache(maxsize=1)
def _words() -> Recent:
    return Recent(CACHE)


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of n words; a shorter text is one run, an empty one none."""
    ws = words(text)
    if not ws:
        return np.zeros(0, np.uint64)
    seen = _words()
    got = list(map(seen.get, ws))
    if None in got:
        for w in seen.absent(set(ws)):
            seen[w] = xxhash.xxh3_64_intdigest(w)
        got = list(map(seen.get, ws))
    h = np.array(got, np.uint64)
    size = max(1, len(h) - n + 1)
    s = np.full(size, min(n, len(h)), np.uint64)
    for k in range(min(n, len(h))):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[k : k + size]
    s ^= s >> np.uint64(30)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(29)
    return np.unique(s)


def minhash(s: np.ndarray) -> np.ndarray:
    """HASHES minima of the shingles' hashes under as many multiply-add-shift functions, of each the low 16 bits.

    Minima are small, so low bits tell them apart; two that differ agree in them once in 65,536 times, which only
    lets a pair through to exact verification.
    """
    low = (s >> np.uint64(32)).astype(np.uint32)
    sig = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 512):
        m = low[i : i + 512, None] * _MUL + _ADD
        m ^= m >> np.uint32(15)
        np.minimum(sig, m.min(0), out=sig)
    return sig.astype(np.uint16)


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For STEP, 2 STEP, ... compared values: the fewest equal ones at which a pair stays.

    With a uniform prior, m equal values of n leave Beta(m + 1, n - m + 1); a pair goes when the chance that its
    similarity reaches ``threshold`` is under ``tolerance``.
    """
    x = (np.arange(200_000) + 0.5) / 200_000
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            logs = m * np.log(x) + (n - m) * np.log1p(-x)
            p = np.exp(logs - logs.max())
            if p[x >= threshold].sum() >= tolerance * p.sum():
                out.append(m)
                break
    return tuple(out)


def likely(a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Which rows of two signature matrices stay likely pairs, comparing STEP further values at a time."""
    left = np.arange(len(a))
    equal = np.zeros(len(a), np.int32)
    for k, least in enumerate(least_matches(threshold, tolerance)):
        cut = slice(k * STEP, (k + 1) * STEP)
        equal = equal + (a[left, cut] == b[left, cut]).sum(1, dtype=np.int32)
        stay = equal >= least
        left, equal = left[stay], equal[stay]
    return left


def bands(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    s = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), s.shape[:2]).copy()
    for k in range(ROWS):
        key = key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, k]
        key ^= key >> np.uint64(32)
    return key


def first_band(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first band that is equal in each row of two signature matrices; BANDS if none is."""
    same = (a.reshape(-1, BANDS, ROWS) == b.reshape(-1, BANDS, ROWS)).all(2)
    return np.where(same.any(1), same.argmax(1), BANDS)


def _matrix(column, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype).reshape(-1, width) if len(column) else np.zeros((0, width), dtype)


def _overlaps(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of sets rows[i] with sets cols[j], for all i and j."""
    used = np.unique(np.concatenate([rows, cols]))
    at = np.full(len(sets), -1)
    at[used] = np.arange(len(used))
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    values, column, counts = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    out = np.zeros((len(rows), len(cols)), np.float32)
    shared = np.flatnonzero(counts > 1)  # a shingle of one set is in no intersection of two
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, len(shared), 4096):
        i, j = np.searchsorted(column, (low, low + 4096))
        part = np.zeros((len(used), min(4096, len(shared) - low)), np.float32)
        part[owner[i:j], column[i:j] - low] = 1
        out += part[at[rows]] @ part[at[cols]].T
    return out


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def compare_blocks(group: pd.DataFrame, threshold: float, tolerance: float) -> pd.DataFrame:
    """Links between two blocks (or within one) of a bucket: for each member its links and a neighbour in a tree.

    Only pairs whose first common band is this bucket's count here; the tree has one edge less than a
    connected set of members has members.
    """
    empty = pd.DataFrame({"a": [], "b": [], "n": []}).astype({"n": "int64"})
    if not len(group):
        return empty
    band, first, second = int(group["band"].iloc[0]), int(group["i"].iloc[0]), int(group["j"].iloc[0])
    sig = _matrix(group["sig"], np.uint16, HASHES)
    sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
    size = np.array([len(x) for x in sets])
    copies = group["copies"].to_numpy()
    block = group["block"].to_numpy()
    rows = np.flatnonzero(block == first)
    cols = np.flatnonzero(block == second)
    links = np.zeros(len(group), np.int64)
    parent = list(range(len(group)))
    tree = []
    for low in range(0, len(rows), 32):
        part = rows[low : low + 32]
        x, y = np.repeat(part, len(cols)), np.tile(cols, len(part))
        if first == second:
            keep = x < y
            x, y = x[keep], y[keep]
        keep = first_band(sig[x], sig[y]) == band
        x, y = x[keep], y[keep]
        keep = likely(sig[x], sig[y], threshold, tolerance)
        x, y = x[keep], y[keep]
        if not len(x):
            continue
        r, c = np.unique(x), np.unique(y)
        both = _overlaps(sets, r, c)[np.searchsorted(r, x), np.searchsorted(c, y)]
        keep = both >= threshold * (size[x] + size[y] - both) - 1e-6
        x, y = x[keep], y[keep]
        links += np.bincount(x, copies[y], len(group)).astype(np.int64) + np.bincount(y, copies[x], len(group)).astype(np.int64)
        for p, q in zip(x.tolist(), y.tolist(), strict=True):
            u, v = _root(parent, p), _root(parent, q)
            if u != v:
                parent[u] = v
                tree.append((p, q))
    rep = group["rep"].to_numpy()
    some = np.flatnonzero(links)
    counts = pd.DataFrame({"a": rep[some], "b": None, "n": links[some]})
    edges = pd.DataFrame({"a": [rep[p] for p, _ in tree], "b": [rep[q] for _, q in tree], "n": 0})
    return pd.concat([x for x in (counts, edges) if len(x)], ignore_index=True) if len(some) else empty


def jaccard_classes(df: DataFrame, key: str, text: str, threshold: float = 0.8, n: int = 5, tolerance: float = 1e-6) -> DataFrame:
    """jaccard_join with the columns key, th (the text's xxhash64), root (a class's name; null without words)."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("th", F.xxhash64("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                reps, sigs = [], []
                _words().turn()
                for t in part.column(1).to_pylist():
                    s = shingles(t, n)
                    reps.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sigs.append(minhash(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(reps, pa.binary()), pa.array(sigs, pa.binary())], names=["key", "th", "rep", "sig"])

    kind = rows.schema["key"].dataType.simpleString()
    signed = materialize(rows.mapInArrow(sign, f"key {kind}, th long, rep binary, sig binary"), "signatures")
    reps = materialize(
        signed.filter(F.col("rep").isNotNull()).groupBy("rep").agg(F.count("*").alias("copies"), F.min("key").alias("least"), F.min("th").alias("th"), F.min("sig").alias("sig")),
        "representatives",
    )

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keys = bands(_matrix(part.column(1).to_pylist(), np.uint16, HASHES))
                count = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.tile(np.arange(BANDS, dtype=np.int32), count)),
                        pa.array(keys.view(np.int64).ravel()),
                        part.column(0).take(pa.array(np.repeat(np.arange(count), BANDS))),
                    ],
                    names=["band", "bucket", "rep"],
                )

    members = reps.select("rep", "sig").mapInArrow(buckets, "band int, bucket long, rep binary")
    # the key names the band; counting first leaves only buckets of two or more to be joined
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).filter(F.col("size") > 1)
    shared = materialize(members.join(sizes, "bucket"), "buckets")
    small, large = shared.filter(F.col("size") <= SMALL), shared.filter(F.col("size") > SMALL)
    in_large = large.groupBy("rep").agg(F.sum(F.expr("shiftleft(1L, band)")).alias("large"))

    # small buckets: each pair once
    grouped = small.groupBy("bucket").agg(F.sort_array(F.collect_list("rep")).alias("m"))
    left = grouped.select("m", F.posexplode("m").alias("at", "a"))
    pairs = left.select("a", F.explode(F.slice("m", F.col("at") + 2, F.size("m"))).alias("b")).distinct()
    known = reps.select("rep", "sig", "copies", "th").join(in_large, "rep", "left")

    def side(name: str) -> DataFrame:
        return known.select(F.col("rep").alias(name), F.col("sig").alias(f"sig_{name}"), F.coalesce("large", F.lit(0)).alias(f"large_{name}"))

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            x, y = (_matrix(get[f"sig_{s}"].to_pylist(), np.uint16, HASHES) for s in "ab")
            both = get["large_a"].to_numpy() & get["large_b"].to_numpy()
            elsewhere = (both >> first_band(x, y).clip(max=BANDS - 1)) & 1 == 1  # a large bucket has this pair first
            keep = likely(x, y, threshold, tolerance)
            keep = pa.array(keep[~elsewhere[keep]])
            yield pa.RecordBatch.from_arrays([get["a"].take(keep), get["b"].take(keep)], names=["a", "b"])

    near = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(prune, "a binary, b binary")
    near = materialize(near, "near-pairs")

    # the texts of the representatives that are still needed are shingled again
    needed = near.select(F.explode(F.array("a", "b")).alias("rep")).union(large.select("rep")).distinct()
    wanted = known.select("rep", "copies", "th").join(needed, "rep", "left_semi")
    hashes = broadcast_if_small(materialize(wanted.select("th").distinct(), "needed-texts"))
    own = rows.select("text", "th").join(hashes, "th", "left_semi").dropDuplicates(["th"])

    def resign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                _words().turn()
                found = [shingles(t, n).tobytes() for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(found, pa.binary())], names=["th", "shingles"])

    sets = materialize(own.select("text", "th").mapInArrow(resign, "th long, shingles binary").join(wanted, "th").select("rep", "copies", "shingles"), "shingles")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            keep = []
            for i, (p, q) in enumerate(zip(get["set_a"].to_pylist(), get["set_b"].to_pylist(), strict=True)):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= threshold * (len(x) + len(y) - both) - 1e-9:
                    keep.append(i)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([get[c].take(keep) for c in ("a", "b", "n_a", "n_b")], names=["a", "b", "n_a", "n_b"])

    def full(name: str) -> DataFrame:
        return sets.select(F.col("rep").alias(name), F.col("shingles").alias(f"set_{name}"), F.col("copies").alias(f"n_{name}"))

    checked = near.join(full("a"), "a").join(full("b"), "b").mapInArrow(verify, "a binary, b binary, n_a long, n_b long")
    one_by_one = checked.select(F.explode(F.array(F.struct("a", "b", F.col("n_b").alias("n")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_a").alias("n")))).alias("x")).select("x.*")

    # large buckets: two blocks a task
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = large.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep", "band"), F.col("blocks")).cast("int"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = other.select("bucket", "band", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep")
    data = sets.join(reps.select("rep", "sig"), "rep")
    compared = dealt.join(data, "rep").groupBy("bucket", "i", "j").applyInPandas(lambda g: compare_blocks(g, threshold, tolerance), "a binary, b binary, n long")

    links = materialize(one_by_one.unionByName(compared), "links")
    root = connected(links.filter(F.col("b").isNotNull()).select("a", "b"))
    counted = links.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    classed = reps.select("rep", "copies", "least").join(root.withColumnRenamed("node", "rep"), "rep", "left").join(counted, "rep", "left")
    classed = classed.withColumn("root", F.coalesce("root", "rep"))
    least = classed.groupBy("root").agg(F.min("least").alias("class_id"))
    final = classed.join(least, "root").select("rep", "root", "class_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    joined = signed.select("key", "th", "rep").join(final, "rep", "left")
    own = F.when(F.col("rep").isNull(), F.col("key")).otherwise(F.col("class_id"))
    return joined.select("key", "th", "root", own.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_join(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, n: int = 5, tolerance: float = 1e-6) -> DataFrame:
    """One row for each row of ``df``: its key, ``class_id`` and ``n_links``.

    Two rows are linked if the Jaccard similarity of their sets of ``n``-word shingles is at least
    ``threshold``. class_id is the least key among all rows that links lead to, n_links the number of other
    rows linked. Rows with equal sets (copies, repeated rows) are linked to each other; null keys are allowed
    and never name a class that has another key. Texts null or without words are linked to nothing and are
    their own class. An empty frame gives an empty frame; other columns are ignored.
    """
    found = jaccard_classes(df, key, text, threshold, n, tolerance)
    return found.select(F.col("key").alias(key), "class_id", "n_links")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """``df`` with one row of each class: the one with the least key, then the least hash of its text.

    Null keys count as greater than all others. Of repeated rows one stays. Texts without words are no copies of
    each other and all stay.
    """
    found = materialize(jaccard_classes(df, key, text, threshold).filter(F.col("root").isNotNull()).select("key", "th", "root"), "classes")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "th")).alias("x")).select("x.key", "x.th")
    k, h = (free_name(df, x) for x in ("cf_key", "cf_hash"))
    other = found.alias("f").join(first.alias("g"), F.expr("f.key <=> g.key and f.th = g.th"), "left_anti")
    gone = broadcast_if_small(materialize(other.select(F.col("key").alias(k), F.col("th").alias("_" + h)).distinct(), "gone"))
    hashed = df.withColumn(h, F.xxhash64(text))
    out = hashed.join(gone, F.col(key).eqNullSafe(F.col(k)) & (F.col(h) == F.col("_" + h)), "left_anti")
    # rows that repeat in key and text, if any: one of each stays, by partial aggregation
    again = materialize(found.groupBy("key", "th").count().filter("count > 1").select(F.col("key").alias(k), F.col("th").alias("_" + h)), "repeated")
    if not again.isEmpty():
        again = broadcast_if_small(again)
        same = F.col(key).eqNullSafe(F.col(k)) & (F.col(h) == F.col("_" + h))
        out = out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates([key, h]))
    return out.drop(h)
