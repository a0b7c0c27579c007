"""Packing of token ids into sequences of one size, as a cutting-stock problem.

Documents longer than a sequence fill whole sequences first; what is left of each is an item. Items are counted by classes
of length (a histogram of at most some hundred classes, whatever the corpus). A linear program over patterns, the ways to
fill a sequence with classes, is solved by column generation: the classes' prices are the program's duals, and a knapsack by
dynamic programming finds the patterns that are worth more than a sequence. The program's counts are rounded down, and the few
items that remain fill sequences one by one. Then items are ranked within their class, and each rank has its place in a pattern.
"""

from __future__ import annotations

import gc
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .token_store import word_coder

#: Lengths up to 2 ** (FINE + 1) are classes of their own; longer ones share a class with those that differ by under 1 / 2 ** FINE.
FINE = 7
#: Items of a class that one task ranks, about.
SLICE = 50_000

Pattern = dict[int, int]


def length_class(length: Column) -> Column:
    """The class of a length, which is the greatest length in it."""
    bits = F.length(F.bin(length)) - 1
    step = F.pow(F.lit(2.0), F.greatest(bits - FINE, F.lit(0))).cast("long")
    return (F.ceil(length / step) * step).cast("long")


def knapsack(widths: np.ndarray, prices: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: the greatest value of items with total width up to c, each as often as wanted; last[c]: an item of it, or -1."""
    own = np.flatnonzero(prices > 1e-12)
    own = own[np.argsort(widths[own], kind="stable")]
    w, p = widths[own], prices[own]
    fitting = np.searchsorted(w, np.arange(size + 1), side="right")
    best, last = np.zeros(size + 1), np.full(size + 1, -1)
    for c in range(1, size + 1):
        best[c] = best[c - 1]
        n = fitting[c]
        if n:
            values = best[c - w[:n]] + p[:n]
            i = values.argmax()
            if values[i] > best[c] + 1e-12:
                best[c], last[c] = values[i], own[i]
    return best, last


def _read(last: np.ndarray, widths: np.ndarray, c: int) -> Counter:
    """The items of best[c]."""
    found: Counter = Counter()
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            found[int(last[c])] += 1
            c -= int(widths[last[c]])
    return found


def fullest(widths: np.ndarray, left: Counter, size: int) -> Counter:
    """The items of ``left`` that fill a sequence best with the widest one in it: reachable sums as the bits of a number."""
    widest = max(left, key=lambda i: widths[i])
    room, want = size - int(widths[widest]), (1 << size - int(widths[widest]) + 1) - 1
    reach, steps = 1, []
    for i in sorted(left, key=lambda i: -widths[i]):
        have, w, times = left[i] - (i == widest), int(widths[i]), 1
        have = min(have, room // w)
        while have > 0:
            n = min(times, have)
            steps.append((i, n, reach))
            reach |= (reach << n * w) & want
            have, times = have - n, times * 2
        if reach >> room & 1:
            break
    at, found = reach.bit_length() - 1, Counter({widest: 1})
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            found[i] += n
            at -= n * int(widths[i])
    return found


def start(widths: np.ndarray, demand: np.ndarray, size: int) -> tuple[list[Pattern], np.ndarray, np.ndarray]:
    """A basis to begin with, its inverse, and how often each of its patterns is used.

    Each pattern fills a sequence from what is left and is used until a class is used up. Later patterns lack that class, so
    the matrix of patterns by the classes that they use up is triangular.
    """
    m = len(widths)
    rest, copies = demand.astype(float), size // widths
    basis, used, turns = [], [], []
    while len(basis) < m:
        left = Counter({int(i): min(int(np.ceil(rest[i])), int(copies[i])) for i in np.flatnonzero(rest > 0)})
        pattern = fullest(widths, left, size)
        which, times = np.array(list(pattern)), np.array(list(pattern.values()), float)
        amount = (rest[which] / times).min()
        rest[which] -= amount * times
        done = which[rest[which] <= 1e-9]
        rest[done] = 0
        for turn, i in enumerate(done):
            basis.append(dict(pattern) if not turn else {int(i): int(copies[i])})
            used.append(0.0 if turn else amount)
            turns.append(i)
    matrix = np.zeros((m, m))
    for t, pattern in enumerate(basis):
        matrix[list(pattern), t] = list(pattern.values())
    return basis, np.linalg.inv(matrix), np.array(used)


def fractional(widths: np.ndarray, demand: np.ndarray, size: int, gap: float, rounds: int) -> list[tuple[Pattern, float]]:
    """Patterns and how often each is used, in fractions, so that all demand is met with few sequences.

    The revised simplex method. It ends when no pattern is worth over 1 + ``gap`` sequences, which bounds its distance from
    the best, when padding is that small or under a sequence, or after ``rounds`` knapsacks.
    """
    m, least = len(widths), widths @ demand / size
    basis, inverse, used = start(widths, demand, size)
    for _ in range(rounds):
        if used.sum() <= max(least * (1 + gap), np.ceil(least)):
            break
        prices = inverse.sum(0)
        best, last = knapsack(widths, prices, size)
        if best[size] <= 1 + gap:
            break
        # one pattern for each class that it must hold, the most valuable first
        worth = np.where(prices > 0, best[size - widths] + prices, 0.0)
        tried: set = set()
        for i in np.argsort(-worth)[:24]:
            if worth[i] <= 1 + gap / 2:
                break
            pattern = _read(last, widths, size - int(widths[i]))
            pattern[int(i)] += 1
            if (name := tuple(sorted(pattern.items()))) in tried:
                continue
            tried.add(name)
            column = np.zeros(m)
            column[list(pattern)] = list(pattern.values())
            if inverse.sum(0) @ column <= 1 + 1e-9:  # worth no more since the last exchange
                continue
            step = inverse @ column
            ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1.0), np.inf)
            out = int(ratio.argmin())
            if not np.isfinite(ratio[out]):
                continue
            row = inverse[out] / step[out]
            inverse -= np.outer(step, row)
            inverse[out] = row
            amount = ratio[out]
            used = (used - amount * step).clip(min=0)
            used[out] = amount
            basis[out] = dict(pattern)
    return [(p, float(x)) for p, x in zip(basis, used, strict=True) if x > 1e-9]


def patterns(histogram: dict[int, int], size: int, gap: float = 0.002, rounds: int = 400) -> list[tuple[Pattern, int]]:
    """Patterns (class: how many) and the number of sequences of each, which use up the histogram exactly."""
    classes = sorted(histogram)
    widths, demand = np.array(classes, np.int64), np.array([histogram[c] for c in classes], float)
    left: Counter = Counter({i: histogram[c] for i, c in enumerate(classes)})
    chosen: list[tuple[Pattern, int]] = []

    def take(pattern: Pattern, most: int) -> None:
        n = min([most, *(left[i] // a for i, a in pattern.items())])
        if n > 0:
            chosen.append(({classes[i]: a for i, a in pattern.items()}, n))
            for i, a in pattern.items():
                left[i] -= n * a

    solved = fractional(widths, demand, size, gap, rounds) if classes else []
    for pattern, x in solved:
        take(pattern, int(x + 1e-6))
    for pattern, x in sorted(solved, key=lambda s: int(s[1]) - s[1]):
        if x - int(x) > 0.5:
            take(pattern, 1)
    left = +left
    while left:
        pattern = fullest(widths, left, size)
        take(pattern, min(left[i] // a for i, a in pattern.items()))
        left = +left
    return chosen


def encode(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, key: str, text: str) -> DataFrame:
    """(row, doc, n, ids): each document's ids and the end id, in 2 bytes each where the vocabulary allows."""
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_coder(tokenizer, end_id, dtype, False)
        gc.disable()  # no cycles arise here, and the word tables are large
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    coded = coder.encode(part.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(c) // width for c in coded], pa.int64()), pa.array(coded, pa.binary())], names=["doc", "n", "ids"])
        finally:
            gc.enable()

    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc long, n long, ids binary").withColumn("row", F.monotonically_increasing_id())


def _ranked(needs: DataFrame, slices: int) -> tuple[DataFrame, dict[int, int]]:
    """``needs`` (row, class, times) with ``rank``, the items of its class before it, and the items of each class.

    A class is ranked in slices, so that one that a third of all rows are in is many tasks' work.
    """
    cut = needs.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)))
    sums = materialize(cut.groupBy("class", "slice").agg(F.sum("times").alias("items")), "slices")
    before = Window.partitionBy("class").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("class", "slice", F.coalesce(F.sum("items").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("class", "slice").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    ranked = cut.withColumn("inside", F.coalesce(F.sum("times").over(within), F.lit(0))).join(offsets, ["class", "slice"])
    histogram = {r["class"]: r["items"] for r in sums.groupBy("class").agg(F.sum("items").alias("items")).collect()}
    return ranked.select("row", "class", (F.col("offset") + F.col("inside")).alias("rank")), histogram


def _cut_at_powers(pieces: DataFrame, size: int, most_padding: int) -> DataFrame:
    """Sequences that would be padded by over ``most_padding`` become several of lengths that are powers of two."""
    bits = size.bit_length() - 1
    total = F.col("total")
    whole = (total >= size - most_padding) | (total == F.pow(F.lit(2.0), F.length(F.bin(total)) - 1).cast("long"))
    parts = ", ".join(f"struct({b + 1} AS part, (total div {2 << b}) * {2 << b} AS low, (total div {2 << b}) * {2 << b} + (total div {1 << b}) % 2 * {1 << b} AS high)" for b in range(bits))
    uncut = F.expr("array(struct(0 AS part, 0L AS low, total AS high))")
    each = pieces.withColumn("p", F.explode(F.when(whole, uncut).otherwise(F.expr(f"array({parts})"))))
    low, high = F.greatest("offset", "p.low"), F.least(F.col("offset") + F.col("length"), F.col("p.high"))
    cut = each.withColumns({"low": low, "high": high}).filter(F.col("low") < F.col("high"))
    return cut.select(
        "row", (F.col("start") + F.col("low") - F.col("offset")).alias("start"), (F.col("high") - F.col("low")).alias("length"),
        (F.col("seq") * (bits + 1) + F.col("p.part")).alias("sequence_id"), (F.col("low") - F.col("p.low")).alias("offset"),
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    vocabulary: int,
    size: int = 4096,
    most_padding: int = 64,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The pieces of all documents: doc_id (named as the key), start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit integers; ``start`` counts the document's ids before it,
    ``offset`` those of its sequence. A sequence has at most ``size`` ids (a power of two). Only documents longer than
    that are cut, and those of the last sequences, which are cut at powers of two where they would be padded by
    over ``most_padding``. Sequence ids are unique, not dense. Null and empty texts are the end id alone; null and repeated keys are
    documents like others; an empty frame gives an empty one. Other columns are ignored.
    """
    if size & (size - 1):
        raise ValueError("the size of a sequence must be a power of two")
    coded = materialize(encode(docs, tokenizer, end_id, vocabulary, key, text), "ids")
    lengths = coded.select("row", "n")
    rest, full = F.col("n") % size, F.floor(F.col("n") / size).cast("long")
    item = F.when(rest > 0, F.struct(length_class(rest).alias("class"), F.lit(1).cast("long").alias("times")))
    whole = F.when(full > 0, F.struct(F.lit(0).cast("long").alias("class"), full.alias("times")))
    needs = lengths.select("row", F.explode(F.array_compact(F.array(item, whole))).alias("need")).select("row", "need.*")
    ranked, histogram = _ranked(needs, coded.count() // SLICE + 1)
    ranked = materialize(ranked, "ranked")
    histogram.pop(0, None)
    places, begun, sequences = [], Counter(), 0
    for pattern, n in patterns(histogram, size):
        turn = 0
        for c, a in sorted(pattern.items(), reverse=True):
            places.append((c, begun[c], begun[c] + a * n, sequences, a, turn))
            begun[c] += a * n
            turn += a
        sequences += n
    # as many rows as patterns have classes: bounded by the classes, not by the corpus
    slots = docs.sparkSession.createDataFrame(places, "class long, first long, end long, base long, copies long, turn long")
    at = F.col("rank") - F.col("first")
    placed = ranked.filter("class > 0").join(F.broadcast(slots), "class").filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    placed = placed.select("row", (F.col("base") + F.floor(at / F.col("copies"))).alias("seq"), (F.col("turn") + at % F.col("copies")).alias("turn"))
    items = placed.join(lengths, "row").select("row", "seq", "turn", (F.col("n") - rest).alias("start"), rest.alias("length"))
    inside = Window.partitionBy("seq").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    items = items.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).withColumn("total", F.sum("length").over(Window.partitionBy("seq")))
    ends = _cut_at_powers(items, size, most_padding).groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("ends"))
    fulls = ranked.filter("class = 0").select("row", (F.col("rank") + sequences).alias("full"))
    plan = fulls.join(ends, "row", "full_outer").hint("shuffle_hash")
    step, width = size.bit_length(), 2 if vocabulary <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                which, rows = [], []
                for i, (n, full, ends) in enumerate(zip(*(part.column(c).to_pylist() for c in (1, 3, 4)), strict=True)):
                    pieces = [(j * size, size, (full + j) * step, 0) for j in range(n // size)] if full is not None else []
                    pieces += sorted((e["start"], e["length"], e["sequence_id"], e["offset"]) for e in ends or [])
                    which += [i] * len(pieces)
                    rows += pieces
                start, length, sequence, offset = np.array(rows, np.int64).reshape(-1, 4).T
                # pieces in order hold all ids in order, so their ids are those of the batch with other bounds
                ids = np.frombuffer(b"".join(part.column(2).to_pylist()), f"<u{width}").astype("<u4")
                bounds = np.concatenate([[0], np.cumsum(length * 4)]).astype("<i4")
                cut = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(bounds), pa.py_buffer(ids)])
                doc, n = (part.column(c).take(pa.array(which, pa.int64())) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([doc, *map(pa.array, (start, length)), cut, n, *map(pa.array, (sequence, offset))], names=["doc", "start", "length", "ids", "n", "sequence_id", "offset"])

    joined = coded.join(plan, "row").select("doc", "n", "ids", "full", "ends")
    cut = joined.mapInArrow(run, "doc long, start long, length long, ids binary, n long, sequence_id long, offset long")
    return cut.select(F.col("doc").alias(key), "start", "length", "ids", F.col("n").alias("doc_tokens"), "sequence_id", "offset")
