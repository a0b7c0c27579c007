"""Toxicity by subword bags: character n-gram embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, sigmoid, table, train_bucket, with_scores, words

#: Distinct words of which a Python worker starts anew.
CACHE = 300_000
#: Bytes of words whose n-grams are hashed together.
PORTION = 1 << 14
#: Entries of bags that are added up at once.
AT_ONCE = 1 << 19
#: Words of no meaning that every text has besides its own, so that a few words alone decide little.
NEUTRAL = 15


def short_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """xxh3_64 of data[start:end] for each pair, of one byte or more; ``data`` ends with four bytes that no pair has.

    Up to eight bytes are hashed together, by the hash's formulas for such lengths; others by the library.
    """
    size = end - start
    out = np.empty(len(size), np.uint64)
    quads = np.ascontiguousarray(data[:-3]).astype(np.uint64)
    for k in (1, 2, 3):
        quads |= data[k : len(data) - 3 + k].astype(np.uint64) << np.uint64(8 * k)
    for few, at in ((True, size <= 3), (False, (size >= 4) & (size <= 8))):
        if at.all():
            at = slice(None)
        s, e, n = start[at], end[at], size[at].astype(np.uint64)
        if few:
            x = data[s].astype(np.uint64) << np.uint64(16) | data[s + (e - s >> 1)].astype(np.uint64) << np.uint64(24) | data[e - 1] | n << np.uint64(8)
            x ^= np.uint64(0x87275A9B)
            x = (x ^ x >> np.uint64(33)) * np.uint64(0xC2B2AE3D27D4EB4F)
            x = (x ^ x >> np.uint64(29)) * np.uint64(0x165667B19E3779F9)
            out[at] = x ^ x >> np.uint64(32)
        else:
            x = (quads[e - 4] | quads[s] << np.uint64(32)) ^ np.uint64(0xC73AB174C5ECD5A2)
            x ^= (x << np.uint64(49) | x >> np.uint64(15)) ^ (x << np.uint64(24) | x >> np.uint64(40))
            x *= np.uint64(0x9FB21C651E98DF25)
            x = (x ^ (x >> np.uint64(35)) + n) * np.uint64(0x9FB21C651E98DF25)
            out[at] = x ^ x >> np.uint64(28)
    for i in np.flatnonzero(size > 8).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return out


def grams(found: list[bytes], low: int, high: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of each word in angle brackets, then the word itself; and how many each word has."""
    marked = f"<{b'\n'.join(found).decode('utf-8', 'replace').lower().replace('\n', '>\n<')}>"
    data = np.frombuffer(marked.encode() + bytes(4), np.uint8)
    begin = np.append(np.flatnonzero((data[:-4] & 0xC0) != 0x80), len(data) - 4)  # of characters
    cut = np.flatnonzero(data[begin[:-1]] == 10)
    first = np.append(0, cut + 1)
    chars = np.append(cut, len(begin) - 1) - first
    sizes = sum(np.maximum(chars - n + 1, 0) for n in range(low, high + 1)) + 1
    to = np.cumsum(sizes) - sizes
    ids = np.empty(int(sizes.sum()), np.int64)
    ids[to + sizes - 1] = [xxhash.xxh3_64_intdigest("=" + w) % buckets for w in marked.split("\n")]
    for n in range(low, high + 1):
        count = np.maximum(chars - n + 1, 0)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(first, count) + step
        ids[np.repeat(to, count) + step] = short_hashes(data, begin[at], begin[at + n]) % np.uint64(buckets)
        to = to + count
    return ids, sizes


def portions(found: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Words in lists of about PORTION bytes."""
    part, size = [], 0
    for w in found:
        part.append(w)
        size += len(w)
        if size >= PORTION:
            yield part
            part, size = [], 0
    if part:
        yield part


@dataclass
class SubwordModel:
    """Embeddings of n-gram buckets, softmax weights, and what a text's average is called with.

    ``weight`` has, for each bucket, the embedding's part of the log odds: averaging and softmax are linear, so
    a word's part is the mean of its buckets' and a text's the mean of its words'.
    """

    low: int
    high: int
    weight: np.ndarray
    bias: float
    scale: float
    seen: dict[bytes, float] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"seen": {}}

    def learn(self, new: Iterable[bytes]) -> None:
        """The mean weight of each new word's n-grams."""
        for part in portions(new):
            ids, sizes = grams(part, self.low, self.high, len(self.weight))
            means = np.add.reduceat(self.weight[ids], np.cumsum(sizes) - sizes) / sizes
            self.seen.update(zip(part, means.tolist(), strict=True))

    def scores(self, texts: list[str | None]) -> list[float]:
        """P(toxic) of each text. A text without words has the bias alone."""
        counts = [Counter(words(t)) for t in texts]
        seen = self.seen
        if len(seen) >= CACHE:
            seen.clear()
        self.learn(filterfalse(seen.__contains__, set().union(*counts)))
        odds = np.full(len(texts), self.bias)
        for i, own in enumerate(counts):
            if own:
                times = np.sqrt(np.fromiter(own.values(), float, len(own)))
                parts = np.fromiter(map(seen.__getitem__, own), float, len(own))
                odds[i] += self.scale * float(times @ parts) / (float(times.sum()) + NEUTRAL)
        return sigmoid(odds).tolist()

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]


def bag(text: str | None, low: int, high: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and the part of its average that each has."""
    counts = Counter(words(text))
    if not counts:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    times = np.sqrt(np.fromiter(counts.values(), float, len(counts)))
    got, sizes = (np.concatenate(x) for x in zip(*(grams(part, low, high, buckets) for part in portions(counts)), strict=True))
    own, back = np.unique(got, return_inverse=True)
    part = np.bincount(back, np.repeat(times / (times.sum() + NEUTRAL) / sizes, sizes))
    return own.astype(np.int32), part.astype(np.float32)


def added(at: np.ndarray, weights: Callable[[slice], np.ndarray], size: int) -> np.ndarray:
    """bincount of weights that are made AT_ONCE at a time."""
    out = np.zeros(size)
    for i in range(0, len(at), AT_ONCE):
        cut = slice(i, i + AT_ONCE)
        out += np.bincount(at[cut], weights(cut), size)
    return out


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], low: int = 3, high: int = 5, buckets: int = 1 << 17, dim: int = 4, least: int = 5, epochs: int = 40, rate: float = 1.0, decay: float = 1e-4, seed: int = 7) -> SubwordModel:
    """Embeddings and softmax weights together, by gradient steps with momentum over the whole sample of ``bag``s.

    The list of bags is emptied, so that the driver does not hold them twice.

    Every text is the average of its words (by the root of their counts, so that a text of one word
    repeated has no extreme average), every word the average of its n-grams; the classes weigh alike.
    Buckets that fewer than ``least`` texts use stay zero: they would only learn single texts by heart. Without
    examples of both classes, or without common n-grams, the model knows the share of toxic texts only.
    """
    y = np.array(labels, float)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    flat = SubwordModel(low, high, np.zeros(buckets), float(np.log(prior / (1 - prior))), 1.0)
    if not len(y) or y.min() == y.max():
        return flat
    uses = np.zeros(buckets, np.int32)
    for own, _ in bags:
        uses[own] += 1
    # only common buckets are kept, in 12 bytes an entry; the bags go as they are read
    used = np.flatnonzero(uses >= least)
    place = np.full(buckets, -1, np.int32)
    place[used] = np.arange(len(used))
    sizes = [int((place[own] >= 0).sum()) for own, _ in bags]
    ids, part = np.empty(sum(sizes), np.int32), np.empty(sum(sizes), np.float32)
    row, at = np.repeat(np.arange(len(bags), dtype=np.int32), sizes), len(ids)
    while bags:
        own, own_part = bags.pop()
        own = place[own]
        at -= sizes[len(bags)]
        ids[at : at + sizes[len(bags)]], part[at : at + sizes[len(bags)]] = own[own >= 0], own_part[own >= 0]
    if not len(ids):
        return flat
    # frequent n-grams weigh less, by a smooth inverse of their share; texts have mean length one
    share_of = added(ids, lambda cut: part[cut], len(used)) / len(y)
    rarity = (1e-4 / (1e-4 + share_of)).astype(np.float32)
    part *= rarity[ids]
    scale = float(len(y) / np.sqrt(added(row, lambda cut: part[cut] ** 2, len(y))).sum())
    part *= np.float32(scale)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.01, (len(used), dim)).astype(np.float32)
    out = rng.normal(0, 1, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())[:, None]
    target = np.stack([1 - y, y], 1)
    speed = [np.zeros_like(p) for p in (emb, out, bias)]

    def sums(at: np.ndarray, rows: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
        return np.stack([added(at, lambda cut: part[cut] * rows[of[cut], k], size) for k in range(dim)], 1)

    for _ in range(epochs):
        avg = sums(row, emb, ids, len(y))
        z = avg @ out + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        dz = (p - target) * share
        demb = sums(ids, (dz @ out.T).astype(np.float32), row, len(used)) + decay * emb
        for value, move, grad in zip((emb, out, bias), speed, (demb, avg.T @ dz + decay * out, dz.sum(0)), strict=True):
            move *= 0.9
            move -= rate * grad
            value += move
    weight = np.zeros(buckets)
    weight[used] = rarity * (emb @ (out[:, 1] - out[:, 0]))
    return SubwordModel(low, high, weight, float(bias[1] - bias[0]), scale)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", most: int = 3000, low: int = 3, high: int = 5, buckets: int = 1 << 17) -> SubwordModel:
    """A model from at most ``most`` labelled texts, half of each class: those with the least hash of their id.

    That is a bounded sample; all else covers all rows. The chosen labels go to the texts by broadcast; a label is 0
    or 1, others are left out. Tasks turn the whole texts into bags, so that the driver gets numbers only, ``buckets``
    entries a text at most.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    half = [known.filter(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(most // 2) for y in (0, 1)]
    chosen = half[0].unionByName(half[1])
    found = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [bag(t, low, high, buckets) for t in batch.column(3).to_pylist()]
            own, part = ([b[i].tobytes() for b in got] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.binary()), pa.array(part, pa.binary())], names=["k", "h", "y", "own", "part"])

    kind = found.schema["k"].dataType.simpleString()
    rows = found.select("k", F.xxhash64("t").alias("h"), "y", "t").mapInArrow(bags, f"k {kind}, h long, y int, own binary, part binary")
    # an id's texts count once each label; what is read, a partition at a time, is as many rows as labels were chosen
    one = materialize(rows, "bags").groupBy("k", "y").agg(F.min(F.struct("h", "own", "part")).alias("x"))
    labels_, sample = [], []
    for r in one.orderBy(F.xxhash64("k"), "k", "y").select("y", "x.own", "x.part").toLocalIterator():
        labels_.append(r.y)
        sample.append((np.frombuffer(bytes(r.own), np.int32), np.frombuffer(bytes(r.part), np.float32)))
    return train(sample, labels_, low, high, buckets)


def score(df: DataFrame, model: SubwordModel, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``df`` with ``score`` (P(toxic)) and ``predicted`` (1 from ``threshold``).

    Null and empty texts have the score of a text without words. Rows are scored one by one: repeated rows and
    ties get equal scores, an empty frame stays empty, and input columns named like a result are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the number of buckets

    def fn(texts: list[str | None]) -> dict[str, list]:
        found = shared.value.scores(texts)
        return {"score": found, "predicted": [int(s >= threshold) for s in found]}

    return with_scores(df, text, fn, {"score": "double", "predicted": "int"})


def trained(spark, sf_dir: str, docs: DataFrame) -> SubwordModel:
    """The production model: fitted to the labels outside the held-out third."""
    labels = table(spark, sf_dir, "labels").filter(train_bucket("doc_id", 3) != 1)
    return fit(docs, labels)
