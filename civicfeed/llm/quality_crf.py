"""Quality by a linear-chain conditional random field over lines, read from neighbouring lines too."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, train_bucket, with_scores

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
#: What one line says of itself.
OWN = ("symbols", "bare", "capitals", "shouting", "seen", "repeats", "stutter", "size", "width", "ended", "letters", "digits", "tiny")
#: A line sees itself, the line before and the line after, and a constant.
WIDTH = 3 * len(OWN) + 1


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """For each line with a word: features with those of its neighbours (lines, WIDTH), and its length in characters."""
    own, sizes, seen = [], [], set()
    for line in (text or "").split("\n"):
        raw = line.encode("utf-8", "surrogatepass")
        ws = raw.split()
        if not ws:
            continue
        n, distinct = len(ws), len(set(ws))
        size = sum(map(len, ws))
        letters = len(raw) - len(raw.translate(None, _LETTERS))
        symbols = len(raw) - len(raw.translate(None, SYMBOLS))
        bare = sum(ws.count(bytes([c])) for c in SYMBOLS) if symbols else 0
        capitals = len(raw) - len(raw.translate(None, _CAPITALS))
        digits = len(raw) - len(raw.translate(None, _DIGITS))
        stutter = sum(map(bytes.__eq__, ws, ws[1:])) if distinct < n else 0
        own.append(
            (
                min(1.0, symbols / n),
                bare / n,
                capitals / max(1, letters),
                min(1.0, raw.count(b"!!") / n),
                float(line in seen),
                1 - distinct / n,
                stutter / n,
                np.log1p(n) / 5,
                min(2.0, size / n / 10),
                float(ws[-1][-1:] in (b".", b"!", b"?")),
                letters / size,
                digits / size,
                float(n <= 3),
            )
        )
        seen.add(line)
        sizes.append(len(line))
    x = np.array(own, np.float32).reshape(-1, len(OWN))
    out = np.zeros((len(x), WIDTH), np.float32)
    out[:, 0] = 1
    out[:, 1 : len(OWN) + 1] = x
    out[1:, len(OWN) + 1 : 2 * len(OWN) + 1] = x[:-1]
    out[:-1, 2 * len(OWN) + 1 :] = x[1:]
    return out, np.array(sizes, np.float64)


@dataclass(frozen=True)
class Chain:
    """``weights`` turn a line's features into its log odds of good; ``moves`` score (bad, good) to (bad, good)."""

    weights: np.ndarray
    moves: np.ndarray
    #: The share of good texts, for texts without lines.
    prior: float


def forward_backward(odds: np.ndarray, moves: np.ndarray, lengths: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line and, where chains have a ``weight``, the weighted expected counts of each move.

    Chains are padded to (chains, lines).

    The score of a labelling is the sum of the odds of its good lines and of its moves.
    """
    b, t = odds.shape
    emit = np.stack([np.zeros_like(odds), odds], 2)
    ahead = np.zeros((b, t, 2))
    behind = np.zeros((b, t, 2))
    ahead[:, 0] = emit[:, 0]
    for i in range(1, t):
        step = np.logaddexp(ahead[:, i - 1, 0, None] + moves[0], ahead[:, i - 1, 1, None] + moves[1]) + emit[:, i]
        ahead[:, i] = np.where((i < lengths)[:, None], step, ahead[:, i - 1])
    for i in range(t - 2, -1, -1):
        later = emit[:, i + 1] + behind[:, i + 1]
        step = np.logaddexp(moves[:, 0] + later[:, 0, None], moves[:, 1] + later[:, 1, None])
        behind[:, i] = np.where((i + 1 < lengths)[:, None], step, 0.0)
    total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    inside = np.arange(t) < lengths[:, None]
    both = ahead + behind
    p = np.where(inside, np.exp(both[:, :, 1] - np.logaddexp(both[:, :, 0], both[:, :, 1])), 0.0)
    counts = np.zeros((2, 2))
    if t > 1 and weight is not None:
        pair = inside[:, 1:]
        for x in (0, 1):
            for y in (0, 1):
                logs = ahead[:, :-1, x] + moves[x, y] + emit[:, 1:, y] + behind[:, 1:, y] - total[:, None]
                counts[x, y] = (np.exp(np.where(pair, logs, -np.inf)).sum(1) * weight).sum()
    return p, counts


def _batches(lengths: np.ndarray, most: int = 20_000) -> Iterator[np.ndarray]:
    """Indices of chains of like length, at most ``most`` padded lines together (a longer chain is alone)."""
    order = np.argsort(lengths, kind="stable")
    start = 0
    for i in range(1, len(order) + 1):
        if i == len(order) or (i - start + 1) * lengths[order[i]] > most:
            yield order[start:i]
            start = i


def line_marginals(chains: list[np.ndarray], model: Chain) -> list[np.ndarray]:
    """P(good) of every line of every text."""
    lengths = np.array([len(c) for c in chains], np.int64)
    out: list[np.ndarray] = [np.zeros(0)] * len(chains)
    some = np.flatnonzero(lengths)
    for group in _batches(lengths[some]):
        group = some[group]
        odds = np.zeros((len(group), int(lengths[group].max())))
        for r, i in enumerate(group):
            odds[r, : lengths[i]] = chains[i] @ model.weights
        p, _ = forward_backward(odds, model.moves, lengths[group])
        for r, i in enumerate(group):
            out[i] = p[r, : lengths[i]]
    return out


def train(chains: list[np.ndarray], labels: list[int], prior: float, rounds: int = 150, decay: float = 1e-3) -> Chain:
    """Maximise the likelihood of every line having its text's label, by Adam on the whole sample; classes weigh alike.

    Without lines of both classes the model has no weights and every line has the prior.
    """
    y = np.array(labels, float)
    lengths = np.array([len(c) for c in chains], np.int64)
    use = np.flatnonzero(lengths)
    even = Chain(np.zeros(WIDTH), np.zeros((2, 2)), prior)
    if not len(use) or y[use].min() == y[use].max():
        w = np.zeros(WIDTH)
        w[0] = np.log(prior / (1 - prior))
        return Chain(w, even.moves, prior)
    share = np.where(y == 1, 0.5 / y[use].sum(), 0.5 / (1 - y[use]).sum())
    groups = []
    for g in _batches(lengths[use]):
        g = use[g]
        t = int(lengths[g].max())
        x = np.zeros((len(g), t, WIDTH), np.float32)
        for r, i in enumerate(g):
            x[r, : lengths[i]] = chains[i]
        groups.append((x, lengths[g], y[g], share[g] / lengths[g]))
    w, moves = np.zeros(WIDTH), np.zeros((2, 2))
    state = [np.zeros(WIDTH), np.zeros(WIDTH), np.zeros((2, 2)), np.zeros((2, 2))]
    for step in range(1, rounds + 1):
        dw, dm = decay * w, decay * moves
        for x, n, label, weight in groups:
            p, counts = forward_backward(x @ w, moves, n, weight)
            inside = np.arange(x.shape[1]) < n[:, None]
            gap = np.where(inside, p - label[:, None], 0.0) * weight[:, None]
            dw += np.einsum("bt,btf->f", gap, x)
            for good in (0, 1):
                counts[good, good] -= (weight * (n - 1))[label == good].sum()
            dm += counts
        for k, (value, grad) in enumerate(((w, dw), (moves, dm))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            value -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Chain(w, moves, prior)


def document_quality(texts: list[str | None], model: Chain) -> list[float]:
    """The mean P(good) of a text's lines, weighted by their lengths; the prior for texts without lines."""
    got = [line_features(t) for t in texts]
    marginals = line_marginals([x for x, _ in got], model)
    return [float((p * n).sum() / n.sum()) if len(n) else model.prior for p, (_, n) in zip(marginals, got, strict=True)]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", most: int = 2000) -> Chain:
    """A model from at most ``most`` labelled texts, half of each class (a bounded sample; those of least id hash)."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    sums = known.agg(F.count("*").alias("n"), F.sum("y").alias("good")).first()
    prior = ((sums.good or 0) + 0.5) / (sums.n + 1)
    half = [known.filter(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(most // 2) for y in (0, 1)]
    found = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(half[0].unionByName(half[1])), "k")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [line_features(t)[0].tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], names=["k", "y", "x"])

    kind = found.schema["k"].dataType.simpleString()
    rows = found.select("k", "y", "t").mapInArrow(features, f"k {kind}, y int, x binary")
    rows = rows.orderBy(F.xxhash64("k"), "k", "y", F.xxhash64("x")).limit(2 * most).collect()
    return train([np.frombuffer(r.x, np.float32).reshape(-1, WIDTH) for r in rows], [r.y for r in rows], prior)


def score(df: DataFrame, model: Chain, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``df`` with ``score`` (quality, 0 to 1) and ``predicted`` (1 from ``threshold``).

    Null, empty and blank texts have the share of good labels. Rows are scored one by one: repeated rows and
    ties get equal scores, an empty frame stays empty, and input columns named like a result are replaced.
    """

    def fn(texts: list[str | None]) -> dict[str, list]:
        found = document_quality(texts, model)
        return {"score": found, "predicted": [int(s >= threshold) for s in found]}

    return with_scores(df, text, fn, {"score": "double", "predicted": "int"})


def trained(spark, sf_dir: str, docs: DataFrame) -> Chain:
    """The production model: fitted to the labels outside the held-out third."""
    return fit(docs, table(spark, sf_dir, "labels").filter(train_bucket("doc_id", 3) != 1))
