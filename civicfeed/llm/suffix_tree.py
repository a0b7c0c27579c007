"""Language-model scoring by a probabilistic suffix tree over bytes, beside a smoothed unigram base.

A text is its words, ASCII lower-cased, each followed by a space, and an end symbol. The tree keeps a context
(the bytes before a symbol) if the symbols after it diverge from those after its suffix by more than chance gives; a
symbol is predicted from the longest kept suffix of what came before. That suffix is part of the last DEPTH bytes, so
the prediction is a function of the window of DEPTH + 1 bytes: the tree is evaluated on Spark, as a table of all windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, train_bucket
from .token_store import Recent

#: The longest context in bytes; a window is a context and its symbol, packed into a long.
DEPTH = 5
#: The symbol at a text's end, which also stands before its first; UTF-8 never has this byte.
END = 0xFF
#: The key of the end token among word keys.
END_KEY = xxhash.xxh3_64_intdigest(b"") - (1 << 63)
#: Most frequent tokens whose counts go to all tasks; the others' counts are joined (about 2 MB).
FREQUENT = 100_000
#: Most frequent windows, at most, whose predictions go to all tasks; the others' are joined (16 MB).
WINDOWS = 1_000_000
#: Words in each of the two generations that a Python worker keeps.
CACHE = 150_000
#: Transitions that a plain tree keeps; symbols of which the windows are looked up at once.
MOVES, AT_ONCE = 1_000_000, 1 << 18
#: Bytes of texts that are split into words at once, and keys that a counting task holds before it hands them on.
SLICE_BYTES, HELD = 1 << 20, 2_000_000
#: Times that a context must occur in what is learnt from, whatever its size.
LEAST = 2


def tokens(text: str | None) -> list[bytes]:
    """The words of a text with A to Z in lower case; the end token is not among them."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def symbols(ws: list[bytes]) -> bytes:
    return b" ".join(ws) + b" \xff" if ws else b"\xff"


def windows(texts: list[bytes]) -> np.ndarray:
    """All windows of DEPTH + 1 bytes that end in a symbol of a text; END stands before each text."""
    pad = bytes([END]) * DEPTH
    data = np.frombuffer(b"".join([pad + t for t in texts]), np.uint8)
    out = np.zeros(max(0, len(data) - DEPTH), np.int64)
    for k in range(DEPTH + 1):
        out <<= 8
        out |= data[k : k + len(out)]
    # a window whose last byte is in the padding of the next text is none
    last = np.ones(len(data), bool)
    at = 0
    for t in texts:
        last[at : at + DEPTH] = False
        at += DEPTH + len(t)
    return out[last[DEPTH:]]


def slices(batch: pa.RecordBatch, column: int, rows: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``rows`` rows and SLICE_BYTES of the texts in a column, or of one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, done = 0, 0
    while at < batch.num_rows:
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, done + SLICE_BYTES, "right"))))
        part = batch.slice(at, end - at)
        at, done = at + part.num_rows, int(ends[at + part.num_rows - 1])
        yield part


class Counts:
    """Counts of long keys: one sorted table, to which new counts are added in place, so that only new keys move it."""

    def __init__(self) -> None:
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        """Count keys, each of them once or ``counts`` times."""
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        else:
            keys, back = np.unique(keys, return_inverse=True)
            counts = np.bincount(back, counts, len(keys)).astype(np.int64)
        at = np.searchsorted(self.keys, keys)
        there = at < len(self.keys)
        there[there] = self.keys[at[there]] == keys[there]
        self.counts[at[there]] += counts[there]
        if not there.all():
            at = at[~there]
            self.keys = np.insert(self.keys, at, keys[~there])
            self.counts = np.insert(self.counts, at, counts[~there])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        return self.keys, self.counts


def count_corpus(texts: DataFrame) -> DataFrame:
    """(kind, key, n): how often each token (kind 0) and each window (kind 1) occurs in the learnt of texts (learns, text).

    Windows that only the others have are there with an n of 0. Each task sums what it reads, in slices; its tables are
    handed on when they have HELD keys, so its memory depends on its longest text alone. Those keys are distinct, so
    they go to the shuffle as they are, not through another table of the task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Counts(), Counts()]

        def out(kind: int) -> Iterator[pa.RecordBatch]:
            keys, counts = found[kind].merged()
            found[kind] = Counts()
            for i in range(0, len(keys), 65_536):
                n = len(keys[i : i + 65_536])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(keys[i : i + n]), pa.array(counts[i : i + n])], names=["kind", "key", "n"])

        for batch in batches:
            for part in slices(batch, 1, 8192):
                split: tuple[list, list] = [], []
                for learns, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    split[learns].append(tokens(t))
                other, learnt = split
                seen: dict[bytes, int] = {}
                for ws in learnt:
                    for w in ws:
                        seen[w] = seen.get(w, 0) + 1
                if learnt:
                    keys = np.fromiter(map(word_key, seen), np.int64, len(seen))
                    found[0].add(np.append(keys, END_KEY), np.append(np.fromiter(seen.values(), np.int64, len(seen)), len(learnt)))
                    found[1].add(windows([symbols(ws) for ws in learnt]))
                if other:
                    keys = np.unique(windows([symbols(ws) for ws in other]))
                    found[1].add(keys, np.zeros(len(keys), np.int64))
                if len(found[0]) + len(found[1]) > HELD:
                    for kind in (0, 1):
                        yield from out(kind)
        for kind in (0, 1):
            yield from out(kind)

    found = texts.mapInArrow(count, "kind int, key long, n long")
    return found.repartition("kind", "key").groupBy("kind", "key").agg(F.sum("n").alias("n"))


@dataclass
class SuffixTree:
    """Kept contexts and what follows them, in one process: the plain form of ``predictions``, for small corpora.

    ``logs`` has the log10 probability of a symbol after a context where that symbol was seen there (key: context
    number << 8 | symbol), ``back`` what is added when it was not and the context's suffix decides.
    """

    contexts: list[bytes]
    keys: np.ndarray
    logs: np.ndarray
    back: np.ndarray
    suffix: np.ndarray
    number: dict[bytes, int] = field(default_factory=dict)
    moves: dict[int, tuple[float, int]] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"number": {}, "moves": {}}

    def start(self) -> int:
        """The state before a text."""
        self.number = self.number or {c: i for i, c in enumerate(self.contexts)}
        return self._longest(bytes([END]) * DEPTH)

    def _longest(self, history: bytes) -> int:
        while history not in self.number:
            history = history[1:]
        return self.number[history]

    def move(self, state: int, symbol: int) -> tuple[float, int]:
        """log10 P(symbol) in a state, and the next state: the longest kept suffix of state and symbol."""
        got = self.moves.get(state << 8 | symbol)
        if got is None:
            if len(self.moves) >= MOVES:
                self.moves.clear()
            at, log = state, 0.0
            while True:
                key = at << 8 | symbol
                i = int(np.searchsorted(self.keys, key))
                if i < len(self.keys) and self.keys[i] == key:
                    log += float(self.logs[i])
                    break
                log += float(self.back[at])
                if at == 0:  # the empty context's back is the probability of an unseen symbol
                    break
                at = int(self.suffix[at])
            got = self.moves[state << 8 | symbol] = (log, self._longest((self.contexts[state] + bytes([symbol]))[-DEPTH:]))
        return got

    def spell(self, w: bytes) -> tuple[tuple[int, ...], tuple[float, ...], int, bytes]:
        """A word as it goes after a text's beginning: the states before its first DEPTH bytes and after them, the
        log10 probability of what is left from each, the state after the word, and those bytes.
        """
        state, total, data = self.start(), 0.0, w + b" "
        states, logs = [state], [0.0]
        for b in data:
            log, state = self.moves.get(state << 8 | b) or self.move(state, b)
            total += log
            states.append(state)
            logs.append(total)
        return tuple(states[: DEPTH + 1]), tuple([total - x for x in logs[: DEPTH + 1]]), state, data[:DEPTH]

    def follow(self, state: int, spelt: tuple[tuple[int, ...], tuple[float, ...], int, bytes]) -> tuple[float, int]:
        """log10 of the probability of a spelt word in a state, and the state after it.

        The past before the word matters until the state is that of the word alone, after DEPTH bytes at the latest;
        from there on what is left is known.
        """
        own, left, after, data = spelt
        if state == own[0]:
            return left[0], after
        total, moves = 0.0, self.moves
        for i, b in enumerate(data, 1):
            log, state = moves.get(state << 8 | b) or self.move(state, b)
            total += log
            if state == own[i]:
                return total + left[i], after
        return total, state

    def score(self, ws: list[bytes]) -> float:
        """log10 of the probability of a text's symbols."""
        state, total = self.start(), 0.0
        for w in ws:
            log, state = self.follow(state, self.spell(w))
            total += log
        return total + self.move(state, END)[0]


def grow(levels: list[dict[bytes, dict[int, int]]], divergence: float, strength: float = 4.0) -> SuffixTree:
    """A tree from the frequent contexts of each length and the counts of what follows them.

    A context is kept if the Kullback-Leibler divergence of its next symbols from those of its suffix is at least
    ``divergence`` nats and more than chance gives so many symbols (twice their number and ten, over its count), or
    if a kept one needs it as a suffix or prefix: then the longest kept suffix of a state and a symbol is that of the
    whole past. Counts are smoothed towards the suffix's distribution, which has the
    weight of ``strength`` symbols; the empty context is smoothed towards the 256 bytes alike.
    """
    after = reduce(lambda a, b: a | b, levels, {})
    after.setdefault(b"", {})
    kept = {b""}
    for c, follow in after.items():
        if c and c[1:] in after:
            n, m = sum(follow.values()), sum(after[c[1:]].values())
            kl = sum(k / n * np.log(k / n * m / after[c[1:]][s]) for s, k in follow.items() if s in after[c[1:]])
            if kl >= divergence and n * kl >= 2 * len(follow) + 10:
                kept.add(c)
    todo = list(kept)
    while todo:
        c = todo.pop()
        for part in (c[1:], c[:-1]):
            if c and part not in kept and part in after:
                kept.add(part)
                todo.append(part)
    contexts = sorted(kept, key=lambda c: (len(c), c))
    number = {c: i for i, c in enumerate(contexts)}
    suffix, back, keys, logs, prob = [], [], [], [], []
    for i, c in enumerate(contexts):
        parent = c[1:]
        while c and parent not in number:
            parent = parent[1:]
        up = number[parent] if c else -1
        suffix.append(max(up, 0))
        follow, n = after[c], sum(after[c].values())
        back.append(np.log10(strength / (n + strength)) if c else np.log10(strength / 256 / (n + strength)))
        own = {}
        for s, k in sorted(follow.items()):
            below, at, scale = 1 / 256, up, 1.0
            while at >= 0:
                if s in prob[at]:
                    below = scale * prob[at][s]
                    break
                scale *= 10 ** back[at] if at else 1.0
                if at == 0:
                    below = scale * 10 ** back[0]
                    break
                at = suffix[at]
            own[s] = (k + strength * below) / (n + strength)
            keys.append(i << 8 | s)
            logs.append(np.log10(own[s]))
        prob.append(own)
    return SuffixTree(contexts, np.array(keys, np.int64), np.array(logs), np.array(back), np.array(suffix, np.int64))


def low(key: str, n: int) -> Column:
    """The last ``n`` bytes of a packed key."""
    return F.col(key).bitwiseAND(F.lit((1 << 8 * n) - 1))


def predictions(counted: DataFrame, divergence: float = 0.05, strength: float = 4.0) -> DataFrame:
    """(key, n, log): each counted window, and the log10 probability of its last byte after the others.

    The tree of ``grow``, level by level on Spark: windows of each length with their context's count, then from the
    longest down the contexts that are kept, then from the shortest up the predictions. Contexts have no bound but
    LEAST and grow with the corpus; nothing comes to the driver.
    """
    window, context = counted.filter(F.col("kind") == 1).select("key", "n"), F.shiftright("key", 8)
    levels: list[DataFrame] = []
    for length in range(DEPTH, -1, -1):
        if length < DEPTH:
            window = window.groupBy(low("key", length + 1).alias("key")).agg(F.sum("n").alias("n"))
        every = F.sum("n").over(Window.partitionBy(context))  # 256 rows at most
        window = materialize(window.select("key", "n", every.alias("every")), f"windows-{length}")
        levels.insert(0, window)
        window = window.select("key", "n")

    kept: dict[int, DataFrame] = {}
    for length in range(DEPTH, 0, -1):
        shorter = levels[length - 1].select(F.col("key").alias("below"), F.col("n").alias("m"), F.col("every").alias("over"))
        pair = levels[length].filter("n > 0").join(shorter, low("key", length) == F.col("below"))
        here = F.col("n") / F.col("every")
        kl = F.sum(here * F.log(here * F.col("over") / F.col("m"))).alias("kl")
        own = pair.groupBy(context.alias("context")).agg(F.first("every").alias("every"), kl, F.count("*").alias("follow"))
        own = own.filter((F.col("every") >= LEAST) & (F.col("kl") >= divergence))
        own = own.filter(F.col("every") * F.col("kl") >= 2 * F.col("follow") + 10).select("context")
        if length < DEPTH:
            longer = kept[length + 1]
            own = own.union(longer.select(low("context", length))).union(longer.select(F.shiftright("context", 8))).distinct()
        kept[length] = materialize(own, f"contexts-{length}")

    n, every = F.col("n"), F.col("every")
    got = levels[0].select("key", "n", ((n + strength / 256) / (every + strength)).alias("p"))
    for length in range(1, DEPTH + 1):
        under = got.select(F.col("key").alias("below"), F.col("p").alias("under"))
        pair = levels[length].join(under, low("key", length) == F.col("below"))
        pair = pair.join(kept[length].withColumn("kept", F.lit(True)), context == F.col("context"), "left")
        got = pair.select("key", "n", F.when(F.col("kept"), (n + strength * F.col("under")) / (every + strength)).otherwise(F.col("under")).alias("p"))
    return materialize(got.select("key", "n", F.log10("p").alias("log")), "predictions")


class Frequent:
    """Values of packed windows, most frequent first, by a hash of one try and a binary search for those it misses."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values = keys, values
        self.order = np.argsort(keys)
        self.sorted = keys[self.order]
        self.slots = np.zeros(1 << 22, np.int32)
        self.slots[self.slot(keys[::-1])] = np.arange(len(keys), dtype=np.int32)[::-1]  # the last one stays

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)).view(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values, 0 where there is none, and the positions of those without."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.arange(len(keys))
        at = self.slots[self.slot(keys)]
        out = self.values[at]
        miss = np.flatnonzero(self.keys[at] != keys)
        i = np.minimum(np.searchsorted(self.sorted, keys[miss]), len(self.sorted) - 1)
        there = self.sorted[i] == keys[miss]
        out[miss] = np.where(there, self.values[self.order[i]], 0.0)
        return out, miss[~there]


def frequent_windows(predicted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and logs of the most frequent windows: WINDOWS at most, all of a count or none of it."""
    counts = predicted.groupBy("n").count().toArrow().sort_by([("n", "descending")])
    fit = np.cumsum(counts.column("count").to_numpy()) <= WINDOWS
    least = int(counts.column("n").to_numpy()[fit].min()) if fit.any() else None
    top = predicted.filter(F.col("n") >= F.lit(least)).toArrow().sort_by([("n", "descending"), ("key", "ascending")])
    return top.column("key").to_numpy(), top.column("log").to_numpy()


def spelt(words: list[list[bytes]], frequent: Frequent) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts: the sum of their frequent windows' logs; then text, window and times of the others."""
    texts, sums, rest, at = [symbols(ws) for ws in words], [], [], 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= AT_ONCE:
            size += len(texts[end])
            end += 1
        lengths = np.array([len(t) for t in texts[at:end]])
        keys = windows(texts[at:end])
        logs, miss = frequent.find(keys)
        sums.append(np.add.reduceat(logs, np.cumsum(lengths) - lengths))
        if len(miss):
            owner, key = np.repeat(np.arange(at, end), lengths)[miss], keys[miss]
            order = np.lexsort((key, owner))
            owner, key = owner[order], key[order]
            first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])))
            rest.append((owner[first], key[first], np.diff(np.append(first, len(key)))))
        at = end
    none = np.zeros(0, np.int64)
    return np.concatenate(sums), *(np.concatenate(x) for x in (zip(*rest, strict=True) if rest else ([none],) * 3))


def lm_score(df: DataFrame, training, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: its key, held_out, n_tokens, n_known, train_tokens, base_score and score.

    ``training`` (a Column of the key) marks the rows that are learnt from. Tokens are words and one end for each
    text; null and empty texts are the end alone. base_score sums log10((c + 0.5) / (N + 0.5 (V + 1))); score
    is the tree's log10 probability. Without training rows N is 0 and the tree has the 256 bytes alike. Repeated
    rows and ties are scored alike, each for itself; an empty frame stays empty; other columns are ignored.
    Counts of the FREQUENT most frequent tokens and predictions of the WINDOWS most frequent windows go to all tasks,
    the others' are joined.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("key"), F.coalesce(training, F.lit(False)).alias("learns"), F.col(text).alias("text"))
    counted = materialize(count_corpus(rows.select("learns", "text")), "corpus-counts")
    vocabulary = counted.filter(F.col("kind") == 0).select("key", "n")
    sums = vocabulary.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = int(sums.n or 0), int(sums.v)
    top = vocabulary.orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
    known = dict(zip(top.column("key").to_pylist(), top.column("n").to_pylist(), strict=True))
    predicted = predictions(counted)
    shared = spark.sparkContext.broadcast((known, frequent_windows(predicted)))
    floor = n + 0.5 * (v + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts, likely = shared.value[0], Frequent(*shared.value[1])
        uid = TaskContext.get().partitionId() << 33
        cache = Recent(CACHE)
        logs = {c: np.log10((c + 0.5) / floor) for c in set(counts.values())}
        for batch in batches:
            for part in slices(batch, 2, 256):
                cache.turn()
                begin, firsts = uid, []
                rare: list[tuple[int, int, int]] = []
                words = [tokens(text) for text in part.column(2).to_pylist()]
                for ws in words:
                    base, seen, rest = 0.0, 0, {}
                    for w in ws:
                        got = cache.get(w)  # a frequent word's log, the key of another
                        if got is None:
                            got = cache.old.get(w)
                            if got is None:
                                k = word_key(w)
                                got = logs.get(counts.get(k), k)
                            cache[w] = got
                        if type(got) is int:
                            rest[got] = rest.get(got, 0) + 1
                        else:
                            base += got
                            seen += 1
                    end = counts.get(END_KEY, 0)
                    base += logs[end] if end else np.log10(0.5 / floor)
                    firsts.append((uid, len(ws) + 1, seen + (end > 0), base))
                    rare += [(uid, k, c) for k, c in rest.items()]
                    uid += 1
                spelling, at_text, window, often = spelt(words, likely)
                h, r, q = len(firsts), len(rare), len(window)
                columns = list(zip(*firsts, strict=True))
                owner, token, times = (np.array(x, np.int64) for x in (zip(*rare, strict=True) if r else ((), (), ())))
                null = lambda kind, n: pa.nulls(n, kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.array(columns[0], pa.int64()), pa.array(owner), pa.array(begin + at_text)]),
                        pa.concat_arrays([part.column(0), null(part.column(0).type, r + q)]),
                        pa.concat_arrays([part.column(1), null(pa.bool_(), r + q)]),
                        pa.concat_arrays([pa.array(columns[1], pa.int64()), pa.array(times), pa.array(often)]),
                        pa.concat_arrays([pa.array(columns[2], pa.int64()), null(pa.int64(), r + q)]),
                        pa.concat_arrays([pa.array(columns[3], pa.float64()), null(pa.float64(), r + q)]),
                        pa.concat_arrays([pa.array(spelling), null(pa.float64(), r + q)]),
                        pa.concat_arrays([null(pa.int64(), h), pa.array(token), null(pa.int64(), q)]),
                        pa.concat_arrays([null(pa.int64(), h + r), pa.array(window)]),
                    ],
                    names=["uid", "key", "learns", "times", "known", "base", "score", "token", "window"],
                )

    kind = rows.schema["key"].dataType.simpleString()
    scored = rows.mapInArrow(score, f"uid long, key {kind}, learns boolean, times long, known long, base double, score double, token long, window long")
    scored = materialize(scored, "scored")
    head = scored.filter(F.col("token").isNull() & F.col("window").isNull())
    counts = vocabulary.select(F.col("key").alias("token"), "n")
    rare = scored.filter(F.col("token").isNotNull()).select("uid", "token", "times").join(counts, "token", "left")
    each = F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(float(floor)))
    rare = rare.select("uid", each.alias("more"), F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("also"), F.lit(0.0).alias("spelt"))
    logs = predicted.select(F.col("key").alias("window"), "log")
    seldom = scored.filter(F.col("window").isNotNull()).select("uid", "window", "times").join(logs, "window")
    seldom = seldom.select("uid", F.lit(0.0).alias("more"), F.lit(0).cast("long").alias("also"), (F.col("times") * F.col("log")).alias("spelt"))
    rest = rare.union(seldom).groupBy("uid").agg(*(F.sum(c).alias(c) for c in ("more", "also", "spelt")))
    out = head.join(rest, "uid", "left")
    return out.select(
        F.col("key").alias(key),
        (~F.col("learns")).alias("held_out"),
        F.col("times").alias("n_tokens"),
        (F.col("known") + F.coalesce("also", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("spelt", F.lit(0.0))).alias("score"),
    )


def production(df: DataFrame) -> DataFrame:
    """lm_score over documents, learning from four fifths of them by crc32 of the id."""
    return lm_score(df, train_bucket("doc_id", 5) != 1)
