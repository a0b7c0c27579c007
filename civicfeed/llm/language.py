"""Language identification by rank-order n-gram profiles and the out-of-place distance."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import train_bucket, with_scores

LETTERS = regex.compile(r"\p{L}+").finditer
#: The longest n-gram is of three characters; how many n-grams a profile ranks.
RANKS = 300
#: Bits of an id's hash that name a slice of a language's rows.
SLICE_BITS = 10
#: Letters of a text that are counted at once.
AT_ONCE = 1 << 18
SPACE = 32


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    out = np.zeros(0x110000, bool)
    for run in LETTERS("".join(map(chr, range(len(out))))):
        out[run.start() : run.end()] = True
    return out


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a whole text's letter runs, lower-cased and each between two spaces, and their counts.

    An n-gram is packed into 63 bits, 21 a character; the lone space is none. Those of a text are made together from
    each letter and what stands beside it.
    """
    codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    known = letters()[codes]
    codes, at = np.where(known, codes, SPACE).astype(np.int64), np.flatnonzero(known)
    grams, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(at), AT_ONCE):
        part = at[i : i + AT_ONCE]
        one, after = codes[part], codes[part + 1]
        two = codes[part - 1] << 21 | one
        own = np.sort(np.concatenate([one, two, two << 21 | after, one[after == SPACE] << 21 | SPACE]))
        begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        grams.append(own[begin])
        counts.append(np.diff(np.append(begin, len(own))))
    if len(grams) <= 2:
        return grams[-1], counts[-1]
    own, back = np.unique(np.concatenate(grams), return_inverse=True)
    return own, np.bincount(back, np.concatenate(counts)).astype(np.int64)


def ranked(grams: np.ndarray, counts: np.ndarray, most: int = RANKS) -> np.ndarray:
    """The most frequent n-grams in order; ties go to the smaller code."""
    if len(grams) > most:  # only what can be among the first
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))][:most]


@dataclass(frozen=True)
class Profiles:
    """Each language's ranks: one sorted array of n-grams and, by language, their place or RANKS if absent."""

    languages: tuple[str, ...]
    grams: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, ranks: dict[str, list[int]]) -> Profiles:
        languages = tuple(sorted(ranks))
        grams = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.array(ranks[x], np.int64) for x in languages)]))
        places = np.full((len(languages), len(grams)), RANKS, np.int64)
        for i, x in enumerate(languages):
            places[i, np.searchsorted(grams, ranks[x])] = np.arange(len(ranks[x]))
        return cls(languages, grams, places)

    def predict(self, text: str | None, _seen: dict | None = None) -> tuple[str, float]:
        """The language whose profile is nearest and how near, 0 to 1; ties go to the first language by name.

        Each of the text's n-grams adds the difference of its two ranks, RANKS at most and if the profile lacks
        it. Texts without letters, and all texts where there are no profiles, are ``und`` with 0. No words are kept
        between texts; callers of the earlier form may still pass a table of them.
        """
        own = ranked(*gram_counts(text))
        if not len(own) or not self.languages:
            return "und", 0.0
        at = np.searchsorted(self.grams, own).clip(max=len(self.grams) - 1)
        known = self.grams[at] == own
        place = np.where(known, self.places[:, at], RANKS)
        far = np.where(place < RANKS, np.minimum(np.abs(place - np.arange(len(own))), RANKS), RANKS).sum(1)
        best = int(far.argmin())
        return self.languages[best], 1.0 - float(far[best]) / (RANKS * len(own))


def fit(df: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", most: int = 1000) -> Profiles:
    """Profiles from at most ``most`` texts of each language: those with the least hash of their id.

    Rows without a language or text teach nothing. Counting and ranking run on Spark; a profile is RANKS rows.
    """
    rows = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(key).alias("k"), F.col(text).alias("t"))
    # ids first, so that texts are not shuffled to rank them; counts of slices of the hash tell up to which slice a
    # language's rows are needed, so that only about ``most`` of them are ranked
    hashed = rows.select("lang", "k", F.xxhash64("k").alias("h")).withColumn("slice", F.shiftright("h", 64 - SLICE_BITS))
    run = Window.partitionBy("lang").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("count").over(run), F.lit(0))
    slices = hashed.groupBy("lang", "slice").count().withColumn("before", before).filter(F.col("before") < most)
    last = F.broadcast(slices.groupBy("lang").agg(F.max("slice").alias("last")))
    place = Window.partitionBy("lang").orderBy("h", "k")
    chosen = hashed.join(last, "lang").filter(F.col("slice") <= F.col("last")).withColumn("n", F.row_number().over(place)).filter(F.col("n") <= most)
    sample = rows.join(F.broadcast(chosen.select("lang", "k").distinct()), ["lang", "k"], "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, Counter] = {}
        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams, counts = gram_counts(text)
                totals.setdefault(language, Counter()).update(dict(zip(grams.tolist(), counts.tolist(), strict=True)))
        for language, total in totals.items():
            yield pa.RecordBatch.from_pydict({"lang": [language] * len(total), "gram": pa.array(list(total), pa.int64()), "n": pa.array(list(total.values()), pa.int64())})

    counted = sample.select("lang", "t").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counted.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= RANKS)
    ranks: dict[str, list[int]] = {}
    for row in best.orderBy("lang", "rank").collect():
        ranks.setdefault(row.lang, []).append(row.gram)
    return Profiles.of(ranks)


def identify(df: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``.

    Null, empty and letterless texts are ``und`` with score 0. Rows are judged one by one: repeated rows get
    equal answers, an empty frame stays empty, and input columns named like a result are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(profiles)  # RANKS entries a language

    def fn(texts: list[str | None]) -> dict[str, list]:
        found = [shared.value.predict(t) for t in texts]
        return {"lang_pred": [x for x, _ in found], "score": [s for _, s in found]}

    return with_scores(df, text, fn, {"lang_pred": "string", "score": "double"})


def trained(docs: DataFrame) -> Profiles:
    """The production profiles: learnt outside the held-out fifth."""
    return fit(docs.filter(train_bucket("doc_id", 5) != 0))
