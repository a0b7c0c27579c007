"""Lexical search, packing and hard negatives against plain versions and on odd rows; rules that disagree."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from civicfeed.llm import hard_negatives, lexical, packing, quality_rules
from civicfeed.llm import queries as Q

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LONG = "word " * 20_000 + "rare"
ODD = [
    (1, "Alpha beta, ALPHA gamma", 7, "a"),
    (1, "Alpha beta, ALPHA gamma", 7, "a"),
    (1, "alpha only", 7, None),
    (None, "alpha beta", 8, "b"),
    (None, None, None, None),
    (2, None, 1, "a"),
    (3, "", 1, "a"),
    (4, " \n\t.,! ", 1, "c"),
    (5, LONG, 1, "a"),
    (6, "Ünïcode ÄLPHA \x00beta\x7f 12³ alpha-beta", 1, "c"),
]
SCHEMA = "doc_id long, text string, score long, rank string"


def folded(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if text else []


def plain_rank(docs, items, k):
    """(item, rank, doc, score) of every distinct item, row by row."""
    counts = [Counter(folded(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in counts]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for (doc, _), c, n in zip(docs, counts, sizes, strict=True):
            got = 0
            for t in set(folded(text)):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    got += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * (50 + 50 * n * n_docs // total)))
            if got > 0:
                scores.append((-got, doc is None, doc or 0))
        out += [(item, i + 1, None if no else d, -s) for i, (s, no, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [lexical.BROADCAST_ROWS, 0])
def test_lexical_on_odd_rows(spark, most):
    docs = spark.createDataFrame(ODD, SCHEMA)
    items = [(1, "beta ALPHA beta"), (1, "beta ALPHA beta"), (2, None), (3, " ,"), (None, "gamma rare word"), (1, "word")]
    got = lexical.rank(docs, spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string"), k=3, most=most)
    assert sorted(map(tuple, got.collect()), key=str) == plain_rank([r[:2] for r in ODD], items, 3)


def test_lexical_many_ties_and_pieces(spark, monkeypatch):
    """Equal documents beyond k, lists in pieces: the lower ids stay, whatever the piece."""
    monkeypatch.setattr(lexical, "PIECE", 7)
    docs = [(i, "common text here" if i % 3 else f"common rare{i % 5} text text") for i in range(120)]
    items = [(i, f"common rare{i} text") for i in range(5)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = lexical.rank(frame, spark.createDataFrame(items, "item_id long, text string"), k=4)
    assert sorted(map(tuple, got.collect()), key=str) == plain_rank(docs, items, 4)


def test_lexical_empty(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "alpha")], "doc_id long, text string")
    items = some.withColumnRenamed("doc_id", "item_id")
    assert lexical.rank(none, items).columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.rank(none, items).isEmpty() and lexical.rank(some, items.limit(0)).isEmpty()


def ids_of(text):
    return np.array([*Tokenizer.from_file(P.path("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def check_pieces(rows, texts, size):
    """Each text's ids lie in its pieces once, each sequence is gapless and fits; the share of padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, bytes(r.ids), r.doc_tokens))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for key, text in texts.items():
        whole, at = ids_of(text), 0
        for start, length, ids, n in sorted(by_doc[key]):
            assert start == at and n == len(whole) and ids == whole[start : start + length].tobytes()
            at += length
        assert at == len(whole)
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= size
        total += at
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding / max(1, total + padding)


def test_packing_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    pack = lambda size, most: packing.pack(docs, P.path("word_bpe_49k.json"), 2, 49_408, size, most).collect()
    assert check_pieces(pack(4096, 64), texts, 4096) < 0.01
    assert check_pieces(pack(256, 4), texts, 256) < 0.02


def test_packing_odd_rows(spark):
    rows = [(i, *r[1:]) for i, r in enumerate(ODD)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), P.path("word_bpe_49k.json"), 2, 49_408, 512).collect()
    check_pieces(got, {r[0]: r[1] for r in rows}, 512)
    twice = packing.pack(spark.createDataFrame(ODD, SCHEMA), P.path("word_bpe_49k.json"), 2, 49_408, 512)
    assert sum(r.length for r in twice.collect()) == sum(len(ids_of(r[1])) for r in ODD)
    assert packing.pack(spark.createDataFrame([], SCHEMA), P.path("word_bpe_49k.json"), 2, 49_408).isEmpty()


def test_packing_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in Q.op12_packing(spark, sf_dir).collect():
        assert zlib.crc32(ids_of(texts[r.doc_id])[r.start : r.start + r.length].tobytes()) == r.ids_crc32


def test_patterns_use_all_and_price_columns(monkeypatch):
    rng = np.random.default_rng(2)
    for n in (1, 40, 3000):
        lengths = Counter(np.clip(rng.lognormal(4, 1, n).astype(int), 1, 999).tolist())
        used = Counter()
        for pattern, times in packing.patterns(lengths, 1000):
            assert sum(c * a for c, a in pattern.items()) <= 1000 and times > 0
            used.update({c: a * times for c, a in pattern.items()})
        assert used == lengths
    # 44 + 35 + 21 fills a sequence; a start of one class a pattern uses 8/3 times as many, so pricing must find it
    widths, demand = np.array([21, 35, 44]), np.array([200.0, 200.0, 200.0])
    monkeypatch.setattr(packing, "start", lambda w, d, size: ([{i: int(size // x)} for i, x in enumerate(w)], np.diag(1.0 / (size // w)), d / (size // w)))
    assert sum(x for _, x in packing.fractional(widths, demand, 100, 1e-9, 0)) == pytest.approx(250)
    assert sum(x for _, x in packing.fractional(widths, demand, 100, 1e-9, 50)) == pytest.approx(200)
    widths, demand = np.array([20, 33, 34, 40, 60]), np.full(5, 100.0)
    got = packing.fractional(widths, demand, 100, 1e-9, 50)
    assert sum(x for _, x in got) == pytest.approx(widths @ demand / 100, rel=0.05)
    for i in range(5):
        assert sum(p.get(i, 0) * x for p, x in got) == pytest.approx(demand[i])


def plain_negatives(rows, k=5, percent=80):
    """The answer by all pairs; rows: distinct (id, vector, label)."""
    x = [(i, np.floor(256 * np.array(v, float)).astype(int), label) for i, v, label in rows]
    out = []
    for anchor, q, label in x:
        if anchor % 100:
            continue
        scores = [(-int(q @ v), i, other) for i, v, other in x if i != anchor]
        near = sorted((s, i) for s, i, other in scores if other == label)[:k]
        for score, positive in near:
            ring = sorted((s, i) for s, i, other in scores if other != label and percent * -score <= 100 * -s <= 100 * -score)[:k]
            out += [(anchor, positive, n + 1, i, -score, -s) for n, (s, i) in enumerate(ring)]
    return sorted(out)


@pytest.mark.parametrize("cell,leaf,block", [(4096, 128, 16_384), (60, 8, 25)])
def test_hard_negatives_against_all_pairs(spark, monkeypatch, cell, leaf, block):
    """Clusters, ties and many equal vectors, in one block and in many cells and pieces."""
    for name, value in (("CELL", cell), ("LEAF", leaf), ("BLOCK", block)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 6))
    rows = [(i, (centres[rng.integers(12)] + rng.normal(0, 0.2, 6)).round(2).tolist(), int(rng.integers(4))) for i in range(700)]
    rows += [(i, [1.0, 0.5, -0.5, 0.25, 0.0, 2.0], i % 3) for i in range(700, 900)]
    frame = spark.createDataFrame(rows + rows[:50], "vec_id long, embedding array<double>, label int")
    got = hard_negatives.mine(frame, F.col("vec_id") % 100 == 0, F.col("label"))
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)


def test_hard_negatives_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    fine = [(100, [1.0, 0.5], 1), (200, [0.9, 0.6], 1), (3, [0.8, 0.6], 2), (4, [0.9, 0.5], 2), (300, [0.0, 0.0], 2)]
    odd = [(None, [1.0, 0.5], 2), (5, None, 2), (6, [1.0, None], 2), (7, [nan, 1.0], 2), (8, [inf, 1.0], 2), (9, [1.0, 0.5, 0.2], 2), (10, [1.0, 0.5], None), (11, [1e30, 1.0], 2)]
    frame = spark.createDataFrame([(*r, "x") for r in fine + odd], "vec_id long, embedding array<double>, label int, rank string")
    got = hard_negatives.mine(frame, F.col("vec_id") % 100 == 0, F.col("label"))
    assert sorted(map(tuple, got.collect())) == plain_negatives(fine)
    assert hard_negatives.mine(frame.limit(0), F.lit(True), F.col("label")).isEmpty()
    assert hard_negatives.mine(frame.filter("vec_id = 100"), F.lit(True), F.col("label")).isEmpty()


def test_a_weak_rule_does_not_reject_alone():
    """A one-sided rule right in 60 % of its votes weighs little; one right in 99 % rejects by its vote alone."""
    rng = np.random.default_rng(1)
    bad = rng.random(60_000) < 0.3
    rates = [(0.4, 0.004)] * 3 + [(0.35, 0.1)]  # P(bad vote) in bad and in good documents: 97.7 % and 60 % of bad votes are right
    votes = np.stack([-(rng.random(len(bad)) < np.where(bad, b, g)).astype(int) for b, g in rates], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    beliefs = np.stack([quality_rules.belief(quality_rules.RULES[0])] * 4)
    model = quality_rules.fit_em(patterns, counts.astype(float), beliefs)
    down = [a[0] for a in model.adds]
    assert abs(model.prior - 0.7) < 0.03 and max(down[:3]) < -4 and -1.6 < down[3] < -1.0

    def odds(pattern):
        return np.log(model.prior / (1 - model.prior)) + sum(a[0] if v else a[1] for v, a in zip(pattern, model.adds, strict=True))

    assert odds([0, 0, 0, 1]) > 0 and odds([1, 0, 0, 0]) < 0 and odds([0, 0, 1, 0]) < 0 and odds([0, 0, 0, 0]) > 0
    # of what has a bad vote, all-must-pass rejects all; the model keeps those with the weak rule's vote alone
    kept = sum(c for p, c in zip(patterns, counts, strict=True) if (p == -1).any() and odds(p == -1) > 0)
    assert 0.2 < kept / counts[(patterns == -1).any(1)].sum() < 0.35
