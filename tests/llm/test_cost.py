"""What a row costs: work that is done for many words at once, or once for each of them."""

from __future__ import annotations

import random
import sys
import tracemalloc
from collections import Counter
from unittest.mock import MagicMock

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import xxhash

from civicfeed.llm import language, suffix_tree, token_store, toxicity
from civicfeed.llm.token_store import Recent


def calls_of(run) -> int:
    """How many functions run() calls, Python's and built in."""
    n = 0

    def count(_frame, event, _arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        run()
    finally:
        sys.setprofile(None)
    return n


def odd_words(n: int) -> list[bytes]:
    rng = random.Random(5)
    letters = "abzE.,é漢\U0001f600İΣσ'<>=­́ß\x85"
    found = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))).encode() for _ in range(n)]
    return found + [b"\xff", b"a\xe2\x82", b"\xed\xa0\x80x", "ΑΣ".encode(), "ΑΣ.".encode(), b"x" * 300]


def test_grams_of_many_words_are_the_librarys():
    for low, high, buckets in ((3, 5, 1 << 17), (1, 6, 1000)):
        found = odd_words(2000)
        ids, sizes = toxicity.grams(found, low, high, buckets)
        want = []
        for word in found:
            w = f"<{word.decode('utf-8', 'replace').lower()}>"
            want.append([w[i : i + n] for n in range(low, high + 1) for i in range(len(w) - n + 1)] + ["=" + w])
        assert sizes.tolist() == [len(x) for x in want]
        assert ids.tolist() == [xxhash.xxh3_64_intdigest(g) % buckets for x in want for g in x]


def test_words_too_short_for_the_longest_grams():
    for found in ([b"a"], [b"ab", b"c"], ["é".encode()], ["漢".encode()]):
        ids, sizes = toxicity.grams(found, 3, 5, 1 << 17)
        marked = [f"<{w.decode()}>" for w in found]
        assert sizes.tolist() == [sum(max(len(w) - n + 1, 0) for n in (3, 4, 5)) + 1 for w in marked] and len(ids) == sizes.sum()
    model = toxicity.SubwordModel(3, 5, np.ones(1 << 12), -0.4, 3.0)
    assert abs(model.score("a") - 1 / (1 + np.exp(0.4 - 3 / 16))) < 1e-12


def test_new_words_are_hashed_together(monkeypatch):
    """Of a new word only the whole goes to the library by itself, not each of its n-grams."""
    calls, plain = [], xxhash.xxh3_64_intdigest
    monkeypatch.setattr(toxicity.xxhash, "xxh3_64_intdigest", lambda x: calls.append(x) or plain(x))
    model = toxicity.SubwordModel(3, 5, np.random.default_rng(3).normal(size=1 << 12), -0.4, 3.0)
    found = [f"word{i:04d}ending" for i in range(500)]
    model.score(" ".join(found))
    model.score(" ".join(found))
    assert len(calls) == len(found)


def test_scores_do_not_depend_on_the_batch(monkeypatch):
    rng = random.Random(6)
    model = toxicity.SubwordModel(3, 5, np.random.default_rng(3).normal(size=1 << 12), -0.4, 3.0)
    some = [w.decode("utf-8", "replace") for w in odd_words(300)]
    texts = [" ".join(rng.choices(some, k=rng.randint(0, 80))) for _ in range(60)] + [None, "", " \n"]
    want = [model.score(t) for t in texts]
    monkeypatch.setattr(toxicity, "CACHE", 20)
    monkeypatch.setattr(toxicity, "PORTION", 64)
    for size in (1, 7, 63):
        assert [s for i in range(0, len(texts), size) for s in model.scores(texts[i : i + size])] == want


def test_languages_of_new_words_need_no_call_for_each():
    """A text's n-grams are made from its letters together, whatever the number of words not seen before."""
    model = language.Profiles.of({"a": [97, 98, 99], "b": [100, 101, 102]})
    rng = random.Random(7)
    long, short = (" ".join("".join(rng.choices("abcdefgh", k=9)) for _ in range(n)) for n in (5000, 1))
    model.predict(short, Recent(10))
    assert calls_of(lambda: model.predict(long, Recent(10))) < 200


def test_gram_counts_against_a_loop(monkeypatch):
    pack = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    rng = random.Random(8)
    letters = "abzé漢\U0001f600İΣσ'.­́ß 1²Ⅷ\n\tªÁ"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(300)] + [None, "", "12 !", "a", "ΑΣ", " a "]
    for at_once in (1 << 18, 5):
        monkeypatch.setattr(language, "AT_ONCE", at_once)
        for t in texts:
            runs = "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
            want = Counter(w[i : i + n] for w in map(" {} ".format, runs) for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i : i + n] != " ")
            grams, counts = language.gram_counts(t)
            assert dict(zip(grams.tolist(), counts.tolist(), strict=True)) == {pack(g): n for g, n in want.items()}
            assert (np.diff(grams) > 0).all()


def test_new_spellings_are_not_cut_by_patterns(monkeypatch):
    """Letters below U+0250 and the punctuation after them are two pre-tokens, without a search for them."""
    coder = token_store.WordCoder(P.path("word_bpe_49k.json"), 1, "<u2")
    text = "House HOUSE; house!! Häuser*** ÉTÉ?! été... Ñandú%%% ª. (x) don't İs <|endoftext|>"
    want = coder.model.encode(text, add_special_tokens=False).ids + [1]
    assert np.frombuffer(coder.encode([text])[0], "<u2").tolist() == want
    cut = []
    fresh = token_store.WordCoder(P.path("word_bpe_49k.json"), 1, "<u2")
    monkeypatch.setattr(fresh, "_cut", lambda w: cut.append(w))  # None: the library cuts
    assert np.frombuffer(fresh.encode([text])[0], "<u2").tolist() == want
    assert cut == ["(x)".encode(), b"don't", "İs".encode(), b"<|endoftext|>"]


def test_word_ids_whatever_is_forgotten(monkeypatch):
    monkeypatch.setattr(token_store, "CACHE", 8)
    coder = token_store.WordCoder(P.path("word_bpe_49k.json"), 1, "<u2")
    rng = random.Random(9)
    letters = [*"aZbst.,!<>|é漢İΣσ1²ªǰɐµ-­\x85", "'s", "<|endoftext|>", "\u0307", " "]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(600)] + [None]
    got = [x for i in range(0, len(texts), 7) for x in coder.encode(texts[i : i + 7])]
    for t, x in zip(texts, got, strict=True):
        assert np.frombuffer(x, "<u2").tolist() == coder.model.encode(t or "", add_special_tokens=False).ids + [1]
    assert len(coder.seen) < 8 + 7 * 31


def peak_mb(run) -> float:
    """The most that run() held at once."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def counting(texts: list[tuple[bool, str | None]]):
    """What a counting task of the suffix tree hands on for a batch of rows."""
    frame = MagicMock()
    suffix_tree.count_corpus(frame)
    learns, column = (pa.array(x, t) for x, t in zip(zip(*texts, strict=True), (pa.bool_(), pa.string()), strict=True))
    return frame.mapInArrow.call_args[0][0](iter([pa.RecordBatch.from_arrays([learns, column], names=["learns", "text"])]))


def test_counts_hold_one_table():
    """New counts of the same keys take no room beside the table and themselves (3 MB and some copies)."""
    rng = np.random.default_rng(3)
    counts, keys = suffix_tree.Counts(), rng.integers(0, 1 << 40, 200_000)
    assert peak_mb(lambda: [counts.add(rng.permutation(keys)) for _ in range(20)]) < 20
    got, n = counts.merged()
    assert got.tolist() == np.unique(keys).tolist() and (n % 20 == 0).all() and n.sum() == 20 * len(keys)


def test_a_counting_task_takes_long_texts_in_slices(spark):
    """Its memory is that of a slice, not of as many texts as come in a batch."""
    rows = [(i % 5 > 0, "some words of a long text " * 8000) for i in range(30)]
    assert peak_mb(lambda: [None for _ in counting(rows)]) < 70


def test_counts_and_spellings_whatever_a_slice_is(spark, monkeypatch):
    rng = random.Random(10)
    texts = ["".join(rng.choices("abAB é漢\n\t", k=rng.randint(0, 90))) for _ in range(150)] + [None, "", " ", "long " * 200]
    rows = [(i % 3 > 0, t) for i, t in enumerate(texts)]
    want: Counter = Counter()
    for learns, t in rows:
        ws = suffix_tree.tokens(t)
        padded = b"\xff" * suffix_tree.DEPTH + suffix_tree.symbols(ws)
        for w in [*map(suffix_tree.word_key, ws), suffix_tree.END_KEY] * learns:
            want[0, w] += 1
        for i in range(len(padded) - suffix_tree.DEPTH):
            want[1, int.from_bytes(padded[i : i + suffix_tree.DEPTH + 1], "big")] += learns
    words, whole = [suffix_tree.tokens(t) for t in texts], pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    some = np.array([k for kind, k in want if kind][::2], np.int64)
    sums, rest = [], []
    for size, held, at_once in ((1 << 20, 2_000_000, 1 << 18), (200, 500, 70), (1, 1, 1)):
        monkeypatch.setattr(suffix_tree, "SLICE_BYTES", size)
        monkeypatch.setattr(suffix_tree, "HELD", held)
        monkeypatch.setattr(suffix_tree, "AT_ONCE", at_once)
        got: Counter = Counter()
        for batch in counting(rows):
            for kind, key, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got[kind, key] += n
        assert dict(got) == dict(want)
        parts = list(suffix_tree.slices(whole, 0, 9))
        assert [t for p in parts for t in p.column(0).to_pylist()] == texts
        assert all(0 < p.num_rows <= 9 and (p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(0).to_pylist()) <= size) for p in parts)
        found, *others = suffix_tree.spelt(words, suffix_tree.Frequent(some, np.arange(len(some), dtype=float)))
        sums.append(found.tolist())
        rest.append(sorted(zip(*(x.tolist() for x in others), strict=True)))
    assert sums[0] == sums[1] == sums[2] and rest[0] == rest[1] == rest[2] and len(rest[0]) > 100
