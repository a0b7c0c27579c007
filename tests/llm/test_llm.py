"""Training-data operators against plain versions, on a small table and on edge cases."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import public_tokenizers as P
from civicfeed.llm import ann, byte_bpe, components, language, mixing, near_dup, quality_crf, quality_rules, suffix_tree, token_store, toxicity
from civicfeed.llm import queries as Q
from same import duck, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
#: Nulls, blanks, repeated rows, equal ids with other texts, a long text, columns that clash with results.
ODD = [
    (1, "Same text of more than five words here", "a", "x", 1),
    (1, "Same text of more than five words here", "a", "x", 1),
    (1, "Another text of more than five words here", None, "x", 2),
    (None, "Same text of more than five words here", "b", None, 3),
    (None, None, None, None, None),
    (2, None, "a", "x", 4),
    (3, "", "a", "x", 5),
    (4, " \n\t ", "c", "y", 6),
    (5, "word " * 30_000, "a", "x", 7),
    (6, "\x00 \x1f \x85 \xa0é😀 <|endoftext|> don't 12³", "c", "y", 8),
]
ODD_SCHEMA = "doc_id long, text string, source string, lang string, score long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_same_as_sql(name, spark, sf_dir):
    assert rows(Q.QUERIES[name](spark, sf_dir).toPandas()) == rows(duck(sf_dir).sql(Q.ORACLE_SQL[name]).df())


# 1: near duplicates


def plain_links(data: list[tuple], threshold=0.8):
    """Links and classes by comparing all pairs of shingle sets of words, by row number."""
    sets = []
    for _, text in data:
        ws = WORD.findall(text or "")
        sets.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = Counter()
    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i, (k, _) in enumerate(data):
        members[find(i)].append(k)
    least = {r: min((k for k in ks if k is not None), default=None) for r, ks in members.items()}
    return [(data[i][0], least[find(i)] if sets[i] else data[i][0], links[i]) for i in range(len(data))]


def near_copies(n=60, seed=1):
    """One large group of texts that differ in a word or two, so that pairs lie on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(120)]
    out = []
    for i in range(n):
        t = list(base)
        for at in rng.choice(120, rng.integers(1, 4), replace=False):
            t[at] = f"x{rng.integers(9)}"
        out.append((i, " ".join(t)))
    return out


@pytest.mark.parametrize("small,block", [(32, 512), (2, 7)])
def test_jaccard_join(spark, docs, odd, monkeypatch, small, block):
    monkeypatch.setattr(near_dup, "SMALL", small)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    data = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()][:120] + [(1000 + i, t) for i, t in near_copies()]
    data += [(r[0], r[1]) for r in ODD]
    got = near_dup.jaccard_join(spark.createDataFrame(data, "doc_id long, text string")).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(plain_links(data), key=key)


def test_keep_one(spark, odd, none):
    kept = near_dup.keep_one(odd).collect()
    assert kept[0].__fields__ == odd.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:7]) for r in kept) == sorted([(1, "Same te"), (0, ""), (2, ""), (3, ""), (4, " \n\t "), (5, "word wo"), (6, ODD[-1][1][:7]), (1, "Another")])
    assert near_dup.keep_one(none).count() == 0 and near_dup.jaccard_join(none).count() == 0


def test_pruning_keeps_true_pairs():
    rng = np.random.default_rng(0)
    shared, own = rng.integers(0, 2**63, 900, dtype=np.uint64), rng.integers(0, 2**63, 225, dtype=np.uint64)
    a, b = np.concatenate([shared, own[:112]]), np.concatenate([shared, own[112:]])  # similarity 0.8
    lost = 0
    for i in range(200):
        shift = np.uint64(rng.integers(2**62))
        sig = [near_dup.minhash((x ^ shift) * np.uint64(0x9E3779B97F4A7C15))[None] for x in (a, b)]
        lost += not len(near_dup.likely(*sig, 0.8, 1e-6))
    assert lost == 0
    low = near_dup.least_matches(0.8, 1e-6)
    assert all(0 < m < n for m, n in zip(low, range(32, 129, 32), strict=True))


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(400 + i, 401 + i) for i in range(40)] + [(500, 501 + i) for i in range(40)]
    got = dict(map(tuple, components.connected(spark.createDataFrame(pairs, "a long, b long")).collect()))
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert set(got) == nodes
    assert {(got[a] == got[b]) == (find(a) == find(b)) for a in nodes for b in nodes} == {True}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op1_against_all_pairs(spark, sf_dir, texts):
    """The registered query: classes and links of every document, by the Jaccard similarity of all pairs."""
    sets = {i: {tuple(w) for w in (ws[k : k + 5] for k in range(max(1, len(ws) - 4)))} if (ws := (t or "").encode().split()) else set() for i, t in texts.items()}
    ids = sorted(i for i in sets if sets[i])
    root, links = {i: i for i in sets}, Counter()
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links.update((a, b))
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.class_id, r.n_links) for r in Q.op1_ngram_jaccard(spark, sf_dir).collect()}
    assert got == {i: (find(i), links[i]) for i in sets}


# 2: token store


def test_token_store(spark, odd, none):
    path = P.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    store = token_store.write_store(odd, path, 1, 49_408)
    got = token_store.read_store(spark, store).collect()
    ordered = sorted(((r[0], r[1]) for r in ODD), key=lambda r: (r[0] is None, r[0] or 0))
    assert [r.key for r in sorted(got, key=lambda r: r.start)] == [k for k, _ in ordered]
    want = Counter((k, tuple(plain.encode(t or "", add_special_tokens=False).ids + [1])) for k, t in ordered)
    assert Counter((r.key, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    keyed = token_store.TokenStore(spark, store)
    assert tuple(keyed.get(5).tolist()) == tuple(plain.encode(ODD[8][1], add_special_tokens=False).ids + [1])
    assert keyed.get(99) is None and keyed.get(-5) is None
    first = min((t for k, t in ordered if k == 1), key=lambda t: -1 if t is None else spark.range(1).select(F.xxhash64(F.lit(t))).first()[0])
    assert tuple(keyed.get(1).tolist()) == tuple(plain.encode(first, add_special_tokens=False).ids + [1])
    empty = token_store.write_store(none, path, 1, 49_408)
    assert token_store.read_store(spark, empty).count() == 0


def test_keyed_reads_by_offset(spark, docs, texts):
    """Keys are found by short reads at their places, in shards that are opened and forgotten."""
    store = token_store.write_store(docs.select("doc_id", "text"), P.path("word_bpe_49k.json"), 1, 49_408)
    want = {r.key: r.ids for r in token_store.read_store(spark, store).collect()}
    keyed = token_store.TokenStore(spark, store, most=1)
    for k in texts:
        assert keyed.get(k).astype("<u4").tobytes() == want[k]
    assert all(keyed.get(k) is None for k in (-1, max(texts) + 1))


def test_op2_on_documents(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    plain, at = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    got = {r.doc_id: r for r in Q.op2_token_store(spark, sf_dir).collect()}
    assert len(got) == len(texts)
    for k in sorted(texts):
        ids = np.array(plain.encode(texts[k] or "", add_special_tokens=False).ids + [1], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_word_coder_is_the_tokenizer():
    coder = token_store.WordCoder(P.path("word_bpe_49k.json"), 1, "<u2")
    for t in ["a's we're I'M 'll'd don't", "<|endoftext|> a<|endoftext|>b", "Ünḯ İ ẞ \x01\x7f x12³ ٣", "", "naïve Σς ﬁ é", "''s'" * 9, "ª º ½ Ⅷ 漢字、 안녕"]:
        assert np.frombuffer(coder.encode([t])[0], "<u2").tolist() == coder.model.encode(t, add_special_tokens=False).ids + [1]


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        ph = token_store.PerfectHash.build(keys)
        assert sorted(ph.slots(keys)) == list(range(len(keys)))
        index = token_store.Index.unpack(token_store.pack_index(keys))
        assert (index.rows(keys) == np.arange(len(keys))).all()
        assert (index.rows(rng.integers(-(2**63), 2**63 - 1, 1000)) >= 0).mean() < 0.01


# 3: quality rules


def plain_counts(text):
    ws = WORD.findall(text or "")
    windows = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    covered = {i + k for i in range(len(ws) - 2) if windows[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_rules(spark, sf_dir, docs, odd, none):
    got = Q.op3_quality_rules(spark, sf_dir).toPandas().set_index("doc_id")
    for r in docs.collect():
        x, want = got.loc[r.doc_id], plain_counts(r.text)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (x.base_failed and x.kept)
    for r in quality_rules.quality_rules(odd).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(r.text)
    assert quality_rules.quality_rules(none).count() == 0


def fitted(votes, rules):
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    return quality_rules.fit_em(patterns, counts.astype(float), np.stack([quality_rules.belief(r) for r in rules]))


def voting(good, of_good, of_bad, rng):
    """Votes drawn from (P(bad), P(abstain), P(good)) of good and of bad documents."""
    at = rng.random(len(good))
    share = np.where(good[:, None], np.cumsum(of_good), np.cumsum(of_bad))
    return (at[:, None] >= share).sum(1) - 1


def test_em_recovers_rules():
    rng, one, two = np.random.default_rng(3), quality_rules.Rule("d", "x", "y", 1.0), quality_rules.Rule("t", "x", "y", 1.0, 0.5)
    truth = [
        (two, (0.02, 0.1, 0.88), (0.6, 0.2, 0.2)),
        (two, (0.03, 0.27, 0.7), (0.7, 0.2, 0.1)),
        (one, (0.01, 0.99, 0.0), (0.5, 0.5, 0.0)),
        (one, (0.02, 0.98, 0.0), (0.3, 0.7, 0.0)),
        (one, (0.0, 1.0, 0.0), (0.0, 1.0, 0.0)),
    ]
    good = rng.random(40_000) < 0.8
    model = fitted(np.stack([voting(good, g, b, rng) for _, g, b in truth], 1), [r for r, _, _ in truth])
    assert abs(model.prior - 0.8) < 0.02
    for adds, (rule, g, b) in zip(model.adds[:4], truth, strict=False):
        for k in range(3 if rule is two else 2):
            assert abs(adds[k] - np.log(g[k] / b[k])) < 0.35, (adds, g, b)
    # a rule that never voted keeps the belief about it: no worse than chance, and an abstention says little
    assert model.adds[4][0] < -1 and abs(model.adds[4][1]) < 0.01


def test_one_strong_bad_vote_rejects():
    rng, one, two = np.random.default_rng(4), quality_rules.Rule("d", "x", "y", 1.0), quality_rules.Rule("t", "x", "y", 1.0, 0.5)
    good = rng.random(20_000) < 0.85
    rules = [two, one, one]
    votes = np.stack([voting(good, (0.01, 0.05, 0.94), (0.4, 0.1, 0.5), rng), voting(good, (0.001, 0.999, 0), (0.6, 0.4, 0), rng), voting(good, (0.001, 0.999, 0), (0.3, 0.7, 0), rng)], 1)
    model = fitted(votes, rules)
    odds = np.log(model.prior / (1 - model.prior))
    assert odds + model.adds[0][2] + model.adds[1][0] + model.adds[2][1] < 0  # one of the two speaks, the other rule says good
    assert odds + model.adds[0][2] + model.adds[1][1] + model.adds[2][1] > 0


def test_symbols_alone_reject(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    plain = " ".join(chr(97 + i % 26) + chr(97 + i // 26) + "word" for i in range(300))
    marked = " ".join(w + ("#" if i % 4 == 0 else "") for i, w in enumerate(plain.split()))
    more = spark.createDataFrame([(-1, plain), (-2, marked)], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs.union(more)).filter("doc_id < 0").collect()}
    assert got == {-1: True, -2: False}


def test_without_documents(spark):
    model = fitted(np.zeros((0, 2), int), quality_rules.RULES[:2])
    assert model.prior == 0.5 and all(a[0] < 0 for a in model.adds)


def test_quality_agrees_with_labels(spark):
    got = Q.op3_quality_rules(spark, "/root/testdata/sf0.01").toPandas()
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    m = got.merge(labels, on="doc_id")
    clean = m[(m.quality == 1) & ~m.base_failed]
    assert clean.kept.mean() > 0.99 and m[m.quality == 0].kept.mean() < 0.01


# 4: byte-level BPE


def test_byte_bpe(docs, odd, none):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (docs.select("doc_id", "text"), odd):
        coded = byte_bpe.encode(df, RANKS, P.PATTERN)
        back = byte_bpe.decode(coded.withColumn("t", F.col("text")), RANKS, P.PATTERN)
        for r in back.collect():
            assert r.ids == plain.encode_ordinary(r.t or "")
            assert bytes(r.decoded) == (r.t or "").encode()
    assert byte_bpe.encode(none, RANKS, P.PATTERN).count() == 0


# 5: nearest neighbours


def test_recall_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(10, 64))
    many = ann.POINT_BLOCK + 300  # a full block of distinct points: what is found rests on the codes
    x = (centres[rng.integers(0, 10, many)] * 0.3 + rng.normal(size=(many, 64)) * 0.2).astype(np.float32)
    x[100:400] = x[7]  # a common vector
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")
    monkeypatch.setattr(ann, "QUERY_BLOCK", 100)
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, rerank=256).toPandas()
    y = x.astype(float)
    hits = 0
    for q, g in got.groupby("query_id"):
        s = ann.inner(y, y[q])
        order = [i for i in np.lexsort((np.arange(len(y)), -s)) if i != q][:20]
        hits += len(set(order) & set(g.vec_id))
        assert list(g.sort_values("rank")["rank"]) == list(range(1, 21))
        assert np.allclose(g.score, s[g.vec_id])
    asked = -(-many // 20)
    assert got.query_id.nunique() == asked and hits / (asked * 20) >= 0.97


def test_odd_vectors(spark, none):
    rows_ = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (1, [2.0, 1.0]), (2, [2.0, 1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (1, [2.0, 1.0]), (40, [2.0, 1.0])]
    df = spark.createDataFrame([(*r, 9) for r in rows_], "vec_id long, embedding array<float>, rank int")
    got = [tuple(r) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 40, 2.0), (40, 1, 1, 5.0), (40, 2, 2, 5.0), (40, 3, 0, 2.0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# 6: mixing


def test_mixing(spark, odd, none):
    got = mixing.mix(odd).toPandas()
    assert list(got.columns)[:5] == odd.columns and len(got) == len(ODD)
    assert (got.repeats <= 3).all() and got[got.source.isna()]["source_size"].eq(8).all()
    again = mixing.mix(odd.orderBy(F.desc("doc_id"))).toPandas()
    key = lambda d: sorted(map(str, d.itertuples(index=False)))
    assert key(got) == key(again)
    assert mixing.mix(none).count() == 0


def test_mixing_passes_any_names_on(spark, odd):
    names = ["whole", "last_slice", "last_row", "cf_own", "cf_hash", "cf_key", "cf_source", "rest", "weight", "part", "in_0", "place"]
    more = odd.select("*", *[F.col("lang").alias(c) for c in names])
    got = mixing.mix(more).toPandas()
    assert list(got.columns) == [*more.columns, "size", "source_size", "target", "repeats"]
    assert all(got[c].equals(got["lang"]) for c in names)
    key = lambda d: sorted(map(str, d.itertuples(index=False)))
    assert key(got.drop(columns=names)) == key(mixing.mix(odd).toPandas())


def test_water_fill_against_a_loop(spark, monkeypatch):
    rng = np.random.default_rng(6)
    for n, most in ((1, 100), (2, 1), (7, 3), (23, 100), (40, 7)):
        monkeypatch.setattr(mixing, "RANGE_SOURCES", most)
        sizes = rng.integers(0, 1000, n)
        df = spark.createDataFrame([(f"s{i:02}", int(s)) for i, s in enumerate(sizes)], "source string, source_size long")
        got = {r.source: r.target for r in mixing.water_fill(df, (5, 2, 1), 3).collect()}
        weight = np.array([(5, 2, 1)[i % 3] for i in range(n)], float)
        capped = np.zeros(n, bool)
        while True:
            left = sizes.sum() - 3 * sizes[capped].sum()
            target = np.where(capped, 3 * sizes, left * weight / max(1e-9, weight[~capped].sum()))
            over = ~capped & (target > 3 * sizes + 1e-9)
            if not over.any():
                break
            capped |= over
        assert np.allclose([got[f"s{i:02}"] for i in range(n)], target)


def test_taken_is_near_target(spark):
    got = Q.op6_mixing(spark, "/root/testdata/sf0.01").toPandas()
    d = pd.read_parquet("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "source"])
    m = got.merge(d, on="doc_id")
    by = m.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert ((by.taken - by.target).abs() <= by.most / 2 + 1).all()
    assert (got.taken <= 3 * got["size"]).all()


# 7 to 9: classifiers


def held(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_crf_on_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = Q.op7_quality_crf(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    assert (got.held_out == [held(i, 3) == 1 for i in got.doc_id]).all()
    out = got[got.held_out]
    assert (out.predicted == out.quality).mean() > 0.98


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(7)
    odds, moves = rng.normal(size=(1, 4)), rng.normal(size=(2, 2))
    p, counts = quality_crf.forward_backward(odds, moves, np.array([4]), np.ones(1))
    total, good, pairs = 0.0, np.zeros(4), np.zeros((2, 2))
    for code in range(16):
        y = [code >> i & 1 for i in range(4)]
        w = np.exp(sum(odds[0, i] * y[i] for i in range(4)) + sum(moves[y[i], y[i + 1]] for i in range(3)))
        total += w
        good += w * np.array(y)
        for i in range(3):
            pairs[y[i], y[i + 1]] += w
    assert np.allclose(p[0], good / total) and np.allclose(counts, pairs / total)


def test_line_features_and_document_mean(texts):
    """Each line's features in plain string terms, and a document's score as the mean of its lines by their lengths."""
    letter = lambda c: c.isascii() and c.isalpha()
    model = quality_crf.Chain(np.linspace(-1, 1, quality_crf.WIDTH), np.array([[0.3, -0.2], [-0.1, 0.4]]), 0.7)
    for text in [*list(texts.values())[:25], "A!! b!!\n\n# x #\nA!! b!!\n 12 12 ok.", None, "", " \n"]:
        lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
        x, sizes = quality_crf.line_features(text)
        assert len(x) == len(lines) and sizes.tolist() == [len(l) for l in lines]
        own = []
        for i, line in enumerate(lines):
            ws = WORD.findall(line)
            raw = line.encode("utf-8", "surrogatepass")
            letters = sum(letter(c) for c in line) + sum(b > 127 for b in raw)
            size = sum(len(w.encode("utf-8", "surrogatepass")) for w in ws)
            own.append([
                min(1, sum(c in "#*$%&|<>" for c in line) / len(ws)), sum(w in list("#*$%&|<>") for w in ws) / len(ws), sum(c.isascii() and c.isupper() for c in line) / max(1, letters),
                min(1, line.count("!!") / len(ws)), float(line in lines[:i]), 1 - len(set(ws)) / len(ws), sum(a == b for a, b in zip(ws, ws[1:])) / len(ws), np.log(1 + len(ws)) / 5,
                min(2, size / len(ws) / 10), float(ws[-1][-1] in ".!?"), letters / size, sum(c.isascii() and c.isdigit() for c in line) / size, float(len(ws) <= 3),
            ])
        zero = [0.0] * len(quality_crf.OWN)
        for i in range(len(lines)):
            around = [1.0, *own[i], *(own[i - 1] if i else zero), *(own[i + 1] if i + 1 < len(own) else zero)]
            assert np.allclose(x[i], around, atol=1e-6)
        good = quality_crf.line_marginals([x], model)[0]
        want = sum(g * n for g, n in zip(good, sizes)) / sum(sizes) if len(sizes) else 0.7
        assert quality_crf.document_quality([text], model)[0] == pytest.approx(want)


def test_toxicity_on_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = Q.op8_toxicity(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    out = got[got.held_out]
    assert out[out.toxic == 0].predicted.mean() < 0.02 and out[out.toxic == 1].predicted.mean() > 0.68


@pytest.mark.skipif(not Path("/root/testdata/check_s").exists(), reason="needs more labels than the small tables have")
def test_toxicity_with_many_labels(spark):
    """What the README claims, on 4,000 held-out texts of a table with enough toxic documents to learn from."""
    from civicfeed.llm.common import train_bucket

    docs, labels = (spark.read.parquet(f"/root/testdata/check_s/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.filter(train_bucket("doc_id", 3) != 1))
    held_out = labels.filter((train_bucket("doc_id", 3) == 1) & F.col("toxic").isNotNull())
    held_out = docs.select("doc_id", "text").join(held_out, "doc_id").orderBy(F.xxhash64("doc_id")).limit(4000)
    out = toxicity.score(held_out, model).toPandas()
    assert out[out.toxic == 1].predicted.mean() > 0.97 and out[out.toxic == 0].predicted.mean() < 0.01


def test_unseen_spelling_shares_grams():
    texts_ = ["a nice day for all of us"] * 40 + ["you are an idiot my friend"] * 40
    model = toxicity.train([toxicity.bag(t, 3, 5, 1 << 17) for t in texts_], [0] * 40 + [1] * 40)
    assert model.score("what an idioot") > model.score("what an apple")


def test_subword_score_against_a_loop(texts):
    """A document's score from its words' n-grams, one by one."""
    import xxhash

    rng = np.random.default_rng(2)
    model = toxicity.SubwordModel(3, 5, rng.normal(size=1 << 12), -0.4, 3.0)

    def part(w):
        w = f"<{w.decode('utf-8', 'replace').lower()}>"
        grams = [w[i : j] for i in range(len(w)) for j in range(i + 3, min(i + 5, len(w)) + 1)] + ["=" + w]
        return sum(model.weight[xxhash.xxh3_64_intdigest(g) % (1 << 12)] for g in grams) / len(grams)

    for t in [*list(texts.values())[:40], None, "", " \n", "Ünï ÇÖDE \U0001f600"]:
        counts = Counter((t or "").encode().split())
        total = sum(n**0.5 * part(w) for w, n in counts.items())
        odds = model.scale * total / (sum(n**0.5 for n in counts.values()) + toxicity.NEUTRAL) + model.bias if counts else model.bias
        assert model.score(t) == pytest.approx(1 / (1 + np.exp(-odds)))
        own, share = toxicity.bag(t, 3, 5, 1 << 12)
        assert model.scale * float((model.weight[own] * share).sum()) + model.bias == pytest.approx(odds, abs=1e-4)


def test_training_against_plain_gradients():
    """The loss of the trained model is not far over that of a plain logistic fit of the same bags."""
    rng = np.random.default_rng(9)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(60)]
    y = rng.integers(0, 2, 300)
    docs_ = [" ".join(rng.choice(vocabulary[:40] if label else vocabulary[20:], 30)) for label in y]
    model = toxicity.train([toxicity.bag(t, 3, 5, 1 << 12) for t in docs_], y.tolist(), buckets=1 << 12)
    p = np.array([model.score(t) for t in docs_])
    assert ((p > 0.5) == y).mean() > 0.97

def test_language_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.op9_language(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/documents.parquet"), on="doc_id")
    out = got[got.held_out]
    assert (out.lang_pred == out.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_out_of_place_against_a_loop(texts):
    from civicfeed.llm.token_store import Recent

    def profile(text):
        counts = Counter()
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            w = f" {w} "
            counts.update(w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i : i + n] != " ")
        pack = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
        return [g for g, _ in sorted(((pack(g), n) for g, n in counts.items()), key=lambda x: (-x[1], x[0]))][:300]

    sample = [t for t in texts.values() if t][:12]
    ranks = {f"l{i}": profile(t) for i, t in enumerate(sample[:3])}
    model = language.Profiles.of(ranks)
    for t in sample[3:]:
        own = profile(t)
        far = {x: sum(min(300, abs(i - r.index(g))) if g in r else 300 for i, g in enumerate(own)) for x, r in ranks.items()}
        best = min(far, key=lambda x: (far[x], x))
        got = model.predict(t, Recent(1000))
        assert got[0] == best and abs(got[1] - (1 - far[best] / (300 * len(own)))) < 1e-12
    assert model.predict("12 !", Recent(10)) == ("und", 0.0) and model.predict(None, Recent(10)) == ("und", 0.0)


def test_classifiers_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for module, label in ((toxicity, "toxic"), (quality_crf, "quality")):
        for train, rows_ in ((odd, odd), (none, odd), (odd, none)):
            model = module.fit(train, labels, label)
            got = module.score(rows_, model).collect()
            assert len(got) == rows_.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    for train, rows_ in ((odd, odd), (none, odd), (odd, none)):
        got = language.identify(rows_, language.fit(train)).collect()
        assert len(got) == rows_.count() and all((r.lang_pred == "und") >= (not (r.text or "").strip()) for r in got)


# 10: language-model scores


def test_base_score(spark, sf_dir, texts):
    got = Q.op10_suffix_tree(spark, sf_dir).toPandas().set_index("doc_id")
    lower = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")
    tokens = {i: WORD.findall(lower(t)) + [None] for i, t in texts.items()}
    counts = Counter(w for i, ws in tokens.items() if held(i, 5) != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        x = got.loc[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held(i, 5) == 1, len(ws), sum(w in counts for w in ws), n)
        assert abs(x.base_score - sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) < 1e-6 * abs(x.base_score)


def test_tree_is_a_distribution_and_matches_a_plain_walk():
    texts = [b"the cat sat on the mat", b"the dog sat on the log", b"a cat and a dog"] * 5
    counts = suffix_tree.Counts()
    counts.add(suffix_tree.windows([suffix_tree.symbols(t.split()) for t in texts]))
    keys, n = counts.merged()
    levels = []
    for length in range(suffix_tree.DEPTH + 1):
        level = defaultdict(Counter)
        for k, c in zip(keys.tolist(), n.tolist(), strict=True):
            w = k.to_bytes(suffix_tree.DEPTH + 1, "big")
            level[w[suffix_tree.DEPTH - length : -1]][w[-1]] += c
        levels.append({c: dict(f) for c, f in level.items() if sum(f.values()) >= 2})
    tree = suffix_tree.grow(levels, 0.02)
    tree.start()
    for state in range(0, len(tree.contexts), 7):
        assert abs(sum(10 ** tree.move(state, s)[0] for s in range(256)) - 1) < 1e-9
    kept = set(tree.contexts)
    text = b"the cat and the log"
    history, total = b"\xff" * suffix_tree.DEPTH, 0.0
    for s in suffix_tree.symbols(text.split()):
        c = history[-suffix_tree.DEPTH :]
        while c not in kept:
            c = c[1:]
        total += tree.move(tree.number[c], s)[0]
        history += bytes([s])
    assert abs(total - tree.score(text.split())) < 1e-9


def test_kept_contexts_against_plain_counting(texts):
    """Which contexts stay, counted from the texts' symbols with no window arithmetic."""
    docs_ = [suffix_tree.symbols(suffix_tree.tokens(t)) for t in list(texts.values())[:60]]
    after = defaultdict(Counter)
    for d in docs_:
        padded = b"\xff" * suffix_tree.DEPTH + d
        for i in range(suffix_tree.DEPTH, len(padded)):
            for length in range(suffix_tree.DEPTH + 1):
                after[padded[i - length : i]][padded[i]] += 1
    after = {c: f for c, f in after.items() if sum(f.values()) >= suffix_tree.LEAST}
    kept = {b""}
    for c, f in after.items():
        if c:
            n, up = sum(f.values()), after[c[1:]]
            gain = sum(k / n * np.log((k / n) / (up[s] / sum(up.values()))) for s, k in f.items())
            if gain >= 0.05 and n * gain >= 2 * len(f) + 10:
                kept |= {c[i:j] for i in range(len(c)) for j in range(i + 1, len(c) + 1)}
    counts = suffix_tree.Counts()
    counts.add(suffix_tree.windows(docs_))
    levels = [defaultdict(Counter) for _ in range(suffix_tree.DEPTH + 1)]
    for k, n in zip(*(x.tolist() for x in counts.merged()), strict=True):
        w = k.to_bytes(suffix_tree.DEPTH + 1, "big")
        for length, level in enumerate(levels):
            level[w[suffix_tree.DEPTH - length : -1]][w[-1]] += n
    tree = suffix_tree.grow([{c: f for c, f in x.items() if sum(f.values()) >= suffix_tree.LEAST} for x in levels], 0.05)
    assert len(kept) > 100 and set(tree.contexts) == kept


@pytest.mark.parametrize("shared", [suffix_tree.WINDOWS, 20])
def test_scores_are_those_of_a_tree_of_all_contexts(spark, monkeypatch, shared):
    """Contexts seen 25 times among 18 million symbols count, and what is joined is as what is broadcast."""
    monkeypatch.setattr(suffix_tree, "WINDOWS", shared)
    learnt = ["word " * 60_000] * 60 + ["xqzj vk", "aqzm vk"] * 25 + ["the cat sat on the mat", "a dog"] * 10
    asked = ["xqzj vk", "aqzm", "the dog sat", "\xe9 new", "", None]
    counts = suffix_tree.Counts()
    counts.add(suffix_tree.windows([suffix_tree.symbols(suffix_tree.tokens(t)) for t in learnt]))
    levels = [defaultdict(Counter) for _ in range(suffix_tree.DEPTH + 1)]
    for k, c in zip(*(x.tolist() for x in counts.merged()), strict=True):
        w = k.to_bytes(suffix_tree.DEPTH + 1, "big")
        for length, level in enumerate(levels):
            level[w[suffix_tree.DEPTH - length : -1]][w[-1]] += c
    tree = suffix_tree.grow([{c: f for c, f in x.items() if sum(f.values()) >= 2} for x in levels], 0.05)
    assert b"xqz" in tree.contexts
    df = spark.createDataFrame([(i, t) for i, t in enumerate(learnt + asked)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.score for r in suffix_tree.lm_score(df, F.col("doc_id") < len(learnt)).collect()}
    for i in [0, *range(60, len(got))]:
        want = tree.score(suffix_tree.tokens((learnt + asked)[i]))
        assert abs(got[i] - want) < 1e-6 * abs(want)


def test_the_word_before_counts(spark):
    """A context that reaches into it needs no more divergence (0.08 nats here) than others."""
    learnt = ["a bx"] * 350 + ["a by"] * 150 + ["c bx"] * 150 + ["c by"] * 350
    df = spark.createDataFrame([(i, t) for i, t in enumerate(learnt + ["a bx", "a by"])], "doc_id long, text string")
    got = {r.text: r.score for r in suffix_tree.lm_score(df, F.col("doc_id") < len(learnt)).join(df, "doc_id").collect()}
    assert got["a bx"] - got["a by"] > 0.3


def test_tree_beats_the_base(spark):
    got = Q.op10_suffix_tree(spark, "/root/testdata/sf0.1").toPandas()
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()


def test_scores_of_odd_rows(spark, odd, none):
    got = suffix_tree.lm_score(odd, F.col("doc_id") % 2 == 1).toPandas()
    assert len(got) == len(ODD) and (got.score < 0).all() and got.held_out.sum() == 5
    assert suffix_tree.lm_score(none, F.lit(True)).count() == 0
    assert len(suffix_tree.lm_score(odd, F.lit(False)).collect()) == len(ODD)


# the pipeline


def test_pipeline_stages(spark, sf_dir, docs):
    import corpus_pipeline

    rows_ = docs
    for name, stage in corpus_pipeline.STAGES:
        before = rows_
        rows_ = stage(spark, before, sf_dir)
        if name != "byte_bpe":
            assert rows_.columns == docs.columns
        if name == "quality_rules":
            model = quality_rules.quality_rules(before).filter("kept").count()
            assert rows_.count() == model
        if name == "ngram_jaccard":
            data = [(r.doc_id, r.text) for r in before.collect()]
            assert {r.doc_id for r in rows_.collect()} == {c for _, c, _ in plain_links(data)}
        rows_ = spark.createDataFrame(rows_.toPandas(), rows_.schema) if name != "byte_bpe" else rows_
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = {r.doc_id: r.text for r in docs.collect()}
    for r in rows_.collect():
        ids = plain.encode_ordinary(own[r.doc_id])
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(own[r.doc_id].encode()).hexdigest()


def test_pipeline_on_odd_and_empty_rows(spark, odd, none, sf_dir):
    import corpus_pipeline

    base = odd.select("doc_id", "text", "lang", "source", F.col("score").alias("n_chars"))
    for rows_ in (base, base.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            got = stage(spark, rows_, sf_dir)
            assert got.count() <= 3 * max(1, rows_.count())
