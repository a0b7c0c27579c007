"""Address search and street lookup against plain loops over all pairs, on a small catalogue."""

import pytest
from pyspark.sql import functions as F

from civicfeed.functions.likeness import indel_ratio, partial_ratio, token_set_ratio, weighted_ratio
from civicfeed.operators import address_search as S
from civicfeed.operators import addresses as A

STREETS = [
    ("Ростокино", "Сельскохозяйственная улица"), ("Останкинский", "улица Академика Королёва"), ("Пресненский", "улица 1905 года"),
    ("Тверской", "1-я Тверская-Ямская улица"), ("Арбат", "Новый Арбат"), ("Арбат", "улица Арбат"), ("Хамовники", "Комсомольский проспект"),
    ("Хамовники", "улица Льва Толстого"), ("Тверской", "Тверская улица"), ("Мещанский", "проспект Мира"),
]
HOUSES = ["15 к1", "17", "15", "10", "12", "2", "2 с1", "1/2"]
QUERIES = [
    "сельск", "сельск 15", "росток сельск", "15 королева", "королёва академика", "1905 года", "улица 1905 года 10", "1 тверская 12", "тверскаа", "тверская дом 2",
    "арбат", "сельск 15к1", "сельск 15/1", "арбат дом 99", "комсомольский пр-т 17", "льва толстог", "проспект мира дом 2 строение 1", "мира 15 корпус 1",
    "москва", "москва мира", "ab", "", None, "совсем другое место",
]


@pytest.fixture(scope="module")
def catalogue(spark):
    rows = []
    for i, (district, street) in enumerate(STREETS):
        for j, house in enumerate(HOUSES[i % 3 :]):
            n = 100 * i + j
            rows.append((n, "Москва", district, street, house, f"Москва, {street}, д. {house}", n % 17 == 5, 55.7, 37.6))
    rows.append((9001, "Москва", None, "проспект Мира", "77", "Москва, проспект Мира, д. 77", None, 55.7, 37.6))
    rows.append((9002, "Москва", "Мещанский", None, "78", "Москва, д. 78", None, 55.7, 37.6))
    rows.append((9003, "Москва", "Мещанский", "проспект Мира", None, "Москва, проспект Мира", None, 55.7, 37.6))
    return spark.createDataFrame(rows, "id long, city string, district string, street string, house string, address_text string, is_private boolean, lat double, lon double")


def test_ratios():
    assert indel_ratio("this is a test", "this is a test!") == pytest.approx(96.5517241)
    assert partial_ratio("this is a test", "this is a test!") == 100
    assert token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert token_set_ratio("fuzzy was a bear but not a dog", "fuzzy was a bear but not a cat") == pytest.approx(92.3076923)
    assert weighted_ratio("this is a test", "this is a new test!!!") == pytest.approx(85.5)
    assert partial_ratio("", "x") == 0 and weighted_ratio("", "x") == 0 and token_set_ratio("", "") == 0


@pytest.mark.parametrize(
    "text,want",
    [
        ("тверская дом 15 корпус 1 строение 2", ("тверская 15 1 2", "тверская", "15к1с2", True)),
        ("тверская 15 корпус 1", ("тверская 15 1", "тверская", "15к1", True)),
        ("15 строение 2 тверская корпус 3", ("15 2 тверская 3", "15 тверская", "2к3с2", True)),
        ("тверская 15", ("тверская 15", "тверская", "15", False)),
        ("15 тверская", ("15 тверская", "тверская", "15", False)),
        ("1 я тверская", ("1 я тверская", "1 я тверская", None, False)),
        ("1 я тверская 12", ("1 я тверская 12", "1 я тверская", "12", False)),
        ("улица 1905 года 10", ("1905 года 10", "1905 года", "10", False)),
        ("10 1905 года", ("10 1905 года", "10 1905 года", None, False)),
        ("12", ("12", "12", None, False)),
        ("дом", ("дом", "", None, False)),
    ],
)
def test_query_parts(text, want):
    assert S.query_parts(text) == want


def grams(words):
    """What words share that can find each other: numbers whole, else three letters, the first marked."""
    return {g for w in words for g in (["=" + w] if w.isdigit() or len(w) < 2 else [("#" + w)[i : i + 3] for i in range(max(1, len(w) - 1))])}


def plain(queries, rows, norm, house_search, house_keys, house):
    """Every query against every address that shares a letter group with it."""
    out = []
    for n, query in enumerate(queries):
        q = norm[query]
        if len(q) < 3:
            continue
        words, bare, asked, named = S.query_parts(q)
        found = []
        for r in rows:
            if r.is_private or not r.house or not r.street:
                continue
            at = [norm[x] for x in (r.city, r.district, r.street)]
            if not grams(set(words.split()) - {"москва"}) & grams(set(" ".join(at).split()) - set(S.STOPS)):
                continue
            whole, text = S.text_score(words, *at), S.text_score(bare, *at)
            score = whole
            if asked:
                mine, theirs = house_search[asked], house_search[r.house]
                fit = 100 if mine == theirs else 88 if not set("кс") & set(mine) and mine in house_keys[r.house] else 0
                by_house = min(100, 0.72 * text + 0.28 * fit + (1.5 if named else 1.0)) if fit and text is not None else None
                loose = [x for x in (whole, by_house) if x is not None]
                score = by_house if named else max(loose) if loose and (fit or house[asked] in S.meaningful(at[2])) else None
            if score is not None and score >= 58:
                found.append((-round(score, 9), norm[r.address_text], r.id))
        out += [(n, rank, i) for rank, (_, _, i) in enumerate(sorted(found)[:12], 1)]
    return out


def test_search_against_all_pairs(spark, catalogue):
    rows = catalogue.collect()
    texts = {x for r in rows for x in (r.city, r.district, r.street, r.address_text)} | set(QUERIES) | {""}
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    norm = {r.t: r.n for r in frame.select("t", S.T.search_text(F.coalesce("t", F.lit(""))).alias("n")).collect()}
    asked = {S.query_parts(q)[2] for q in norm.values()} | {r.house for r in rows}
    h = spark.createDataFrame([(x,) for x in asked if x], "t string")
    h = h.select("t", S.T.house_search(F.col("t")).alias("s"), S.T.house_keys(F.col("t")).alias("k"), S.T.house(F.col("t")).alias("h")).collect()
    want = plain(QUERIES, rows, norm, {r.t: r.s for r in h}, {r.t: r.k for r in h}, {r.t: r.h for r in h})
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")
    got = sorted((r.query_id, r["rank"], r.id) for r in S.search(queries, catalogue).collect())
    by_query = {n: [x for x in want if x[0] == n] for n in range(len(QUERIES))}
    for n, q in enumerate(QUERIES):
        if q != "москва":  # a city alone asks its rarest letter group, which all its streets have
            assert [x for x in got if x[0] == n] == by_query[n], q
    first = {QUERIES[n]: i for n, rank, i in got if rank == 1}
    named = {r.id: (r.street, r.house) for r in rows}
    assert named[first["сельск 15"]] == ("Сельскохозяйственная улица", "15") and named[first["1905 года"]][0] == "улица 1905 года"
    assert named[first["сельск 15/1"]] == named[first["сельск 15к1"]] == ("Сельскохозяйственная улица", "15 к1") and "арбат дом 99" not in first
    assert named[first["тверскаа"]][0] in ("Тверская улица", "1-я Тверская-Ямская улица")
    assert S.search(queries.limit(0), catalogue).count() == 0 and S.search(queries, catalogue.limit(0)).count() == 0


def test_lookup_against_all_pairs(spark, catalogue):
    hints = ["Сельскохозяйственной улице", "Сельскохозяйственная", "Арбат", "Новый Арбат", "Королёва", "Академика Королева", "Толстого", "Тверская улица", "Тверская", "сельхоз", "Комсомольскийй", "Комсамольский", "Мир", "Мира", "", None, "1905 года", "Сельскохозяственная"]
    rows = [(n, h, ["2", "15к1", "99", None][n % 4]) for n, h in enumerate(hints)]
    asked = spark.createDataFrame(rows, "hint_id long, hint string, house string")
    got = {r.hint_id: (r.pin_id, r.address_id) for r in A.lookup(asked, catalogue).collect()}
    entries = A.street_entries(catalogue).collect()
    keys = {r.hint_id: r.k for r in asked.select("hint_id", A.T.alias_keys(F.col("hint")).alias("k")).collect()}
    at = {}
    for r in catalogue.filter("street IS NOT NULL").select("id", "street", A.T.house_keys(F.col("house")).alias("k")).collect():
        for k in r.k:
            at[r.street, k] = min(r.id, at.get((r.street, k), r.id))
    wanted_houses = {r.hint_id: r.k for r in asked.select("hint_id", A.T.house_keys(F.col("house")).alias("k")).collect()}

    def top(scores):
        best = max(scores.values())
        winners = [p for p, s in scores.items() if s == best]
        return winners[0] if len(winners) == 1 else None

    longest = lambda ks: min(ks, key=lambda k: (-len(k), k))
    for n, hint, _ in rows:
        mine, pin = keys[n] or [], None
        equal = {e.pin_id: len(set(mine) & set(e["keys"])) for e in entries if set(mine) & set(e["keys"])}
        inside = {}
        for e in entries:
            lengths = [min(len(a), len(b)) for a in mine for b in e["keys"] if a != b and len(a) >= 4 and len(b) >= 4 and (a in b or b in a)]
            if lengths:
                inside[e.pin_id] = max(lengths)
        if equal:
            pin = top(equal)
        elif inside:
            pin = top(inside)
        elif mine and len(longest(mine)) >= 4:
            whole = lambda ks: [k for k in ks if " " not in k or all(len(w) >= 3 for w in k.split())] or ks
            scores = sorted(((weighted_ratio(longest(mine), longest(whole(e["keys"]))), e.pin_id) for e in entries), reverse=True)
            pin = scores[0][1] if scores[0][0] >= 82 and scores[0][0] - scores[1][0] >= 5 else None
        street = next((e.street for e in entries if e.pin_id == pin), None)
        house = next((at[street, k] for k in wanted_houses[n] or [] if (street, k) in at), None)
        assert got.get(n) == ((pin, house) if pin is not None else None), hint


def test_distinct_streets_of_a_text(spark, catalogue):
    hints = spark.createDataFrame([(1, 10, "Новый Арбат", None), (1, 11, "Новый Арбат", "2"), (1, 12, "Тверская улица", "99"), (2, 13, "нет такой", "1")], "text_id long, hint_id long, hint string, house string")
    got = {(r.text_id, r.street, r.geo_by) for r in A.lookup_all(hints, catalogue).collect()}
    assert got == {(1, "Новый Арбат", "home"), (1, "Тверская улица", "street")}
