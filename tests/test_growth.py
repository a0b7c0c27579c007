"""Work that must not grow with copies: distinct texts, places and vectors are worked on once."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from civicfeed.functions import text as T
from civicfeed.operators import address_search, corpus, dedup, geo, notify
from civicfeed.operators import addresses as A
from civicfeed.plans import catalog, overlay

from same import duck, rows


@pytest.fixture
def town(spark):
    data = [(i, "Город", "Район", f"улица Мира {i % 3}", str(i % 4 + 1), f"Город, улица Мира {i % 3}, {i % 4 + 1}", False) for i in range(60)]
    return spark.createDataFrame(data, "id long, city string, district string, street string, house string, address_text string, is_private boolean")


def counted(spark, kind):
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    return seen, F.udf(count, kind)


def test_equal_queries_are_scored_once(spark, town, monkeypatch):
    seen, count = counted(spark, "string")
    own = address_search.text_scores

    class Counting:
        def asNondeterministic(self):
            score = own.asNondeterministic()
            return lambda words, *more: score(count(F.col(words)), *[F.col(c) for c in more])

        def __call__(self, words, *more):
            return own(count(F.col(words)), *[F.col(c) for c in more])

    monkeypatch.setattr(address_search, "text_scores", Counting())
    asked = spark.createDataFrame([(i, "мира 1 дом 2" if i % 2 else "улица Мира") for i in range(50)], "query_id long, query string")
    got = address_search.search(asked, town, 3).collect()
    assert seen.value <= 12  # two texts and three streets
    for odd in (0, 1):
        answers = {i: [(r.rank, r.id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == i] for i in range(odd, 50, 2)}
        assert len(answers[odd]) == 3 and all(x == answers[odd] for x in answers.values())


def test_equal_hints_are_looked_up_once(spark, town, monkeypatch):
    seen, count = counted(spark, "array<string>")
    own = T.alias_keys
    monkeypatch.setattr(T, "alias_keys", lambda c: count(own(c)))
    hints = spark.createDataFrame([(i, f"улица Мира {i % 3}", str(i % 5 + 1)) for i in range(200)], "hint_id long, hint string, house string")
    got = {r.hint_id: (r.pin_id, r.geo_by) for r in A.lookup(hints, town).collect()}
    assert got == {i: (i % 3, "home" if i % 5 < 4 else "street") for i in range(200)}
    assert seen.value <= 24  # three hints and three streets, twice where they are saved


def test_prepared_addresses_with_agreeing_copies(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"copy (select c_custkey::BIGINT as c_custkey, 1 as c_nationkey, 'A' as c_mktsegment from (values (1), (2), (30001), (600)) x(c_custkey)) to '{tmp_path}/customer.parquet'")
    con.execute(f"copy (select 1 as n_nationkey, 'B' as n_name) to '{tmp_path}/nation.parquet'")
    for t in ("customer", "nation"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    got = catalog.QUERIES["c18_addresses"](spark, str(tmp_path)).toPandas()
    assert len(got) == 2 and rows(got) == rows(con.sql(catalog.ORACLE_SQL["c18_addresses"]).df())


def test_pairs_meet_by_key(spark, sf_dir):
    pairs = overlay.table(spark, sf_dir, "pairs")
    plan = spark._jvm.PythonSQLUtils.explainString(pairs._jdf.queryExecution(), "simple")
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert rows(pairs.toPandas()) == rows(duck(sf_dir).sql(overlay.SQL["pairs"]).df())


def test_nearest_at_shared_places(spark, monkeypatch):
    # 40 points at each of 9 places, 40 origins at one: distances are of places
    seen, count = counted(spark, "double")
    own = geo.R.haversine
    monkeypatch.setattr(geo.R, "haversine", lambda *at: count(own(*at)))
    spots = [(55.7 + i / 1000, 37.6 + j / 1000) for i in range(3) for j in range(3)]
    points = spark.createDataFrame([(n * 9 + s, *spots[s], "x") for n in range(40) for s in range(9)], "id long, lat double, lon double, street string")
    origins = spark.createDataFrame([(n, *spots[4], "x") for n in range(40)], "origin_id long, o_lat double, o_lon double, o_street string")
    got = {(r.origin_id, r["rank"]): r.id for r in geo.nearest(points, origins, 45, 2000.0).collect()}
    d2 = lambda s: (spots[s][0] - spots[4][0]) ** 2 + ((spots[s][1] - spots[4][1]) * math.cos(math.radians(spots[4][0]))) ** 2
    want = [i for _, i in sorted((d2(i % 9), i) for i in range(360))][:45]
    assert all([got[n, k + 1] for k in range(40)] == want[:40] for n in range(40)) and len(got) == 40 * 45
    assert seen.value <= 40


def test_circles_of_a_place_once(spark):
    rows_ = spark.createDataFrame([(1, 55.7, 37.6), (2, 55.7, 37.6), (3, None, 37.6)], "id long, lat double, lon double")
    got = {r.id: r.circle for r in geo.circles(rows_, 800.0).collect()}
    want = rows_.select("id", geo.R.circle(F.col("lat"), F.col("lon"), 800.0).alias("circle")).collect()
    assert got == {r.id: r.circle for r in want}
    assert "Join" in geo.circles(rows_, 800.0)._sc._jvm.PythonSQLUtils.explainString(geo.circles(rows_, 800.0)._jdf.queryExecution(), "simple")


def test_negatives_without_a_global_sort(spark):
    pool = spark.range(20_000).withColumnRenamed("id", "k").unionByName(spark.createDataFrame([(None,), (7,)], "k long"))
    own = spark.range(-901, 0).withColumnRenamed("id", "k")
    df = corpus.negatives_to_ratio(own, pool, 3.7, "k", 5)
    order = F.md5(F.concat(F.lit("5:"), F.col("k").cast("string")).cast("binary"))
    want = [r.k for r in pool.orderBy(order, "k").limit(int(901 * 3.7)).collect()]
    key = lambda k: (k is not None, k or 0)
    assert sorted((r.k for r in df.filter("k IS NULL OR k >= 0").collect()), key=key) == sorted(want, key=key)
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple").replace("WindowGroupLimit", "")
    assert "Limit" not in plan and "TakeOrdered" not in plan


def test_trigrams_of_equal_texts_once(spark, monkeypatch):
    own, seen = corpus._trigrams, []
    monkeypatch.setattr(corpus, "_trigrams", lambda texts, *more: (seen.append(texts), own(texts, *more))[1])
    rows_ = spark.createDataFrame([(i, f"Notice {i % 3}") for i in range(90)] + [(90, "ab"), (91, "")], "id long, text string")
    got = corpus.trigram_embedding(rows_, "id").groupBy("id").agg(F.round(F.sum(F.col("value") ** 2), 9).alias("s")).collect()
    assert len(got) == 92 and {r.s for r in got} == {1.0}
    assert seen[0].count() == 5


def test_recipients_without_a_distinct_of_all(spark):
    events = spark.createDataFrame([(1, "city", 1), (2, "home", 1), (3, "street", 3), (4, "city", 1), (4, "home", 2), (5, "other", 1)], "id long, geo_by string, address_id long")
    a = spark.createDataFrame([(1, "A", "s"), (2, "A", "t"), (3, "B", "s")], "id long, city string, street string")
    m = spark.createDataFrame([(10, 1, 1, "chat"), (10, 1, 2, "chat"), (11, 1, 2, "chat"), (12, 1, 3, "chat"), (13, 1, 1, "removed")], "user_id long, chat_id long, address_id long, chat_type string")
    got = sorted((r.event_id, r.user_id) for r in notify.recipients(events, a, m).collect())
    assert got == [(1, 10), (1, 11), (2, 10), (3, 12), (4, 10), (4, 11)]


def test_equal_events_meet_drafts_once(spark, monkeypatch):
    own, seen = dedup._meet, []
    monkeypatch.setattr(dedup, "_meet", lambda d, e, *more: (seen.append((d.count(), e.count())), own(d, e, *more))[1])
    rows_ = spark.createDataFrame([(i, i % 3 or None, [1.0, float(i % 4)]) for i in range(240)], "id long, address_id long, v array<double>")
    got = {r.draft_id: (r.best_id, r.score) for r in dedup.best_matches(rows_.filter("id % 2 = 0"), rows_.filter("id % 2 = 1")).collect()}
    assert len(got) == 120 and seen == [(6, 6)]
    assert got[0] == got[12] == got[24]


def shuffled(spark):
    """Rows that this session's stages have shuffled so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_pairs_within_a_radius_shuffle_places(spark, tmp_path, monkeypatch):
    # 60 addresses at each of six places, three of them near each other (keys 10,000 apart stand at one place), and one null
    seen, count = counted(spark, "double")
    own = geo.R.haversine
    monkeypatch.setattr(geo.R, "haversine", lambda *at: count(own(*at)))
    con = duckdb.connect()
    keys = [k + 10_000 * n for k in (0, 4022, 5627, 1, 2, 3) for n in range(60)]
    con.execute(f"copy (select unnest({keys} || [NULL])::BIGINT as c_custkey, 1 as c_nationkey, 'A' as c_mktsegment) to '{tmp_path}/customer.parquet'")
    con.execute(f"copy (select 1 as n_nationkey, 'B' as n_name) to '{tmp_path}/nation.parquet'")
    for t in ("customer", "nation"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    want = rows(con.sql(catalog.ORACLE_SQL["j3_within_radius"]).df())
    before = shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large for it
    try:
        got = catalog.QUERIES["j3_within_radius"](spark, str(tmp_path)).toPandas()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows(got) == want and len(want) >= 6 * 60 * 60
    assert shuffled(spark) - before <= 4 * len(keys)  # each address once, and nine tiles for a place; not 45 cells for an address
    assert seen.value <= 2 * (6 * math.ceil(60 / geo.IDS)) ** 2  # of arrays


@pytest.mark.parametrize("points, ids", [(geo.POINTS, geo.IDS), (4, 3)])
def test_pairs_within_a_radius_in_slices(spark, monkeypatch, points, ids):
    # across the meridian of 180 degrees; 25 points at one place, so tiles and arrays are cut
    monkeypatch.setattr(geo, "POINTS", points)
    monkeypatch.setattr(geo, "IDS", ids)
    at = [(-17 + i / 400, (179.97 + i / 300 + 180) % 360 - 180) for i in range(25)] + [(-16.99, 180.0), (-16.99, -180.0)] + [(-16.98, 179.99)] * 25 + [(None, 179.99), (-16.98, None)]
    got = geo.pairs_within(spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "id long, lat double, lon double"), 2000.0).collect()

    def metres(a, b):
        (la, lo), (lb, lp) = ([math.radians(x) for x in p] for p in (a, b))
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
        return 2 * 6_371_000 * math.asin(min(1.0, math.sqrt(h)))

    want = {(i, j): metres(p, q) for i, p in enumerate(at[:-2]) for j, q in enumerate(at[:-2]) if metres(p, q) <= 2000}
    assert len(got) == len(want) > 25 * 25 and all(abs(r.distance - want[r.origin_id, r.id]) < 1e-6 for r in got)
