"""The address catalogue: hierarchy, lookup by street and house, binding of events, matching of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T
from ..functions.likeness import indel_ratio, weighted_ratio
from .lineage import saved
from .records import by_margin, split_conflicts


def hierarchy(addresses: DataFrame, postal_code: str | None = None) -> DataFrame:
    """C17: distinct cities, districts, streets and houses with how many addresses each has; private houses are left out."""
    rows = addresses.filter(~F.coalesce("is_private", F.lit(False)))
    if postal_code is not None:
        rows = rows.filter(F.col("postal_code") == postal_code)
    return rows.rollup("city", "district", "street", "house").agg(F.count("*").alias("n"), F.grouping_id().alias("g")).filter(F.col("city").isNotNull())


def street_entries(addresses: DataFrame) -> DataFrame:
    """One row for each street of each city: its least address id and the keys under which it is found.

    The keys are those of an aggregate and not of a grouping column: else filters on them go down to every address.
    """
    streets = addresses.filter(F.col("street").isNotNull()).groupBy("city", "street").agg(F.min("id").alias("pin_id"), F.max("street").alias("keys"))
    return streets.withColumn("keys", T.alias_keys(F.col("keys")))


def _pieces(key: Column, n: int, first_only: bool = False) -> Column:
    """The runs of ``n`` letters of a key, or its first one."""
    if first_only:
        return F.array(F.left(key, F.lit(n)))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - (n - 1), F.lit(1))), lambda i: F.substr(key, i, F.lit(n))))


@F.pandas_udf(DoubleType())
def likeness_of(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """K29's weighted ratio of two columns."""
    for x, y in pairs:
        yield pd.Series([weighted_ratio(p or "", q or "") for p, q in zip(x, y, strict=True)])


def lookup(hints: DataFrame, addresses: DataFrame, least: float = 82.0, margin: float = 5.0) -> DataFrame:
    """Hints (hint_id, hint, house) to one street each, and to the house there if it exists.

    In turn, the first step that finds streets decides, and if it finds several that are equally good there is none:
    equal keys, most of them first; keys of four letters or more that contain one another, the longest shared first;
    the likeness of the longest key to each street's own longest key, if ``least`` is reached and the next is
    ``margin`` behind. Keys that contain one another share the first four letters of the shorter one, and like ones
    three letters in a row, so that both steps are equi joins. Hints of one text are looked up once.
    """
    entries = saved(street_entries(addresses))
    # up to the houses a hint is its text
    asked = hints.groupBy(F.col("hint").alias("hint_id")).agg(F.max("hint").alias("keys"))
    asked = saved(asked.withColumn("keys", T.alias_keys(F.col("keys")))).filter(F.size("keys") > 0)
    flat = lambda df: df.select("hint_id", F.explode("keys").alias("key"))
    known = entries.select("pin_id", F.explode("keys").alias("known"))

    def best(found: DataFrame, score: str) -> DataFrame:
        """(hint_id, pin_id, alone): the streets of the highest score, and whether it is one."""
        top = found.groupBy("hint_id", "pin_id").agg(F.max(score).alias("s")).groupBy("hint_id", "s").agg(F.count("*").alias("n"), F.min("pin_id").alias("pin_id"))
        return top.groupBy("hint_id").agg(F.max_by(F.struct("pin_id", (F.col("n") == 1).alias("alone")), "s").alias("x")).select("hint_id", "x.*")

    equal = flat(asked).join(known, F.col("key") == F.col("known")).groupBy("hint_id", "pin_id").agg(F.count("*").alias("same"))
    exact = best(equal, "same")
    left = asked.join(exact, "hint_id", "left_anti")

    long_ = lambda c: F.length(c) >= 4
    ours = flat(left).filter(long_("key"))
    theirs = known.filter(long_("known"))
    within = ours.withColumn("g", F.explode(_pieces(F.col("key"), 4, True))).join(theirs.withColumn("g", F.explode(_pieces(F.col("known"), 4))), "g").filter(F.contains("known", "key"))
    around = ours.withColumn("g", F.explode(_pieces(F.col("key"), 4))).join(theirs.withColumn("g", F.explode(_pieces(F.col("known"), 4, True))), "g").filter(F.contains("key", "known"))
    parts = within.unionByName(around).filter("key <> known").withColumn("length", F.least(F.length("key"), F.length("known")))
    contained = best(parts, "length")
    left = left.join(contained, "hint_id", "left_anti")

    # a street's longest key without short words, if it has one, stands for it
    longest = lambda keys: F.array_sort(keys, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).otherwise(F.when(a < b, -1).when(a > b, 1).otherwise(0)))[0]
    whole = F.filter("keys", lambda k: ~k.contains(" ") | F.forall(F.split(k, " "), lambda w: F.length(w) >= 3))
    choices = entries.select("pin_id", F.coalesce(F.get(F.array(longest(whole)), 0), longest(F.col("keys"))).alias("known"))
    wanted = left.select("hint_id", longest(F.col("keys")).alias("key")).filter(long_("key"))
    padded = lambda c: _pieces(F.concat(F.lit("^"), F.col(c), F.lit("$")), 3)
    pairs = wanted.withColumn("g", F.explode(padded("key"))).join(choices.withColumn("g", F.explode(padded("known"))), "g").select("hint_id", "key", "pin_id", "known").distinct()
    alike = pairs.withColumn("s", likeness_of("key", "known")).select("hint_id", "pin_id", "s")
    fuzzy = by_margin(alike, ["hint_id"], "s", least, margin).select("hint_id", "pin_id", F.col("s").alias("score"))

    sure = lambda df: df.filter("alone").select("hint_id", "pin_id", F.lit(100.0).alias("score"))
    found = sure(exact).unionByName(sure(contained)).unionByName(fuzzy.withColumn("score", F.lit(100.0)))
    hit = found.withColumnRenamed("hint_id", "hint").join(hints.select("hint_id", "hint", "house"), "hint").drop("hint").join(entries.select("pin_id", "city", "street"), "pin_id")
    keyed = hit.withColumns({"h": T.house_keys(F.col("house"))}).select("*", F.posexplode_outer("h").alias("turn", "hk"))
    houses = addresses.select("city", "street", F.col("id").alias("address_id"), F.explode(T.house_keys(F.col("house"))).alias("hk")).groupBy("city", "street", "hk").agg(F.min("address_id").alias("address_id"))
    at = keyed.join(houses, ["city", "street", "hk"], "left")
    first = at.groupBy("hint_id", "city", "street", "pin_id").agg(F.min_by("address_id", F.when(F.col("address_id").isNotNull(), F.col("turn"))).alias("address_id"))
    return first.withColumn("geo_by", F.when(F.col("address_id").isNotNull(), "home").otherwise("street"))


def lookup_all(hints: DataFrame, addresses: DataFrame) -> DataFrame:
    """The distinct streets that a text's hints (text_id, hint_id, hint, house) lead to; a hit with a house comes before one without."""
    found = lookup(hints.select("hint_id", "hint", "house"), addresses).join(hints.select("hint_id", "text_id"), "hint_id")
    w = Window.partitionBy("text_id", "pin_id").orderBy(F.col("geo_by") != "home", "hint_id")
    return found.withColumn("n", F.row_number().over(w)).filter("n = 1").select("text_id", "pin_id", "city", "street", "address_id", "geo_by")


def bind(drafts: DataFrame, addresses: DataFrame) -> DataFrame:
    """(draft_id, city, street, house) to an address: house, else street (houses first, least id), else city (least id)."""
    a = addresses.select(F.col("id").alias("aid"), F.col("city").alias("c"), T.street_name(F.col("street")).alias("s"), T.house(F.col("house")).alias("h"))
    d = drafts.withColumns({"ks": T.street_name(F.col("street")), "kh": T.house(F.col("house"))})
    homes = a.groupBy("c", "s", "h").agg(F.min("aid").alias("home_id"))
    streets = a.groupBy("c", "s").agg(F.min_by("aid", F.struct(F.col("h").isNull(), "aid")).alias("street_id"))
    cities = a.groupBy("c").agg(F.min("aid").alias("city_id"))
    out = d.join(homes, (F.col("city") == homes.c) & (F.col("ks") == homes.s) & (F.col("kh") == homes.h), "left").drop("c", "s", "h")
    out = out.join(streets, (F.col("city") == streets.c) & (F.col("ks") == streets.s), "left").drop("c", "s")
    out = out.join(cities, F.col("city") == cities.c, "left").drop("c")
    geo = F.when(F.col("home_id").isNotNull(), "home").when(F.col("street_id").isNotNull(), "street").when(F.col("city_id").isNotNull(), "city")
    return out.select("draft_id", F.coalesce("home_id", "street_id", "city_id").alias("address_id"), geo.alias("geo_by"))


def fan_out(notices: DataFrame) -> DataFrame:
    """(msg_id, address_ids) to a row for each address; ids get a suffix only where there are several."""
    many = F.size("address_ids") > 1
    rows = notices.select("*", F.explode("address_ids").alias("address_id"))
    return rows.withColumn("source_msg_id", F.when(many, F.concat(F.col("msg_id"), F.lit(":addr:"), F.col("address_id").cast("string"))).otherwise(F.col("msg_id")))


def natural_order(house: Column) -> Column:
    return T.natural_key(house)


def match_postcodes(addresses: DataFrame, points: DataFrame, metres: float = 100.0) -> DataFrame:
    """Address to the one register point (guid, street, house, lat, lon, postal_code) with its street words and house within
    a distance: its guid and postcode. Several points, or a code that is not six digits, give none.
    """
    from ..functions import ranking as R

    a = addresses.select(F.col("id"), "lat", "lon", T.street_key(F.col("street")).alias("k"), T.house(F.col("house")).alias("h"))
    p = points.select(T.street_key(F.col("street")).alias("k"), T.house(F.col("house")).alias("h"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), "guid", "postal_code")
    close = a.join(p, ["k", "h"]).filter(R.haversine(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon")) <= metres)
    one = close.groupBy("id").agg(F.min("guid").alias("gar_guid"), F.max("guid").alias("other"), F.min_by("postal_code", "guid").alias("postal_code"))
    return one.filter((F.col("gar_guid") == F.col("other")) & F.col("postal_code").rlike("^[0-9]{6}$")).drop("other")


def street_score(street: str, words: list[str]) -> float:
    """The best likeness of a street to as many words in a row, where both have the same numbers."""
    want = street.split()
    digits = lambda t: "".join(c if c.isdigit() else " " for c in t).split()
    best = 0.0
    for i in range(len(words) - len(want) + 1):
        part = " ".join(words[i : i + len(want)])
        if digits(part) == digits(street):
            best = max(best, indel_ratio(street, part))
    return best


@F.pandas_udf(DoubleType())
def likeness(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """``street_score`` as a column of a street and a text."""
    for x, y in pairs:
        yield pd.Series([street_score(p or "", (q or "").split()) for p, q in zip(x, y, strict=True)])


def match_text(texts: DataFrame, addresses: DataFrame, threshold: float = 90.0, margin: float = 5.0) -> DataFrame:
    """(text_id, text) to the one address that its house and street name, by likeness.

    Candidates have the text's house number and a letter group of its words; the best must reach ``threshold`` and lead the next by ``margin``. A
    text with several houses or postcodes names none.
    """
    number = r"(?U)\bдом\s+([0-9]+[а-я]?(?:/[0-9]+[а-я]?)?)"
    norm = T.address_text(F.col("text"))
    rows = texts.withColumns({"norm": norm, "houses": F.regexp_extract_all(norm, F.lit(number), F.lit(1)), "codes": T.postcodes(F.col("text"))})
    rows = rows.filter((F.size("houses") == 1) & (F.size("codes") <= 1)).withColumns({"h": F.get("houses", F.lit(0)), "code": F.get("codes", F.lit(0))})
    types = F.array(*[F.lit(t) for t in T.STREET_TYPES])
    named = F.array_join(F.array_except(F.split(T.address_text(F.col("street")), " "), types), " ")
    known = addresses.select("id", "postal_code", T.house(F.col("house")).alias("h"), named.alias("name")).filter("name <> ''")
    bare = F.array_join(F.filter(F.split(F.regexp_replace("norm", number, " "), " "), lambda w: ~F.array_contains(types, w) & (w != "")), " ")
    # a name cut in as many parts as edits are allowed and one more has a part that no edit touches: its letter groups are asked for
    n = F.length("name")
    edits = F.floor((1 - threshold / 100) * 2 * n / (threshold / 100)) if threshold > 0 else n
    known = known.withColumn("width", F.greatest(F.lit(1), F.least(F.lit(3), F.floor(n / (edits + 1)).cast("int"))))
    groups = lambda c, w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - w + 1, F.lit(1))), lambda i: F.substr(c, i, w)))
    known = known.withColumn("gram", F.explode(groups(F.col("name"), F.col("width"))))
    rows = rows.withColumn("bare", bare).filter("bare <> ''")
    asked = rows.withColumn("gram", F.explode(F.array_union(F.array_union(groups(F.col("bare"), F.lit(1)), groups(F.col("bare"), F.lit(2))), groups(F.col("bare"), F.lit(3)))))
    pairs = asked.join(known, ["h", "gram"]).filter(F.col("code").isNull() | (F.col("code") == F.col("postal_code")))
    pairs = pairs.select("text_id", "id", "name", "bare").distinct()
    scored = pairs.withColumn("score", likeness("name", "bare")).select("text_id", F.col("id").alias("address_id"), "score")
    return by_margin(scored, ["text_id"], "score", threshold, margin)


def article_places(articles: DataFrame, addresses: DataFrame, local_outlets: dict[str, str]) -> DataFrame:
    """Articles (id, outlet, text, city, street, house) to (id, address_id, geo_by), those with a place only.

    Articles about elsewhere have none. Then, by the first that gives one: the source's own fields, if in the
    project's cities; a postcode of the text; a street that the text hints at, where the outlet is local or the
    text names the city; the city, where the text names it; the city of a local outlet.
    """
    from ..functions import ranking as R
    from ..functions import rules

    default = R.pick(F.col("outlet"), local_outlets, None).cast("string")
    here = articles.filter(~F.coalesce(rules.elsewhere(F.col("text")), F.lit(False))).withColumns({"cf_city": default, "cf_named": F.coalesce(rules.in_moscow(F.col("text")), F.lit(False))})
    own = here.filter(rules.project_city(F.col("city"))).select(F.col("id").alias("draft_id"), "city", "street", "house")
    by_fields = bind(own, addresses).select(F.col("draft_id").alias("id"), F.lit(1).alias("turn"), "address_id", "geo_by")
    codes = addresses.filter(F.col("postal_code").isNotNull()).groupBy("postal_code").agg(F.min("id").alias("address_id"))
    near = here.filter(F.col("cf_city").isNotNull() | F.col("cf_named"))
    by_code = near.select("id", F.explode(T.postcodes(F.col("text"))).alias("postal_code")).join(codes, "postal_code").groupBy("id").agg(F.min("address_id").alias("address_id"))
    by_code = by_code.select("id", F.lit(2).alias("turn"), "address_id", F.lit("street").alias("geo_by"))
    hints = near.select("id", T.house_in_text(F.col("text")).alias("house"), F.posexplode(rules.local_hints(T.street_hints(F.col("text")))).alias("place", "hint"))
    named = hints.withColumn("hint_id", F.concat_ws("/", F.col("id").cast("string"), F.col("place").cast("string")))
    found = lookup(named.select("hint_id", "hint", "house"), addresses)
    ranked = found.join(named.select("hint_id", "id", "place"), "hint_id")
    best = ranked.groupBy("id").agg(F.min_by(F.struct(F.coalesce("address_id", "pin_id").alias("a"), "geo_by"), F.struct(F.col("geo_by") != "home", "place")).alias("x"))
    by_hint = best.select("id", F.lit(3).alias("turn"), F.col("x.a").alias("address_id"), F.col("x.geo_by").alias("geo_by"))
    cities = addresses.groupBy("city").agg(F.min("id").alias("address_id"))
    wanted = here.select("id", F.coalesce(F.when(F.col("cf_named"), F.lit("Москва")), "cf_city").alias("city")).filter("city IS NOT NULL")
    by_city = wanted.join(cities, "city").select("id", F.lit(4).alias("turn"), "address_id", F.lit("city").alias("geo_by"))
    every = by_fields.unionByName(by_code).unionByName(by_hint).unionByName(by_city).filter("address_id IS NOT NULL")
    first = every.groupBy("id").agg(F.min_by(F.struct("address_id", "geo_by"), "turn").alias("x"))
    return first.select("id", "x.address_id", "x.geo_by")


def to_drafts(candidates: DataFrame) -> DataFrame:
    """C4: candidates (id, source, source_msg_id, raw_text, title, body, published_at) to drafts: title and body, importance, window."""
    from ..functions import rules, windows

    both = T.title_and_body(F.col("raw_text"), F.col("title"), F.col("body"))
    rows = candidates.withColumn("tb", both).withColumn("full", F.concat_ws(" ", "tb.title", "tb.body"))
    rows = rows.withColumns({"r": rules.importance(F.col("full")), "w": windows.window(F.col("full"), F.col("published_at"))})
    return rows.select("id", "source", "source_msg_id", "tb.title", "tb.body", "r.importance", "r.disaster_flag", "published_at", "w.active_from", "w.active_to")


def prepare(rows: DataFrame, bounds: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, rejected, report) of address rows (source_key, address_text, city, street, house, lat, lon, postal_code, is_private).

    Texts whose rows disagree are rejected whole; the others get the district that they lie in, and where they have no
    postcode that of the one register point at their house. ``n`` counts an accepted text's rows. The report is one row of counts.
    """
    from . import geo

    compared = ["city", "street", "house", "lat", "lon", "postal_code", "is_private"]
    agree, rejected = split_conflicts(rows, "address_text", compared, "source_key")
    placed = geo.districts(agree.withColumn("id", F.xxhash64("address_text")), bounds)
    codes = match_postcodes(placed.filter("postal_code IS NULL"), points).select("id", "gar_guid", F.col("postal_code").alias("cf_code"))
    accepted = placed.join(codes, "id", "left").withColumn("postal_code", F.coalesce("postal_code", "cf_code")).drop("cf_code", "id")
    given = accepted.agg(F.count("*").alias("accepted"), F.count("gar_guid").alias("filled"), F.count_if(F.col("postal_code").isNull()).alias("missing"))
    lost = rejected.agg(F.count("*").alias("rejected_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rejected_rows"))
    return accepted, rejected, given.join(lost)  # one row each


def filtered(addresses: DataFrame, **tests: Column | None) -> DataFrame:
    """addresses that pass the tests that are given; a test that is None is none."""
    for test in tests.values():
        addresses = addresses if test is None else addresses.filter(test)
    return addresses


def by_postcode(addresses: DataFrame, texts: DataFrame) -> DataFrame:
    """Addresses with one of the postcodes that texts (text) name."""
    wanted = texts.select(F.explode(T.postcodes(F.col("text"))).alias("postal_code")).distinct()
    return addresses.join(wanted, "postal_code", "left_semi")


def house_labels(addresses: DataFrame) -> DataFrame:
    """How many addresses share a house's label on its street, and its place in the city's natural order.

    A place is the number of the city's addresses with a label that comes before, which is worked out over labels, and
    the place among those with an equal one.
    """
    same = F.count("*").over(Window.partitionBy("city", "street", "house"))
    keyed = addresses.select("id", "city", natural_order(F.col("house")).alias("k"), same.alias("same"))
    labels = keyed.groupBy("city", "k").agg(F.count("*").alias("n"))
    before = Window.partitionBy("city").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    labels = labels.select(F.col("city").alias("l_city"), F.col("k").alias("l_k"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    among = keyed.withColumn("among", F.row_number().over(Window.partitionBy("city", "k").orderBy("id")))
    placed = among.join(labels, F.col("city").eqNullSafe(F.col("l_city")) & F.col("k").eqNullSafe(F.col("l_k")))
    return placed.select("id", "same", (F.col("before") + F.col("among")).cast("long").alias("place"))
