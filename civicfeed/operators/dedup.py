"""Near-duplicate decisions for drafts against active events, and what follows from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranking as R
from ..functions import text as T
from .lineage import saved

# Two texts are the same from DUPLICATE, and news of the same from UPDATE.
DUPLICATE, UPDATE, CERTAIN = 0.82, 0.58, 0.97


def action(score: Column, hint: Column, duplicate: float = DUPLICATE, update: float = UPDATE) -> Column:
    """New, duplicate or update from the best score and whether the draft says that something changed."""
    middle = (duplicate + update) / 2
    return (
        F.when(score >= duplicate, F.when(hint & (score < CERTAIN), "update").otherwise("duplicate"))
        .when((score >= update) & (hint | (score >= middle)), "update")
        .otherwise("new")
    )


def reason(score: Column, hint: Column, duplicate: float = DUPLICATE, update: float = UPDATE) -> Column:
    """Why ``action`` decided so."""
    middle = (duplicate + update) / 2
    return (
        F.when(score.isNull(), "geo_filtered")
        .when((score >= duplicate) & hint & (score < CERTAIN), "near_dup_with_update_hint")
        .when(score >= duplicate, "cosine_duplicate")
        .when((score >= update) & hint, "cosine_update_hint")
        .when((score >= update) & (score >= middle), "cosine_update")
        .otherwise("below_threshold")
    )


def _meet(drafts: DataFrame, events: DataFrame, block: int, choose: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(draft_id, best_id, score) of the pairs that ``choose`` picks by their places from a block's scores, draft ids and event ids.

    Both sides have id, address_id and v (an array). Rows meet in lanes. Addresses are hashed into as many lanes as
    there are blocks of events, so a draft with an address meets about one block of events, and those without an
    address in a lane of their own; a draft without one meets all events. Lanes are cut into blocks, so that a hot
    address is many tasks; a pair of blocks is one matrix product. Events of a block come by falling ids; pairs whose
    addresses conflict score minus infinity.
    """
    lanes = max(1, -(-events.count() // block))
    columns = ["id", F.col("address_id").cast("long").alias("address_id"), F.col("v").cast("array<double>").alias("v")]
    own, alone, every = F.pmod(F.xxhash64("address_id"), F.lit(lanes)), F.lit(-1).cast("long"), F.lit(-2).cast("long")
    missing = F.col("address_id").isNull()
    left = drafts.select(*columns).withColumn("lane", F.explode(F.when(missing, F.array(every)).otherwise(F.array(own, alone))))
    right = events.select(*columns).withColumn("lane", F.explode(F.array(F.when(missing, alone).otherwise(own), every)))
    blocks = lambda df, name: df.groupBy("lane").agg(F.ceil(F.count("*") / block).alias(name))
    cuts = blocks(left, "ni").join(blocks(right, "nj"), "lane")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = left.join(cuts, "lane").withColumn("i", F.pmod(F.xxhash64("id"), F.col("ni"))).withColumn("j", spread("nj"))
    right = right.join(cuts, "lane").withColumn("j", F.pmod(F.xxhash64("id"), F.col("nj"))).withColumn("i", spread("ni"))

    def compare(d: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"draft_id": [], "best_id": [], "score": []}).astype({"draft_id": "int64", "best_id": "int64"})
        if not len(d) or not len(e):
            return out
        e = e.sort_values("id", ascending=False)
        x, y = np.stack(d["v"].to_numpy()), np.stack(e["v"].to_numpy())
        x = x / np.linalg.norm(x, axis=1, keepdims=True).clip(min=1e-12)
        y = y / np.linalg.norm(y, axis=1, keepdims=True).clip(min=1e-12)
        scores = np.round(x @ y.T, 9)
        a, b = d["address_id"].to_numpy(float)[:, None], e["address_id"].to_numpy(float)[None]
        scores[~(np.isnan(a) | np.isnan(b) | (a == b))] = -np.inf
        own_ids, other_ids = d["id"].to_numpy(), e["id"].to_numpy()
        at, of = choose(scores, own_ids, other_ids)
        return pd.DataFrame({"draft_id": own_ids[at], "best_id": other_ids[of], "score": scores[at, of]})

    own_columns = ("id", "address_id", "v", "lane", "i", "j")  # as columns of their own, since both sides come from one plan of cuts
    left, right = (df.select(*[F.col(c).alias(c) for c in own_columns]) for df in (left, right))
    return left.groupBy("lane", "i", "j").cogroup(right.groupBy("lane", "i", "j")).applyInPandas(compare, "draft_id long, best_id long, score double")


def best_matches(drafts: DataFrame, events: DataFrame, block: int = 4096) -> DataFrame:
    """Each draft's most similar event whose address does not conflict; the higher id among equals.

    Of a pair of blocks only a best row for each draft leaves the task. Drafts of equal vectors and addresses are one, and of
    such events only the highest id can be a best match.
    """
    told = ("address_id", "v")
    given = drafts.select("id", F.col("address_id").cast("long").alias("address_id"), F.col("v").cast("array<double>").alias("v"))
    one = given.groupBy(*told).agg(F.min("id").alias("id"))
    events = events.select("id", F.col("address_id").cast("long").alias("address_id"), F.col("v").cast("array<double>").alias("v")).groupBy(*told).agg(F.max("id").alias("id"))

    def best_of(scores: np.ndarray, own: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best = scores.argmax(1)
        some = np.flatnonzero(np.isfinite(scores[np.arange(len(own)), best]))
        return some, best[some]

    found = _meet(one, events, block, best_of)
    best = found.groupBy("draft_id").agg(F.max(F.struct("score", "best_id")).alias("x"))
    led = one.select(F.col("id").alias("draft_id"), *[F.col(c).alias(f"l_{c}") for c in told]).join(best, "draft_id").select("x", *[f"l_{c}" for c in told])
    same = [F.col(c).eqNullSafe(F.col(f"l_{c}")) for c in told]
    return given.join(led, same[0] & same[1]).select(F.col("id").alias("draft_id"), "x.best_id", "x.score")


def similar_pairs(rows: DataFrame, least: float, block: int = 4096) -> DataFrame:
    """(draft_id, best_id, score): each pair of rows that is at least so similar and has no conflict, the later row first."""

    def earlier(scores: np.ndarray, own: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero((scores >= least) & (others[None] < own[:, None]))

    return _meet(rows, rows, block, earlier).distinct()


def hashed_embedding(dim: int = 256):
    """V3: a pandas UDF from texts to unit vectors of hashed words and word pairs."""
    import hashlib

    @F.pandas_udf("array<double>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places: dict[str, tuple[int, float]] = {}

        def vector(text: str | None) -> np.ndarray:
            ws = (text or "").lower().replace("ё", "е").split()
            out = np.zeros(dim)
            for gram in ws + ["_".join(p) for p in zip(ws, ws[1:], strict=False)]:
                got = places.get(gram)
                if got is None:
                    if len(places) > 200_000:
                        places.clear()
                    digest = hashlib.blake2b(gram.encode(), digest_size=8).digest()
                    got = places[gram] = (int.from_bytes(digest, "little") % dim, 1.0 if digest[0] % 2 == 0 else -1.0)
                out[got[0]] += got[1]
            size = np.linalg.norm(out)
            return out / size if size >= 1e-12 else out

        for part in texts:
            yield part.map(vector)

    return embed


def geo_nearby(a_address: Column, b_address: Column, a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column, radius_m: float = 3000.0) -> Column:
    """equal addresses where both have one, else points within a radius where both have one, else neither has an address."""
    points = a_lat.isNotNull() & a_lon.isNotNull() & b_lat.isNotNull() & b_lon.isNotNull()
    both = a_address.isNotNull() & b_address.isNotNull()
    close = R.haversine(a_lat, a_lon, b_lat, b_lon) <= radius_m
    return F.when(both, a_address == b_address).when(points, close).otherwise(a_address.isNull() & b_address.isNull())


def conflict(a_address: Column, b_address: Column) -> Column:
    """both addresses are known and differ."""
    return F.coalesce(a_address != b_address, F.lit(False))


def merge_payload(old_body: Column, new_body: Column, old_importance: Column, new_importance: Column, old_disaster: Column, new_disaster: Column) -> Column:
    """The new body unless the old one holds it, the graver importance, and either's disaster flag."""
    held = F.coalesce(F.lower(old_body).contains(F.lower(F.trim(new_body))), F.lit(False))
    blank = F.coalesce(F.trim(new_body) == "", F.lit(True))
    body = F.when(blank | held, old_body).otherwise(new_body)
    return F.struct(body.alias("body"), F.least(old_importance, new_importance).alias("importance"), (old_disaster | new_disaster).alias("disaster_flag"))


def resolve(drafts: DataFrame, events: DataFrame, duplicate: float = DUPLICATE, update: float = UPDATE) -> DataFrame:
    """C11 for one batch against the events before it: a known message id is a duplicate, else C9 decides.

    Both sides have id, source, source_msg_id, title, body, address_id and v.
    """
    known = events.filter(F.col("source_msg_id").isNotNull()).groupBy("source", "source_msg_id").agg(F.max("id").alias("same_id"))
    keyed = known.select(F.col("source").alias("k_source"), F.col("source_msg_id").alias("k_msg"), "same_id")
    seen = drafts.join(keyed, (F.col("source") == F.col("k_source")) & (F.col("source_msg_id") == F.col("k_msg")), "left").drop("k_source", "k_msg")
    best = best_matches(seen.filter(F.col("same_id").isNull()), events)
    out = seen.join(best.withColumnRenamed("draft_id", "id"), "id", "left")
    hint = T.has_update_hint(F.concat_ws(" ", "title", "body"))
    decided = F.when(F.col("same_id").isNotNull(), "duplicate").otherwise(action(F.col("score"), hint, duplicate, update))
    why = F.when(F.col("same_id").isNotNull(), "same_message").otherwise(reason(F.col("score"), hint, duplicate, update))
    return out.select("id", decided.alias("action"), why.alias("reason"), F.coalesce("same_id", "best_id").alias("match_id"), "score")


def resolve_batch(drafts: DataFrame, events: DataFrame, duplicate: float = DUPLICATE, update: float = UPDATE) -> DataFrame:
    """C11 in the order of ids: each draft against the events before the batch and the drafts before it that became events.

    Both sides have id, source, source_msg_id, title, body, address_id and v; ids are unique over both. A draft with a similar enough earlier one (a blocking pair) is an event of its own only if none of those is; so drafts
    without an undecided earlier partner are decided together, and what they block falls away at once. A hot group takes two
    rounds; only chains of pairs, each blocked by the one before alone, take as many as they are long. Equal drafts
    (vector, address, hint) are one in these rounds; pairs of nearly equal ones are rows, as many as the square of a group of
    them. An update counts as a sight of its event and does not change the event's vector. Columns: id, action, reason,
    match_id (of duplicates and updates), score (of the best match, null without one of at least ``update``).
    """
    hint = T.has_update_hint(F.concat_ws(" ", "title", "body"))
    acts = lambda score, told: action(score, told, duplicate, update) != "new"
    known = events.filter(F.col("source_msg_id").isNotNull()).groupBy("source", "source_msg_id").agg(F.max("id").alias("same_id"))
    rows = drafts.select("id", "source", "source_msg_id", "address_id", F.col("v").cast("array<double>").alias("v"), F.coalesce(hint, F.lit(False)).alias("hint"))
    sights = rows.filter(F.col("source_msg_id").isNotNull()).groupBy("source", "source_msg_id").agg((F.count("*") > 1).alias("often"))
    rows = rows.join(known, ["source", "source_msg_id"], "left").join(sights, ["source", "source_msg_id"], "left")
    # messages that come again are equal only to themselves
    own_key = F.when(F.coalesce("often", F.lit(False)), F.struct("source", "source_msg_id"))
    rows = saved(rows.withColumn("own_key", own_key))
    fresh = rows.filter(F.col("same_id").isNull())
    equal = ("v", "address_id", "hint", "own_key")
    first = fresh.groupBy(*equal).agg(F.min("id").alias("lead")).select("lead", *[F.col(c).alias(f"f_{c}") for c in equal])
    same_as = [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in equal]
    members = saved(fresh.join(first, same_as[0] & same_as[1] & same_as[2] & same_as[3]).select("id", "lead", "hint", "own_key", "address_id", "v"))
    led = members.filter("id = lead").select("id", "hint", "own_key", "address_id", "v")

    best = saved(best_matches(led, events).filter(F.col("score") >= update))
    pairs = saved(similar_pairs(led.select("id", "address_id", "v"), update))
    told = led.select("id", "hint")
    blocks = pairs.join(told.withColumnRenamed("id", "draft_id"), "draft_id").filter(acts(F.col("score"), F.col("hint"))).select(F.col("draft_id").alias("d"), F.col("best_id").alias("o"))
    matched = best.withColumnRenamed("draft_id", "id").join(told, "id").filter(acts(F.col("score"), F.col("hint"))).select("id")
    open_ = saved(led.select("id", "own_key").join(matched, "id", "left_anti"))
    still = lambda e: e.join(open_.select(F.col("id").alias("d")), "d", "left_semi").join(open_.select(F.col("id").alias("o")), "o", "left_semi")
    edges = saved(still(blocks))
    made = []
    while not open_.isEmpty():
        sent_first = open_.filter(F.col("own_key").isNotNull()).groupBy("own_key").agg(F.min("id").alias("m"))
        waiting = open_.join(sent_first, "own_key").filter("id > m").select("id")
        free = saved(open_.join(edges.select(F.col("d").alias("id")).unionByName(waiting), "id", "left_anti"))
        made.append(free)
        hit = edges.join(free.select(F.col("id").alias("o")), "o", "left_semi").select(F.col("d").alias("id"))
        resent = open_.join(free.select("own_key", F.col("id").alias("m")), "own_key").filter("id > m").select("id")
        open_ = saved(open_.join(free.select("id").unionByName(hit).unionByName(resent), "id", "left_anti"))
        edges = saved(still(edges))
    new = made[0] if made else open_
    for more in made[1:]:
        new = new.unionByName(more)
    new = saved(new)

    # what each draft, copies too, finds: events, its leader if that became one, and the leader's partners that did and came before
    either = pairs.select(F.col("draft_id").alias("lead"), F.col("best_id").alias("match_id"), "score").unionByName(pairs.select(F.col("best_id").alias("lead"), F.col("draft_id").alias("match_id"), "score"))
    partners = either.join(new.select(F.col("id").alias("match_id")), "match_id", "left_semi")
    leaders = new.select(F.col("id").alias("lead"), F.col("id").alias("match_id"), F.lit(1.0).alias("score"))
    found = partners.unionByName(leaders).withColumn("before", F.col("match_id"))
    found = found.unionByName(best.select(F.col("draft_id").alias("lead"), F.col("best_id").alias("match_id"), "score"), allowMissingColumns=True)
    seen = members.join(found, "lead").filter(F.coalesce(F.col("before") < F.col("id"), F.lit(True))).groupBy("id").agg(F.max(F.struct("score", "match_id")).alias("x"))
    sent = members.join(new.filter(F.col("own_key").isNotNull()).select("own_key", F.col("id").alias("sent_id")), "own_key").filter("sent_id < id").select("id", "sent_id")
    out = rows.join(seen, "id", "left").join(sent, "id", "left").join(new.select("id", F.lit(True).alias("made")), "id", "left")
    same = F.coalesce("same_id", "sent_id")
    score = F.when(same.isNull(), F.col("x.score"))
    decided = F.when(F.col("made"), "new").when(same.isNotNull(), "duplicate").otherwise(action(score, F.col("hint"), duplicate, update))
    is_new = F.coalesce("made", F.lit(False))
    why = F.when(is_new, "below_threshold").when(same.isNotNull(), "same_message").otherwise(reason(score, F.col("hint"), duplicate, update))
    match = F.when(~is_new, F.coalesce(same, F.col("x.match_id")))
    return out.select("id", decided.alias("action"), why.alias("reason"), match.alias("match_id"), score.alias("score"))
