"""Geometry, activity and ranking columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# How much each channel and outlet is trusted, and what each importance and precision is worth.
CHANNELS = {"neighbors_chat": 0.95, "news": 0.70, "mc": 0.85, "max_public": 0.65, "manual": 0.80}
OUTLETS = {"tass": 0.92, "ria": 0.90, "kommersant": 0.88, "m24": 0.85, "msk1": 0.82, "mskagency": 0.80, "pik_comfort": 0.88, "granel": 0.80, "zhil_nagatino": 0.90, "gbu_portal": 0.78, "moek": 0.92}
IMPORTANCE = {1: 1.0, 2: 0.72, 3: 0.42}
PRECISION = {"home": 1.0, "street": 0.78, "city": 0.48}
EARTH_M = 6_371_000.0
HALF_LIFE_H = 24.0
BANDS = [(250.0, "home"), (800.0, "block"), (1500.0, "street")]
#: Degrees of a grid cell.
CELL = 0.01


def pick(c: Column, values: dict, default: float | None) -> Column:
    """The value of a small table for a key, by a chain of comparisons."""
    out = None
    for k, v in values.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(default))


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres (G1)."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def band(distance: Column) -> Column:
    """The name of a distance."""
    out = F.when(distance <= BANDS[0][0], BANDS[0][1])
    for most, name in BANDS[1:]:
        out = out.when(distance <= most, name)
    return out.otherwise("district")


def box(lat: Column, radius_m: float) -> tuple[Column, Column]:
    """Half the height and width in degrees of a box around a circle."""
    return F.lit(radius_m / 111_320.0), F.lit(radius_m) / (111_320.0 * F.greatest(F.lit(0.2), F.cos(F.radians(lat))))


def cell(c: Column) -> Column:
    """The grid cell of a coordinate."""
    return F.floor(c / CELL).cast("int")


def flat_distance2(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Squared degrees on a plane scaled at the first latitude."""
    return F.pow(lat2 - lat1, 2) + F.pow((lon2 - lon1) * F.cos(F.radians(lat1)), 2)


def point_in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Ray casting over a closed ring of (lon, lat) structs; an edge counts as inside, under four points nothing does."""
    edges = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1))), lambda i: F.struct(F.get(ring, i - 1).alias("a"), F.get(ring, i).alias("b")))

    def step(acc: Column, e: Column) -> Column:
        a, b = e["a"], e["b"]
        cross = (lon - a["lon"]) * (b["lat"] - a["lat"]) - (lat - a["lat"]) * (b["lon"] - a["lon"])
        on = (F.abs(cross) < 1e-12) & lon.between(F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"])) & lat.between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]))
        hit = ((a["lat"] > lat) != (b["lat"] > lat)) & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lon"])
        return F.struct((acc["edge"] | on).alias("edge"), F.when(F.coalesce(hit, F.lit(False)), ~acc["odd"]).otherwise(acc["odd"]).alias("odd"))

    start = F.struct(F.lit(False).alias("edge"), F.lit(False).alias("odd"))
    found = F.aggregate(edges, start, step)
    return (F.size(ring) >= 4) & (found["edge"] | found["odd"])


def circle(lat: Column, lon: Column, radius_m: float, corners: int = 64) -> Column:
    """A closed geodesic circle as (lon, lat) structs."""
    d = radius_m / EARTH_M
    phi = F.radians(lat)

    def corner(i: Column) -> Column:
        turn = 2 * math.pi * i / corners
        y = F.asin(F.sin(phi) * math.cos(d) + F.cos(phi) * math.sin(d) * F.cos(turn))
        x = F.radians(lon) + F.atan2(F.sin(turn) * math.sin(d) * F.cos(phi), math.cos(d) - F.sin(phi) * F.sin(y))
        return F.struct(F.degrees(x).alias("lon"), F.degrees(y).alias("lat"))

    return F.transform(F.sequence(F.lit(0), F.lit(corners)), corner)


def hours_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("HOUR", start, end)


def timeliness(published: Column, created: Column, now: Column) -> Column:
    """Half after a day; one half without any date."""
    age = F.greatest(F.lit(0), hours_between(F.coalesce(published, created), now))
    return F.when(F.coalesce(published, created).isNull(), 0.5).otherwise(clamp01(F.exp(-math.log(2) * age / HALF_LIFE_H)))


def relevance(importance: Column, distance: Column | None, geo_by: Column, scale_m: float = 6000.0) -> Column:
    """Importance, nearness and precision in one number."""
    scale = max(1.0, scale_m)
    near = F.lit(0.55) if distance is None else F.when(distance.isNull(), 0.55).otherwise(F.greatest(F.lit(0.0), 1 - F.least(distance, F.lit(scale)) / scale))
    return clamp01(0.50 * pick(importance, IMPORTANCE, 0.3) + 0.35 * near + 0.15 * F.coalesce(pick(geo_by, PRECISION, 0.30), F.lit(0.30)))


def reliability(source: Column, outlet: Column, configured: dict[str, float] | None = None) -> Column:
    """The outlet's trust as configured, else by default, else the channel's."""
    table = OUTLETS | {k: max(0.0, min(1.0, v)) for k, v in (configured or {}).items()}
    return F.coalesce(pick(outlet, table, None), pick(source, CHANNELS, 0.5))


def weight(importance: Column, source: Column, outlet: Column, geo_by: Column, published: Column, created: Column, now: Column, distance: Column | None = None, scale_m: float = 6000.0) -> Column:
    """0.50 relevance + 0.30 timeliness + 0.20 reliability."""
    return 0.50 * relevance(importance, distance, geo_by, scale_m) + 0.30 * timeliness(published, created, now) + 0.20 * reliability(source, outlet)


def boosted(w: Column, same_street: Column, active: Column) -> Column:
    """Up for one's own street and for what is on now, down for what is not; unknown changes nothing."""
    up = F.when(same_street, 0.07).otherwise(0.0)
    return clamp01(w + up + F.when(active, 0.12).when(~active, -0.20).otherwise(0.0))


def active_now(start: Column, end: Column, now: Column) -> Column:
    """Null without both ends; false before the start; else whether the end is open or ahead."""
    return F.when(start.isNull() & end.isNull(), F.lit(None).cast("boolean")).when(start > now, False).otherwise(F.coalesce(end >= now, F.lit(True)))


def in_dedup_pool(published: Column, created: Column, start: Column, end: Column, now: Column, days: int) -> Column:
    """Not over, and some date at most ``days`` old or no date at all."""
    latest = F.greatest(published, created, start)
    return F.coalesce(end >= now, F.lit(True)) & F.coalesce(latest >= now - F.make_dt_interval(F.lit(days)), F.lit(True))


def map_category(disaster: Column, importance: Column) -> Column:
    """The marker of an event (K20d)."""
    return F.when(disaster | (importance == 1), "catastrophe").when(importance == 2, "important").otherwise("minor")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, by sums in double precision (V1)."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.greatest(F.lit(1e-12), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def normalized(v: Column) -> Column:
    """A vector at length one; one of no length stays (V2)."""
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(size < 1e-12, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / size))


def softmax(v: Column) -> Column:
    """Softmax of an array."""
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))
