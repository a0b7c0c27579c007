"""District boundaries from map elements: ways stitched to rings, points placed, changed rows found."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .geo import districts


def stitch(ways: list[list[int]]) -> list[list[int]]:
    """Closed rings of node ids from ways in any order and direction; what does not close is left out.

    Ways are edges between their ends; a ring is followed from way to way through ends that exactly one other open
    way shares.
    """
    by_end: dict[int, set[int]] = {}
    for i, w in enumerate(ways):
        if len(w) >= 2:
            for end in (w[0], w[-1]):
                by_end.setdefault(end, set()).add(i)
    used: set[int] = set()
    rings = []
    for i, w in enumerate(ways):
        if i in used or len(w) < 2:
            continue
        used.add(i)
        ring = list(w)
        while ring[0] != ring[-1]:
            open_ = sorted(by_end[ring[-1]] - used)
            if not open_:
                break
            used.add(open_[0])
            more = ways[open_[0]]
            ring += more[1:] if more[0] == ring[-1] else more[-2::-1]
        if ring[0] == ring[-1] and len(ring) >= 4:
            rings.append(ring)
    return rings


RINGS = "array<array<struct<lon:double,lat:double>>>"


def boundaries(elements: DataFrame, admin_level: str = "8") -> DataFrame:
    """SC12: (name, outer, inner) of the boundary relations among map elements (type, id, lat, lon, nodes, members, tags).

    Members join their ways and ways their nodes; each relation's ways are stitched in one group, which holds one
    boundary.
    """
    relations = elements.filter((F.col("type") == "relation") & (F.try_element_at("tags", F.lit("admin_level")) == admin_level))
    members = relations.select(F.try_element_at("tags", F.lit("name")).alias("name"), F.col("id").alias("rel"), F.explode("members").alias("m"))
    members = members.filter("m.type = 'way'").select("rel", "name", F.col("m.ref").alias("way"), F.coalesce("m.role", F.lit("outer")).alias("role"))
    ways = elements.filter("type = 'way'").select(F.col("id").alias("way"), F.posexplode("nodes").alias("at", "node"))
    nodes = elements.filter("type = 'node'").select(F.col("id").alias("node"), "lon", "lat")
    full = members.filter("name IS NOT NULL").join(ways, "way").join(nodes, "node")

    def join_up(g: pd.DataFrame) -> pd.DataFrame:
        place = {int(n): {"lon": x, "lat": y} for n, x, y in zip(g["node"], g["lon"], g["lat"], strict=True)}
        out = {}
        for role in ("outer", "inner"):
            own = g[(g["role"] == role) | ((role == "outer") & ~g["role"].isin(["outer", "inner"]))]
            lines = [w.sort_values("at")["node"].astype(int).tolist() for _, w in own.groupby("way")]
            out[role] = [[place[n] for n in ring] for ring in stitch(lines)]
        return pd.DataFrame({"name": [g["name"].iloc[0]], "outer": [out["outer"]], "inner": [out["inner"]]})

    return full.groupBy("rel").applyInPandas(join_up, f"name string, outer {RINGS}, inner {RINGS}").filter(F.size("outer") > 0)


def changed_districts(addresses: DataFrame, bounds: DataFrame) -> DataFrame:
    """The addresses whose district differs from the boundary that holds them, with the new one."""
    found = districts(addresses, bounds).filter(F.col("district_name").isNotNull())
    return found.filter(~F.col("district").eqNullSafe(F.col("district_name"))).select("id", F.col("district_name").alias("district"))
