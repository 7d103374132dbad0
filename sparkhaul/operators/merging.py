"""First fit by distance without a sequential pass: each point joins the first head within reach, else it is a head itself.

What the one-by-one rule gives is the lexicographically first independent set of the graph of near points, and that can be found in
rounds: of the points that are undecided, one without an undecided neighbour before it is a head, and those near a head are not. Near
points meet by a grid, so no group is one task; a round only reads the pairs that are still undecided.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine, within
from ..scratch import settled


def first_fit(points: DataFrame, keys: list[str], id_: str, order: list[str], metres: float, distance=haversine) -> DataFrame:
    """keys, id_, head: the id of the first head, in the given order (ties by id), within `metres` of each point of its group.

    points: keys, id_ (distinct in its group), order, lat, lng. Points at one place of a group stand or fall together: the first of them decides, so
    a heap of equal points makes no pairs. Points nearer to each other than `metres` do; they are as many as lie in such a circle.
    """
    rank = F.struct(*order, id_)
    places = points.groupBy(*keys, "lat", "lng").agg(F.min(rank).alias("rank"))
    places = settled(places.select(*keys, "lat", "lng", "rank", F.struct(*keys, F.col(f"rank.{id_}").alias("id")).alias("place")), "places")
    near = within(places.select(*keys, "lat", "lng", "rank", "place"), places.select(*keys, "lat", "lng", "rank", "place"), metres * 1.01, keys)
    near = near.where((F.col("r_rank") < F.col("rank")) & (distance("r_lat", "r_lng", "lat", "lng") <= metres))
    pairs = settled(near.select("place", "rank", F.col("r_place").alias("before"), F.col("r_rank").alias("before_rank")), "pairs")
    heads = places.join(pairs.select("place").distinct(), "place", "left_anti").select("place")  # nothing is near before them
    left, found = pairs, heads
    while True:
        # what is near a head is none; what then has no undecided point before it is one
        joined = left.join(heads.withColumnRenamed("place", "before"), "before", "left_semi").select("place").distinct()
        undecided = settled(left.join(joined, "place", "left_anti").join(joined.withColumnRenamed("place", "before"), "before", "left_anti"), "undecided")
        open_places = left.select("place").distinct().join(joined, "place", "left_anti")
        heads = settled(open_places.join(undecided.select("place").distinct(), "place", "left_anti"), "heads")
        found = found.unionByName(heads)
        left = undecided
        if left.isEmpty():
            break
    found = settled(found, "all-heads")
    first = pairs.join(found.withColumnRenamed("place", "before"), "before", "left_semi").groupBy("place").agg(F.min_by("before", "before_rank").alias("head"))
    of = places.join(first, "place", "left").select(*keys, "lat", "lng", F.coalesce("head", "place")["id"].alias("head"))
    return points.join(of, [*keys, "lat", "lng"]).select(*keys, id_, "head")


def first_fit_sql(rows: str, keys: str, metres: float, distance: str) -> str:
    """The same one by one, as a recursive CTE `fitted` over a CTE of keys, id, lat, lng and r (the place in the order, from 1).

    distance: an expression of h.lat, h.lng, lat and lng, in which h stands for a head.
    """
    reach = distance.replace("h.", "heads[k + 1].")
    return f"""fitted AS (SELECT {keys}, id, lat, lng, r, [{{'lat': lat, 'lng': lng, 'id': id}}] AS heads, id AS head FROM {rows} WHERE r = 1
UNION ALL SELECT {keys}, id, lat, lng, r, CASE WHEN found IS NULL THEN list_append(heads, {{'lat': lat, 'lng': lng, 'id': id}}) ELSE heads END, CASE WHEN found IS NULL THEN id ELSE heads[found + 1].id END
FROM (SELECT n.*, heads, list_min(list_filter(range(len(heads)), lambda k: {reach} <= {metres})) AS found FROM (SELECT {keys}, r, heads FROM fitted) f JOIN {rows} n USING ({keys}) WHERE n.r = f.r + 1))"""
