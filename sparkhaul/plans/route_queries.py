"""Queries that order, group and rewrite the stops of routes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import address as a
from ..functions.geo import flat_distance, haversine, nearest, within
from ..operators import evidence as ev
from ..operators import places
from ..operators import merging
from ..operators import relational as rel
from ..operators import stitching
from ..operators import routes as ops
from ..scratch import settled
from . import views as v
from .registry import registry

QUERIES, query = registry()


@query("o01_shortest_paths", None)
def _(spark, sf):
    return ops.sequenced(v.stops(spark, sf))


@query("o02_visits", None)
def _(spark, sf):
    return ops.visits(v.stops(spark, sf).withColumn("address_key", F.expr("lower(street) || '|' || number")))


def _areas(spark, sf):
    return v.stops(spark, sf).selectExpr("route", "stop % 4 AS area", "CASE WHEN stop % 4 = 3 THEN 600 END AS deadline", "stop", "lat", "lng")


@query("o03_areas_in_order", None)
def _(spark, sf):
    plan = ops.assembled(_areas(spark, sf)).join(_areas(spark, sf).select("stop", "area"), "stop")
    return plan.groupBy("route", "area").agg(F.min("place").alias("begins"))


@query("o04_routes_assembled", None)
def _(spark, sf):
    return ops.assembled(_areas(spark, sf))


@query("o05_routes_after_a_detour", None)
def _(spark, sf):
    s = v.stops(spark, sf).withColumn("place", F.row_number().over(Window.partitionBy("route").orderBy("seq", "stop")) - 1)
    return ops.resequenced(s.selectExpr("route", "stop", "place", "lat", "lng", "CASE WHEN delivered THEN TIMESTAMP '2024-01-01 08:00:00' + make_dt_interval(0, 0, CAST((stop * 7) % 600 AS INT)) END AS delivered_at"))


@query("o06_drift_since_assembly", f"""WITH {v.STOPS}, p AS (SELECT route, arg_min(lat, stop) AS lat0, arg_min(lng, stop) AS lng0, arg_max(lat, stop) AS lat1, arg_max(lng, stop) AS lng1, arg_max(lat, stop) FILTER (WHERE delivered) AS lat2 FROM stops GROUP BY route)
SELECT route, {v.haversine_sql('lat0', 'lng0', 'lat1', 'lng1')} > 100 AS drifted, coalesce(CASE WHEN route % 3 = 0 THEN lat0 END, lat2, lat1) AS departs FROM p""")
def _(spark, sf):
    p = v.stops(spark, sf).groupBy("route").agg(
        *(F.min_by(c, "stop").alias(f"{c}0") for c in ("lat", "lng")), *(F.max_by(c, "stop").alias(f"{c}1") for c in ("lat", "lng")), F.max_by(F.when(F.col("delivered"), F.col("lat")), F.when(F.col("delivered"), F.col("stop"))).alias("lat2"))
    return p.select("route", (haversine("lat0", "lng0", "lat1", "lng1") > 100).alias("drifted"), F.coalesce(F.when(F.col("route") % 3 == 0, F.col("lat0")), "lat2", "lat1").alias("departs"))


_GUESS = "precision IN ('rua', 'bairro')"


@query("o07_door_of_the_neighbour", f"""WITH {v.STOPS}, s AS (SELECT *, CAST(floor(stop / 120) AS BIGINT) % 7 AS door FROM stops), l AS (SELECT *, lag(door) OVER w AS d0, lag(street) OVER w AS s0, lag(precision) OVER w AS p0, lag(lat) OVER w AS lat0, lag(lng) OVER w AS lng0 FROM s WINDOW w AS (PARTITION BY route ORDER BY seq, stop))
SELECT stop, round(lat0, 7) AS lat, round(lng0, 7) AS lng FROM l WHERE door = d0 AND street <> s0 AND {_GUESS} AND p0 IN ('confirmado', 'censo', 'manual', 'planilha') AND NOT delivered AND (lat <> lat0 OR lng <> lng0)""")
def _(spark, sf):
    w = Window.partitionBy("route").orderBy("seq", "stop")
    s = v.stops(spark, sf).withColumn("door", F.floor(F.col("stop") / 120) % 7)
    s = s.withColumns({"d0": F.lag("door").over(w), "s0": F.lag("street").over(w), "p0": F.lag("precision").over(w), "lat0": F.lag("lat").over(w), "lng0": F.lag("lng").over(w)})
    moved = s.where(f"door = d0 AND street <> s0 AND {_GUESS} AND p0 IN ('confirmado', 'censo', 'manual', 'planilha') AND NOT delivered AND (lat <> lat0 OR lng <> lng0)")
    return moved.select("stop", F.round("lat0", 7).alias("lat"), F.round("lng0", 7).alias("lng"))


@query("o08_first_source_that_answers", f"""WITH {v.STOPS}, d AS (SELECT cep, number, min(stop) AS door FROM stops WHERE precision = 'confirmado' GROUP BY ALL), st AS (SELECT street, district, min(stop) AS door FROM stops WHERE precision = 'censo' GROUP BY ALL), di AS (SELECT district, min(stop) AS door FROM stops GROUP BY ALL),
c AS (SELECT s.stop, 1 AS rank, 'census' AS source, d.door FROM stops s JOIN d USING (cep, number) UNION ALL SELECT s.stop, 2, 'street', st.door FROM stops s JOIN st USING (street, district) UNION ALL SELECT s.stop, 3, 'district', di.door FROM stops s JOIN di USING (district))
SELECT stop, source, door FROM (SELECT *, row_number() OVER (PARTITION BY stop ORDER BY rank) AS r FROM c) WHERE r = 1""")
def _(spark, sf):
    s = v.stops(spark, sf)
    levels = (("census", ["cep", "number"], "precision = 'confirmado'"), ("street", ["street", "district"], "precision = 'censo'"), ("district", ["district"], "true"))
    out = s
    for name, keys, known in levels:
        out = out.join(s.where(known).groupBy(*keys).agg(F.min("stop").alias(f"by_{name}")), keys, "left")
    source = F.when(F.col("by_census").isNotNull(), "census").when(F.col("by_street").isNotNull(), "street").otherwise("district")
    return out.select("stop", source.alias("source"), F.coalesce("by_census", "by_street", "by_district").alias("door"))


@query("o09_segment_choice", f"""WITH {v.STOPS}, {v.SEGMENTS}, q AS (SELECT stop, 'rua ' || (stop % 9) AS name_key, CAST(stop % 25 AS INTEGER) AS city, 'district ' || (stop % 7) AS district, lat, lng FROM stops),
d AS (SELECT stop, seg, row_number() OVER (PARTITION BY stop ORDER BY q.city <> s.city, q.district <> s.district, {v.flat('q.lat', 'q.lng', 'lat0', 'lng0')}, seg) AS r FROM q JOIN segments s USING (name_key))
SELECT stop, seg FROM d WHERE r = 1""")
def _(spark, sf):
    q = v.stops(spark, sf).selectExpr("stop", "'rua ' || (stop % 9) AS name_key", "CAST(stop % 25 AS INT) AS city", "'district ' || (stop % 7) AS district", "lat", "lng")
    s = v.segments(spark, sf).where("name_key IS NOT NULL").selectExpr("name_key", "seg", "city", "district", "lat0 AS lat", "lng0 AS lng")
    # the nearest of the same city and district; stops without one look in the city, then in the district, then at all of the name
    found = None
    for keys in (("name_key", "city", "district"), ("name_key", "city"), ("name_key", "district"), ("name_key",)):
        left = q if found is None else q.join(found, "stop", "left_anti")
        best = nearest(left, s, "stop", "seg", keys=keys).select("stop", F.col("r_seg").alias("seg"))
        found = best if found is None else found.unionByName(best)
    return found


@query("o10_consensus_onto_stops", f"""WITH {v.STOPS}, {v.EVIDENCE}, c AS ({v.consensus_sql('(' + v.standing() + ')')})
SELECT stop, CASE WHEN precision = 'manual' THEN 'kept' WHEN status = 'confirmed' THEN 'moved' WHEN status = 'suggested' THEN 'suggestion' ELSE 'kept' END AS what,
round(CASE WHEN precision <> 'manual' AND status = 'confirmed' THEN c.lat ELSE s.lat END, 7) AS lat FROM stops s LEFT JOIN c ON c.place = CAST(stop % 130 AS VARCHAR)""")
def _(spark, sf):
    c = ev.consensus(ev.standing_marks(v.evidence(spark, sf))).select("place", "status", F.col("lat").alias("c_lat"))
    s = v.stops(spark, sf).withColumn("place", (F.col("stop") % 130).cast("string")).join(c, "place", "left")
    own = F.col("precision") == "manual"
    what = F.when(own, "kept").when(F.col("status") == "confirmed", "moved").when(F.col("status") == "suggested", "suggestion").otherwise("kept")
    return s.select("stop", what.alias("what"), F.round(F.when(~own & (F.col("status") == "confirmed"), F.col("c_lat")).otherwise(F.col("lat")), 7).alias("lat"))


@query("o11_own_memory", f"""WITH {v.STOPS}, m AS (SELECT cep || '|' || number AS key, street || '|' || (number % 30) AS door, lat, lng, stop AS known FROM stops WHERE precision = 'manual'), u AS (SELECT door, min(known) AS known, min(lat) AS lat, min(lng) AS lng FROM m GROUP BY door HAVING count(*) = 1),
e AS (SELECT key, min(known) AS known FROM m GROUP BY key)
SELECT s.stop, coalesce(e.known, CASE WHEN {v.haversine_sql('s.lat', 's.lng', 'u.lat', 'u.lng')} <= 3000 THEN u.known END) AS known FROM stops s LEFT JOIN e ON e.key = s.cep || '|' || s.number LEFT JOIN u ON u.door = s.street || '|' || (s.number % 30)""")
def _(spark, sf):
    s = v.stops(spark, sf).withColumns({"key": F.expr("cep || '|' || number"), "door": F.expr("street || '|' || (number % 30)")})
    m = s.where("precision = 'manual'")
    exact = m.groupBy("key").agg(F.min("stop").alias("exact"))
    one = m.groupBy("door").agg(F.count("*").alias("n"), F.min("stop").alias("only"), F.min("lat").alias("u_lat"), F.min("lng").alias("u_lng")).where("n = 1")
    both = s.join(exact, "key", "left").join(one, "door", "left")
    return both.select("stop", F.coalesce("exact", F.when(haversine("lat", "lng", "u_lat", "u_lng") <= 3000, F.col("only"))).alias("known"))


@query("o12_lassos", f"""WITH {v.STOPS}, l AS (SELECT stop, route, min(k) AS lasso FROM stops, unnest(range(3)) AS t(k) WHERE lat BETWEEN -9.52 + k * 0.04 AND -9.475 + k * 0.04 AND lng BETWEEN -35.70 AND -35.62 GROUP BY ALL)
SELECT s.route, s.stop, coalesce(lasso, 3) AS area FROM stops s LEFT JOIN l USING (stop)""")
def _(spark, sf):
    s = v.stops(spark, sf).select("route", "stop", "lat", "lng")
    south, north = (F.lit(x) + F.col("lasso") * F.lit(0.04) for x in (-9.52, -9.475))
    corners = ((south, -35.70), (south, -35.62), (north, -35.62), (north, -35.70))
    ring = F.array(*(F.struct(y.alias("p_lat"), F.lit(x).alias("p_lng")) for y, x in corners))
    ring = F.transform(ring, lambda p: F.struct(p["p_lat"].alias("lat"), p["p_lng"].alias("lng")))
    lassos = s.select("route").distinct().withColumn("lasso", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))).withColumn("ring", ring)
    return ops.claimed(s, lassos, places.crossings(F.col("ring"), F.col("lat"), F.col("lng")) % 2 == 1)


@query("o13_lines_stitched", None)
def _(spark, sf):
    x = v.vertices(spark, sf)
    e = places.edges_of(x).withColumn("name", F.concat(F.lit("line "), (F.col("seg") % 20).cast("string")))
    return stitching.stitched(e.select("name", (F.col("seg") * 4 + F.col("i")).alias("seg"), F.col("lat1").alias("from_lat"), F.col("lng1").alias("from_lng"), F.col("lat2").alias("to_lat"), F.col("lng2").alias("to_lng")))


@query("o15_split_and_joined", f"""WITH {v.STOPS}, d AS (SELECT route, lower(street) AS door, count(DISTINCT extra) AS extras FROM stops GROUP BY ALL)
SELECT stop, lower(s.street) || CASE WHEN extras > 1 AND extra <> '' THEN '|' || lower(extra) ELSE '' END AS key, extras > 1 AS split FROM stops s JOIN d ON d.route = s.route AND d.door = lower(s.street)""")
def _(spark, sf):
    s = v.stops(spark, sf).withColumn("door", F.lower("street"))
    d = s.groupBy("route", "door").agg(F.countDistinct("extra").alias("extras"))
    split = F.col("extras") > 1
    key = F.concat("door", F.when(split & (F.col("extra") != ""), F.concat(F.lit("|"), F.lower("extra"))).otherwise(""))
    return s.join(d, ["route", "door"]).select("stop", key.alias("key"), split.alias("split"))


_MOVED = "lat + CASE WHEN stop % 6 = 0 THEN 0.02e0 ELSE 0 END"


@query("o16_back_from_the_district", f"""WITH {v.STOPS}, n AS (SELECT a.stop, count(*) AS near FROM stops a JOIN stops b ON a.route = b.route AND a.stop <> b.stop AND {v.haversine_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 2000 WHERE a.stop % 6 = 0 AND NOT a.delivered GROUP BY a.stop)
SELECT s.stop, round(CASE WHEN near >= 2 THEN lat ELSE {_MOVED} END, 7) AS lat, coalesce(near >= 2, false) AS returned FROM stops s LEFT JOIN n USING (stop)""")
def _(spark, sf):
    s = v.stops(spark, sf)
    asked = s.where("stop % 6 = 0 AND NOT delivered").select("route", "stop", "lat", "lng")
    near = within(asked, s.select("route", "stop", "lat", "lng"), 2020.0, ["route"]).where((F.col("stop") != F.col("r_stop")) & (haversine("lat", "lng", "r_lat", "r_lng") <= 2000))
    counted = near.groupBy("stop").agg(F.count("*").alias("near"))
    both = s.withColumn("moved", F.expr(_MOVED)).join(counted, "stop", "left")
    back = F.coalesce(F.col("near") >= 2, F.lit(False))
    return both.select("stop", F.round(F.when(back, F.col("lat")).otherwise(F.col("moved")), 7).alias("lat"), back.alias("returned"))


@query("o17_moves_recorded", f"""WITH {v.STOPS}, o AS (SELECT route, district, median(lat) AS d_lat FROM stops WHERE precision IN ('confirmado', 'censo', 'planilha') GROUP BY ALL)
SELECT stop, round(CASE WHEN precision = 'rua' AND d_lat IS NOT NULL THEN d_lat ELSE lat END, 7) AS lat, CASE WHEN precision = 'rua' AND d_lat IS NOT NULL THEN 'bairro' ELSE precision END AS precision, CASE WHEN precision = 'rua' AND d_lat IS NOT NULL THEN round(lat, 7) END AS lat_before FROM stops LEFT JOIN o USING (route, district)""")
def _(spark, sf):
    s = v.stops(spark, sf)
    o = s.where("precision IN ('confirmado', 'censo', 'planilha')").groupBy("route", "district").agg(F.median("lat").alias("d_lat"))
    both = s.join(o, ["route", "district"], "left")
    moves = (F.col("precision") == "rua") & F.col("d_lat").isNotNull()
    return both.select("stop", F.round(F.when(moves, F.col("d_lat")).otherwise(F.col("lat")), 7).alias("lat"), F.when(moves, "bairro").otherwise(F.col("precision")).alias("precision"), F.when(moves, F.round("lat", 7)).alias("lat_before"))


@query("o18_inside_the_region", f"""WITH {v.STOPS}, c AS (SELECT route, median(lat) AS c_lat, median(lng) AS c_lng FROM stops WHERE precision <> 'bairro' GROUP BY route)
SELECT stop FROM stops JOIN c USING (route) WHERE {v.haversine_sql('c_lat', 'c_lng', 'lat', 'lng')} <= 5000""")
def _(spark, sf):
    s = v.stops(spark, sf)
    c = s.where("precision <> 'bairro'").groupBy("route").agg(F.median("lat").alias("c_lat"), F.median("lng").alias("c_lng"))
    return s.join(c, "route").where(haversine("c_lat", "c_lng", "lat", "lng") <= 5000).select("stop")


@query("o19_generic_points_placed", f"""WITH {v.STOPS}, ce AS (SELECT cep, number, min(stop) AS door FROM stops WHERE precision = 'censo' GROUP BY ALL), n AS (SELECT route, district, median(lat) AS d_lat FROM stops WHERE stop % 4 <> 0 AND precision NOT IN ('rua', 'bairro') GROUP BY ALL)
SELECT stop, CASE WHEN ce.door IS NOT NULL THEN 'census' WHEN d_lat IS NOT NULL THEN 'district' ELSE 'left' END AS how FROM stops s LEFT JOIN ce USING (cep, number) LEFT JOIN n USING (route, district) WHERE s.stop % 4 = 0""")
def _(spark, sf):
    s = v.stops(spark, sf)
    ce = s.where("precision = 'censo'").groupBy("cep", "number").agg(F.min("stop").alias("door"))
    n = s.where("stop % 4 <> 0 AND precision NOT IN ('rua', 'bairro')").groupBy("route", "district").agg(F.median("lat").alias("d_lat"))
    both = s.where("stop % 4 = 0").join(ce, ["cep", "number"], "left").join(n, ["route", "district"], "left")
    return both.select("stop", F.when(F.col("door").isNotNull(), "census").when(F.col("d_lat").isNotNull(), "district").otherwise("left").alias("how"))


_PINS = f"""WITH RECURSIVE {v.STOPS}, p AS (SELECT route, stop AS id, lat, lng, row_number() OVER (PARTITION BY route ORDER BY seq, stop) AS r FROM stops WHERE WHICH),
{merging.first_fit_sql('p', 'route', 250, v.haversine_sql('h.lat', 'h.lng', 'lat', 'lng'))}"""


def _pins(s):
    return merging.first_fit(s.select("route", "stop", "seq", "lat", "lng"), ["route"], "stop", ["seq"], 250.0).join(s.drop("route"), "stop")


@query("a31_pin_progress", _PINS.replace("WHICH", "true") + ", d AS (SELECT f.route, head, bool_and(delivered) AS done FROM fitted f JOIN stops ON stop = id GROUP BY ALL) SELECT route, count(*) AS pins, count(*) FILTER (WHERE done) AS done FROM d GROUP BY route")
def _(spark, sf):
    pins = _pins(v.stops(spark, sf)).groupBy("route", "head").agg(F.bool_and("delivered").alias("done"))
    return pins.groupBy("route").agg(F.count("*").alias("pins"), F.count_if("done").alias("done"))


@query("a37_groups_on_the_map", _PINS.replace("WHICH", "NOT delivered") + """ SELECT f.route, head, sum(units)::BIGINT AS packages, count(DISTINCT lower(street) || '|' || number) AS addresses, count(DISTINCT carrier) AS carrier_stops,
coalesce(sum(units) FILTER (WHERE additional), 0)::BIGINT AS added FROM fitted f JOIN stops ON stop = id GROUP BY f.route, head""")
def _(spark, sf):
    g = _pins(v.stops(spark, sf).where("NOT delivered"))
    return g.groupBy("route", "head").agg(F.sum("units").alias("packages"), F.countDistinct(F.expr("lower(street) || '|' || number")).alias("addresses"), F.countDistinct("carrier").alias("carrier_stops"), F.sum(F.when(F.col("additional"), F.col("units")).otherwise(0)).alias("added"))


@query("a39_copies_in_one_reading", f"WITH {v.STOPS}, r AS (SELECT route, stop % 3 AS reading, lower(street) AS line, count(*) AS copies FROM stops GROUP BY ALL) SELECT route, line, max(copies) AS copies FROM r GROUP BY ALL")
def _(spark, sf):
    r = v.stops(spark, sf).groupBy("route", (F.col("stop") % 3).alias("reading"), F.lower("street").alias("line")).agg(F.count("*").alias("copies"))
    return r.groupBy("route", "line").agg(F.max("copies").alias("copies"))


@query("w01_first_per_key", f"WITH {v.STOPS} SELECT route, stop FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY delivered DESC, number DESC, stop) AS r FROM stops) WHERE r = 1")
def _(spark, sf):
    return rel.first_per_key(v.stops(spark, sf), ["route"], F.col("delivered").desc(), F.col("number").desc(), F.col("stop")).select("route", "stop")


@query("w02_time_since_the_last", f"WITH {v.EVIDENCE} SELECT id, epoch_us(happened) - epoch_us(lag(happened) OVER (PARTITION BY driver ORDER BY happened, id)) AS us FROM evidence")
def _(spark, sf):
    w = Window.partitionBy("driver").orderBy("happened", "id")
    return v.evidence(spark, sf).select("id", (F.unix_micros("happened") - F.unix_micros(F.lag("happened").over(w))).alias("us"))


@query("w04_click_before", f"WITH {v.EVIDENCE}, l AS (SELECT id, lag(kind) OVER w AS before, epoch_ms(happened) - epoch_ms(lag(happened) OVER w) AS gap FROM evidence WINDOW w AS (PARTITION BY driver ORDER BY happened, id)) SELECT id, before FROM l WHERE gap <= 7200000")
def _(spark, sf):
    w = Window.partitionBy("driver").orderBy("happened", "id")
    gap = v.epoch_ms("happened") - v.epoch_ms(F.lag("happened").over(w))
    return v.evidence(spark, sf).select("id", F.lag("kind").over(w).alias("before"), gap.alias("gap")).where("gap <= 7200000").select("id", "before")


@query("w05_blocks_of_stops", f"""WITH RECURSIVE {v.STOPS}, o AS (SELECT route, stop, lat, lng, row_number() OVER (PARTITION BY route ORDER BY seq, stop) AS r FROM stops),
g AS (SELECT route, stop, r, lat AS h_lat, lng AS h_lng, 0 AS grp FROM o WHERE r = 1
UNION ALL SELECT route, stop, r, CASE WHEN same THEN h_lat ELSE lat END, CASE WHEN same THEN h_lng ELSE lng END, CASE WHEN same THEN grp ELSE grp + 1 END
FROM (SELECT o.*, h_lat, h_lng, grp, {v.haversine_sql('h_lat', 'h_lng', 'o.lat', 'o.lng')} <= 2000 AS same FROM g JOIN o ON o.route = g.route AND o.r = g.r + 1)) SELECT route, stop, grp FROM g""")
def _(spark, sf):
    return ops.anchored_groups(v.stops(spark, sf), "seq", 2000.0, consecutive=True)


_CHUNK = 9


@query("w06_chunks", f"WITH {v.STOPS} SELECT route, stop, CAST(floor((row_number() OVER (PARTITION BY route ORDER BY seq, stop) - 1) / {_CHUNK}) AS BIGINT) AS chunk FROM stops WHERE NOT delivered")
def _(spark, sf):
    r = F.row_number().over(Window.partitionBy("route").orderBy("seq", "stop"))
    return v.stops(spark, sf).where("NOT delivered").select("route", "stop", F.floor((r - 1) / _CHUNK).alias("chunk"))


@query("w07_chunk_from_a_stop", f"WITH {v.STOPS}, r AS (SELECT route, stop, row_number() OVER (PARTITION BY route ORDER BY seq, stop) AS r FROM stops WHERE NOT delivered), b AS (SELECT route, min(r) AS first FROM r WHERE stop % 7 = 3 GROUP BY route) SELECT r.route, r.stop FROM r JOIN b USING (route) WHERE r.r BETWEEN first AND first + {_CHUNK} - 1")
def _(spark, sf):
    r = v.stops(spark, sf).where("NOT delivered").withColumn("r", F.row_number().over(Window.partitionBy("route").orderBy("seq", "stop")))
    first = r.where("stop % 7 = 3").groupBy("route").agg(F.min("r").alias("first"))
    return r.join(first, "route").where(f"r BETWEEN first AND first + {_CHUNK} - 1").select("route", "stop")


@query("w08_shares", f"WITH {v.STOPS}, n AS (SELECT route, district, count(*) AS n FROM stops GROUP BY ALL) SELECT route, district, n / sum(n) OVER (PARTITION BY route) AS share FROM n")
def _(spark, sf):
    n = v.stops(spark, sf).groupBy("route", "district").agg(F.count("*").alias("n"))
    return n.select("route", "district", rel.share_of_group(n, "route", "n").alias("share"))


@query("w09_margin_of_the_best", f"WITH {v.STOPS}, n AS (SELECT route, district, count(*) AS n FROM stops GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY n DESC, district) AS r FROM n) SELECT a.route, a.district, a.n - coalesce(b.n, 0) AS margin FROM r a LEFT JOIN r b ON a.route = b.route AND b.r = 2 WHERE a.r = 1")
def _(spark, sf):
    n = v.stops(spark, sf).groupBy("route", "district").agg(F.count("*").alias("n"))
    r = n.withColumn("r", F.row_number().over(Window.partitionBy("route").orderBy(F.col("n").desc(), "district"))).where("r <= 2")
    two = r.groupBy("route").agg(F.min_by("district", "r").alias("district"), F.max("n").alias("best"), F.max(F.when(F.col("r") == 2, F.col("n"))).alias("second"))
    return two.select("route", "district", (F.col("best") - F.coalesce("second", F.lit(0))).alias("margin"))


@query("w11_place_in_the_plan", f"WITH {v.STOPS}, o AS (SELECT route, stop, row_number() OVER (PARTITION BY route ORDER BY stop % 4, seq, stop) AS place FROM stops WHERE stop % 5 <> 1) SELECT s.stop, coalesce(place, carrier, seq) AS place FROM stops s LEFT JOIN o USING (route, stop)")
def _(spark, sf):
    s = v.stops(spark, sf)
    planned = s.where("stop % 5 <> 1").withColumn("place", F.row_number().over(Window.partitionBy("route").orderBy(F.col("stop") % 4, "seq", "stop")).cast("long"))
    return s.join(planned.select("stop", "place"), "stop", "left").select("stop", F.coalesce("place", "carrier", "seq").alias("place"))


@query("j30_street_lookup", f"""WITH {v.STOPS}, {v.SEGMENTS}, q AS (SELECT stop, CASE stop % 3 WHEN 0 THEN 'rua ' || (stop % 9) WHEN 1 THEN 'rua ' || (stop % 9) || ' norte' ELSE 'nothing' END AS key FROM stops),
c AS (SELECT q.stop, 1 AS rank, s.seg FROM q JOIN segments s ON s.name_key = q.key UNION ALL SELECT q.stop, 2, s.seg FROM q JOIN segments s ON starts_with(q.key, s.name_key || ' '))
SELECT stop, arg_min(rank, (rank, seg)) AS rank, arg_min(seg, (rank, seg)) AS seg FROM c GROUP BY stop""")
def _(spark, sf):
    q = v.stops(spark, sf).selectExpr("stop", "CASE stop % 3 WHEN 0 THEN 'rua ' || (stop % 9) WHEN 1 THEN 'rua ' || (stop % 9) || ' norte' ELSE 'nothing' END AS key")
    words = F.split("key", " ")
    # a key meets a name that is the key itself or its first words
    starts = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.struct(F.array_join(F.slice(words, 1, n), " ").alias("name_key"), F.when(n == F.size(words), 1).otherwise(2).alias("rank")))
    asked = q.select("stop", F.explode(starts).alias("s")).select("stop", "s.*")
    least = v.segments(spark, sf).groupBy("name_key").agg(F.min("seg").alias("seg"))  # of a name's segments only the least is an answer
    best = asked.join(least, "name_key").groupBy("stop").agg(F.min(F.struct("rank", "seg")).alias("best"))
    return best.select("stop", "best.rank", "best.seg")


@query("j37_open_at_the_same_door", f"WITH {v.STOPS} SELECT a.stop, min(b.stop) AS open FROM stops a JOIN stops b ON lower(a.street) = lower(b.street) AND a.number % 100 = b.number % 100 AND NOT b.delivered AND a.stop <> b.stop GROUP BY a.stop")
def _(spark, sf):
    s = v.addressed(v.stops(spark, sf).selectExpr("stop", "delivered", "street || ', ' || (number % 100) AS address"))
    s = settled(s.select("stop", "delivered", F.concat_ws("|", F.lower("parts.street"), "parts.number").alias("door")), "doors")
    open_ = s.where("NOT delivered").select("door", F.col("stop").alias("open"))
    # the two least are enough: one of them is another stop
    two = open_.withColumn("r", F.row_number().over(Window.partitionBy("door").orderBy("open"))).where("r <= 2")
    return s.join(two, "door").where("stop <> open").groupBy("stop").agg(F.min("open").alias("open"))


_ASKED = "CASE stop % 3 WHEN 0 THEN 'place ' || (stop % 40) WHEN 1 THEN lower(extra) ELSE lower(district) END"


@query("j31_named_places", f"""WITH {v.STOPS}, q AS (SELECT stop, {_ASKED} AS key FROM stops), learned AS (SELECT 'place ' || (stop % 60) AS key, avg(lat) AS lat FROM stops WHERE precision = 'confirmado' AND stop % 60 < 20 GROUP BY 1),
c AS (SELECT lower(extra) AS key, avg(lat) AS lat, avg(lng) AS lng FROM stops WHERE extra LIKE 'Conjunto%' OR extra LIKE 'Bloco%' GROUP BY 1), near AS (SELECT c.key, any_value(c.lat) AS lat FROM stops s JOIN c ON c.key = lower(s.extra) GROUP BY c.key
  HAVING bool_and({v.haversine_sql('c.lat', 'c.lng', 's.lat', 's.lng')} <= 9000)), d AS (SELECT DISTINCT lower(district) AS key FROM stops)
SELECT stop, CASE WHEN l.key IS NOT NULL THEN 'learned' ELSE 'complex' END AS how, round(coalesce(l.lat, n.lat), 6) AS lat FROM q LEFT JOIN learned l USING (key) LEFT JOIN near n USING (key) WHERE coalesce(l.lat, n.lat) IS NOT NULL AND key NOT IN (SELECT key FROM d)""")
def _(spark, sf):
    s = v.stops(spark, sf)
    q = s.selectExpr("stop", f"{_ASKED} AS key").join(s.select(F.lower("district").alias("key")).distinct(), "key", "left_anti")
    learned = s.where("precision = 'confirmado' AND stop % 60 < 20").groupBy(F.expr("'place ' || (stop % 60)").alias("key")).agg(F.avg("lat").alias("l_lat"))
    own = s.where("extra LIKE 'Conjunto%' OR extra LIKE 'Bloco%'").select(F.lower("extra").alias("key"), "lat", "lng")
    centre = own.groupBy("key").agg(F.avg("lat").alias("c_lat"), F.avg("lng").alias("c_lng"))
    together = own.join(centre, "key").groupBy("key", "c_lat").agg(F.bool_and(haversine("c_lat", "c_lng", "lat", "lng") <= 9000).alias("ok")).where("ok").drop("ok")
    both = q.join(learned, "key", "left").join(together, "key", "left").where("l_lat IS NOT NULL OR c_lat IS NOT NULL")
    return both.select("stop", F.when(F.col("l_lat").isNotNull(), "learned").otherwise("complex").alias("how"), F.round(F.coalesce("l_lat", "c_lat"), 6).alias("lat"))


_NAMED = "CASE stop % 5 WHEN 0 THEN 'Condominio Mirante Atalaia' WHEN 1 THEN 'Edificio Aquarela' WHEN 2 THEN 'Residencial Mirante da Atalaia' WHEN 3 THEN 'perto da padaria' ELSE 'Bloco 2' END"
_DOOR_KEY = "CASE WHEN stop % 5 IN (0, 2) THEN 'atalaia mirante' WHEN stop % 5 = 1 THEN 'aquarela' END"


@query("x31_same_door_by_name", f"WITH {v.STOPS}, s AS (SELECT stop, CASE WHEN stop % 7 > 0 THEN stop % 40 END AS number, {_DOOR_KEY} AS key FROM stops) SELECT a.stop, count(*) AS others FROM s a JOIN s b ON a.key = b.key AND a.stop <> b.stop AND (a.number = b.number OR a.number IS NULL OR b.number IS NULL) GROUP BY a.stop")
def _(spark, sf):
    said = F.expr(f"street || CASE WHEN stop % 7 > 0 THEN ', ' || (stop % 40) ELSE '' END || ', ' || {_NAMED} AS address")
    s = v.addressed(v.stops(spark, sf).select("stop", "district", said))
    s = settled(s.select("stop", F.col("parts.number").alias("number"), a.place_name_key(a.place_hints()).alias("key")), "place-names").where("key IS NOT NULL")
    # counted per key and number, so doors of a frequent key are no pairs; a door without a number is the same as all of its key
    n = s.groupBy("key", "number").agg(F.count("*").alias("n"))
    same = n.where("number IS NOT NULL").withColumnRenamed("n", "same")
    unknown = n.where("number IS NULL").select("key", F.col("n").alias("unknown"))
    of_key = n.groupBy("key").agg(F.sum("n").alias("of_key"))
    both = s.join(same, ["key", "number"], "left").join(unknown, "key", "left").join(of_key, "key")
    others = F.when(F.col("number").isNull(), F.col("of_key")).otherwise(F.col("same") + F.coalesce("unknown", F.lit(0))) - 1
    return both.select("stop", others.alias("others")).where("others > 0")


@query("x32_receipt_lines", f"WITH {v.STOPS} SELECT stop, CAST(CASE WHEN stop % 2 = 0 THEN 3 ELSE 1 END AS BIGINT) AS marks, stop % 2 = 0 AS receipt FROM stops")
def _(spark, sf):
    said = F.expr("CASE WHEN stop % 2 = 0 THEN 'ID do pedido 12\nCliente: x\n' || address || '\nTaxa de entrega 5' ELSE address || '\nCNPJ 1' END")
    return v.stops(spark, sf).select("stop", a.receipt_marks(said).alias("marks"), (a.receipt_marks(said) >= 2).alias("receipt"))


@query("x34_lines_repaired", f"""WITH {v.STOPS}, n AS (SELECT DISTINCT lower(street) || ' de baixo' AS name FROM stops), q AS (SELECT DISTINCT replace(lower(street), 'o', 'oo') || ' de baixo' AS name FROM stops),
d AS (SELECT q.name, n.name AS candidate, levenshtein(q.name, n.name) AS edits, row_number() OVER (PARTITION BY q.name ORDER BY levenshtein(q.name, n.name), n.name) AS r FROM q JOIN n ON q.name <> n.name)
SELECT x.name || ', 12' AS line, x.candidate || ', 12' AS repaired FROM d x LEFT JOIN d y ON x.name = y.name AND y.r = 2 WHERE x.r = 1 AND length(x.name) >= 8 AND x.edits <= 0.35 * length(x.name) AND coalesce(y.edits - x.edits, 3) >= 3""")
def _(spark, sf):
    s = v.stops(spark, sf)
    known = s.selectExpr("lower(street) || ' de baixo' AS candidate")
    lines = s.selectExpr("replace(lower(street), 'o', 'oo') || ' de baixo, 12' AS line").distinct().withColumn("name", F.split_part("line", F.lit(","), F.lit(1)))
    best = rel.fuzzy_best(lines.select("name"), known)
    return lines.join(best, "name").select("line", F.replace("line", F.col("name"), F.col("candidate")).alias("repaired"))


@query("x26_readings_linked", None)
def _(spark, sf):
    s = v.stops(spark, sf).selectExpr("route AS document", "stop % 3 AS reading", "CASE WHEN stop % 5 = 0 THEN '| ' || address ELSE address END AS line")
    return ops.linked_readings(v.addressed(s, "line").select("document", "reading", "line", a.street_and_number().alias("door"), a.complement_key(F.col("parts.rest")).alias("unit")))
