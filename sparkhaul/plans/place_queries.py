"""Queries that join points, doors, segments, areas and marks, and the geometry they use."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as t
from ..functions.geo import flat_distance, haversine, within
from ..operators import places as ops
from ..operators import ranks
from ..operators import relational as rel
from ..session import load
from . import views as v
from .registry import registry

QUERIES, query = registry()

_PLACE = "CAST(cep AS VARCHAR) || '|' || number"
_CENTRE = (-9.45, -35.65)


@query("j01_active_evidence", f"WITH {v.EVIDENCE}, {v.PROFILES} SELECT e.id, p.name FROM evidence e JOIN profiles p ON e.driver = p.driver WHERE p.active AND NOT e.pending")
def _(spark, sf):
    own = v.profiles(spark, sf).where("active").select("driver", "name")
    return v.evidence(spark, sf).where("NOT pending").join(own, "driver").select("id", "name")


@query("j02_routes_left_counts", f"""WITH {v.PACKAGES}, {v.ROUTES} SELECT r.route, count(p.route) AS packages, count(p.route) FILTER (WHERE p.delivered) AS delivered
FROM routes r LEFT JOIN packages p ON r.route = p.route AND p.flag = 'R' WHERE r.state = 'O' GROUP BY r.route""")
def _(spark, sf):
    counts = (F.count("*").alias("packages"), F.count_if("delivered").alias("delivered"))
    return rel.count_per(v.routes(spark, sf).where("state = 'O'").select("route"), v.packages(spark, sf).where("flag = 'R'"), "route", *counts)


@query("j03_support_within_30m", f"""WITH {v.EVIDENCE}, m AS ({v.standing()})
SELECT a.id, count(*) FILTER (WHERE b.correction) AS nc, count(*) FILTER (WHERE NOT b.correction) AS np, count(*) FILTER (WHERE b.pinned) AS npp
FROM m a JOIN m b ON a.place = b.place AND {v.flat('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 30 GROUP BY a.id""")
def _(spark, sf):
    from ..operators.evidence import standing_marks

    m = standing_marks(v.evidence(spark, sf))
    kinds = (("nc", F.col("correction")), ("np", ~F.col("correction")), ("npp", F.col("pinned")))
    spots = m.groupBy("place", "lat", "lng").agg(*(F.count_if(c).alias(n) for n, c in kinds))
    near = within(m.select("place", "lat", "lng").distinct(), spots, 30.0, ["place"])
    sums = near.groupBy("place", "lat", "lng").agg(*(F.sum(f"r_{n}").alias(n) for n, _ in kinds))
    return m.select("id", "place", "lat", "lng").join(sums, ["place", "lat", "lng"]).select("id", "nc", "np", "npp")


@query("j04_sightings_within_120m", f"""WITH {v.EVIDENCE}, s AS (SELECT DISTINCT place, lat, lng FROM evidence WHERE NOT correction)
SELECT s.place, s.lat, s.lng, count(DISTINCT (e.driver, e.day)) AS seen, bool_or(e.driver = 8) AS mine
FROM s JOIN evidence e ON NOT e.correction AND s.place = e.place AND {v.flat('s.lat', 's.lng', 'e.lat', 'e.lng')} <= 120 GROUP BY ALL""")
def _(spark, sf):
    e = v.evidence(spark, sf).where("NOT correction").select("place", "lat", "lng", "driver", "day").distinct()
    near = within(e.select("place", "lat", "lng").distinct(), e, 120.0, ["place"])
    return near.groupBy("place", "lat", "lng").agg(F.countDistinct(F.struct("r_driver", "r_day")).alias("seen"), F.bool_or(F.col("r_driver") == 8).alias("mine"))


@query("j05_nearest_segment", f"""WITH {v.STOPS}, {v.SEGMENTS}, d AS (
SELECT stop, seg, city, s.district, row_number() OVER (PARTITION BY stop ORDER BY {v.flat('p.lat', 'p.lng', 'lat0', 'lng0')}, seg) AS r FROM stops p, segments s)
SELECT stop, seg, city, district FROM d WHERE r = 1""")
def _(spark, sf):
    s = v.segments(spark, sf)
    points = v.stops(spark, sf).select("stop", "lat", "lng")
    found = geo.nearest(points, s.select("seg", F.col("lat0").alias("lat"), F.col("lng0").alias("lng")), "stop", "seg")
    return found.join(s, F.col("r_seg") == F.col("seg")).select("stop", "seg", "city", "district")


@query("j06_closest_of_the_driver", f"""WITH {v.STOPS}, {v.EVIDENCE}, m AS (SELECT DISTINCT driver % 14 AS driver, lat, lng + 1.37e0 AS lng FROM evidence WHERE pinned),
d AS (SELECT m.*, s.stop, row_number() OVER (PARTITION BY m.driver, m.lat, m.lng ORDER BY pow(s.lat - m.lat, 2) + pow(s.lng - m.lng, 2), s.stop) AS r FROM m LEFT JOIN stops s ON s.driver = m.driver)
SELECT driver, lat, lng, stop FROM d WHERE r = 1""")
def _(spark, sf):
    m = v.evidence(spark, sf).where("pinned").selectExpr("driver % 14 AS driver", "lat", "lng + 1.37e0 AS lng").distinct()
    s = v.stops(spark, sf).select("driver", "stop", "lat", "lng")
    best = geo.closest(m, s, ["driver"], "stop")
    # where no distance can be told, the least stop of the driver is the first
    least = s.groupBy("driver").agg(F.min("stop").alias("least"))
    return m.join(best, ["driver", "lat", "lng"], "left").join(least, "driver", "left").select("driver", "lat", "lng", F.coalesce("stop", "least").alias("stop"))


@query("j08_segments_with_observations", f"""WITH {v.VERTICES}, {v.STOPS} SELECT DISTINCT x.seg, p.stop FROM vertices x JOIN stops p ON {v.flat('x.lat', 'x.lng', 'p.lat', 'p.lng')} <= 120""")
def _(spark, sf):
    near = geo.around(v.stops(spark, sf).select("stop", "lat", "lng"), v.vertices(spark, sf), ["seg"], 120.0, "lat", "lng")
    return near.where(F.exists("parts", lambda p: flat_distance(p["lat"], p["lng"], "lat", "lng") <= 120)).select("seg", "stop")


@query("j09_streets_not_mapped_elsewhere", f"""WITH {v.SEGMENTS} SELECT seg FROM segments a WHERE source = 'entregas' AND name_key IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM segments b WHERE b.name_key = a.name_key AND b.city = a.city AND b.source <> 'entregas')""")
def _(spark, sf):
    s = v.segments(spark, sf)
    own = s.where("source = 'entregas' AND name_key IS NOT NULL")
    return own.join(s.where("source <> 'entregas'").select("name_key", "city"), ["name_key", "city"], "left_anti").select("seg")


@query("j10_places_of_approved_marks", f"""WITH {v.EVIDENCE}, places AS (SELECT DISTINCT place, lat, lng FROM evidence WHERE pending), marks AS (
SELECT place, lat, lng FROM evidence WHERE correction AND NOT pending UNION ALL SELECT place, lat, lng FROM evidence WHERE pinned AND NOT pending AND NOT refused)
SELECT place, lat, lng FROM places p WHERE EXISTS (SELECT 1 FROM marks m WHERE m.place = p.place AND {v.flat('p.lat', 'p.lng', 'm.lat', 'm.lng')} <= 1)""")
def _(spark, sf):
    e = v.evidence(spark, sf)
    marks = e.where("correction AND NOT pending").select("place", "lat", "lng").unionByName(e.where("pinned AND NOT pending AND NOT refused").select("place", "lat", "lng"))
    near = within(e.where("pending").select("place", "lat", "lng").distinct(), marks.distinct(), 1.0, ["place"])
    return near.select("place", "lat", "lng").distinct()


@query("j11_update_from", f"""WITH {v.STOPS}, fixes AS (SELECT stop, lat + 0.001e0 AS lat, 'exato' AS precision FROM stops WHERE stop % 9 = 0)
SELECT s.stop, coalesce(f.lat, s.lat) AS lat, s.lng, coalesce(f.precision, s.precision) AS precision FROM stops s LEFT JOIN fixes f USING (stop)""")
def _(spark, sf):
    s = v.stops(spark, sf).select("stop", "lat", "lng", "precision")
    fixes = s.where("stop % 9 = 0").selectExpr("stop", "lat + 0.001e0 AS new_lat", "'exato' AS new_precision")
    return s.join(fixes, "stop", "left").select("stop", F.coalesce("new_lat", "lat").alias("lat"), "lng", F.coalesce("new_precision", "precision").alias("precision"))


@query("j18_history_positions", f"""WITH {v.EVIDENCE}, seen AS (SELECT place, driver, day, lat, lng FROM (
SELECT *, row_number() OVER (PARTITION BY place, driver, day ORDER BY happened DESC, id DESC) AS r FROM evidence WHERE pinned) WHERE r = 1)
SELECT e.id, coalesce(s.lat, e.lat) AS lat, coalesce(s.lng, e.lng) AS lng, s.place IS NOT NULL AS observed
FROM evidence e LEFT JOIN seen s ON e.place = s.place AND e.driver = s.driver AND e.day = s.day WHERE NOT e.pinned""")
def _(spark, sf):
    e, key = v.evidence(spark, sf), ["place", "driver", "day"]
    seen = rel.first_per_key(e.where("pinned"), key, F.col("happened").desc(), F.col("id").desc()).select(*key, F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"))
    both = e.where("NOT pinned").join(seen, key, "left")
    return both.select("id", F.coalesce("s_lat", "lat").alias("lat"), F.coalesce("s_lng", "lng").alias("lng"), F.col("s_lat").isNotNull().alias("observed"))


def _corner(k: int) -> tuple[str, str]:
    y, x = v.CORNERS[k % len(v.CORNERS)]
    return f"(a.lat + {y}e0 * a.half)", f"(a.lng + {x}e0 * a.half)"


def _crosses(k: int) -> str:
    (ay, ax), (by, bx) = _corner(k), _corner(k + 1)
    return f"CASE WHEN ({ay} > p.lat) <> ({by} > p.lat) AND p.lng < ({bx} - {ax}) * (p.lat - {ay}) / ({by} - {ay}) + {ax} THEN 1 ELSE 0 END"


_INSIDE = "(" + " + ".join(_crosses(k) for k in range(len(v.CORNERS)) if v.CORNERS[k][0] != v.CORNERS[(k + 1) % len(v.CORNERS)][0]) + ") % 2 = 1"


def _rings(spark, sf):
    ring = F.array(*(F.struct((F.col("lat") + y * F.col("half")).alias("lat"), (F.col("lng") + x * F.col("half")).alias("lng")) for y, x in v.CORNERS))
    return v.areas(spark, sf).select("area", "kind", F.col("half").alias("size"), ring.alias("ring"))


@query("j19_smallest_area", f"""WITH {v.STOPS}, {v.AREAS}, d AS (SELECT p.stop, a.area, row_number() OVER (PARTITION BY p.stop ORDER BY a.kind <> 'complex', a.half, a.area) AS r
FROM stops p JOIN areas a ON {_INSIDE}) SELECT stop, area FROM d WHERE r = 1""")
def _(spark, sf):
    return ops.containing_area(v.stops(spark, sf), _rings(spark, sf), "stop")


def _segment_sql(lat: str, lng: str) -> str:
    """Metres from a point to the edge (lat1, lng1) - (lat2, lng2)."""
    k = f"(cos(radians({lat})) * 111320e0)"
    ax, ay, bx, by = f"((lng1 - {lng}) * {k})", f"((lat1 - {lat}) * 111320e0)", f"((lng2 - {lng}) * {k})", f"((lat2 - {lat}) * 111320e0)"
    share = f"greatest(0e0, least(1e0, -({ax} * ({bx} - {ax}) + {ay} * ({by} - {ay})) / (pow({bx} - {ax}, 2) + pow({by} - {ay}, 2))))"
    return f"sqrt(pow({ax} + {share} * ({bx} - {ax}), 2) + pow({ay} + {share} * ({by} - {ay}), 2))"


_EDGES = "edges AS (SELECT a.seg, a.i, a.lat AS lat1, a.lng AS lng1, b.lat AS lat2, b.lng AS lng2 FROM vertices a JOIN vertices b ON a.seg = b.seg AND b.i = a.i + 1)"


@query("j20_points_near_lines", f"""WITH {v.VERTICES}, {v.STOPS}, {_EDGES}
SELECT p.stop, e.seg, round(min({_segment_sql('p.lat', 'p.lng')}), 4) AS metres FROM stops p JOIN edges e ON {_segment_sql('p.lat', 'p.lng')} <= 300 GROUP BY ALL""")
def _(spark, sf):
    return ops.near_segments(v.stops(spark, sf), v.vertices(spark, sf), "stop", 300.0).withColumn("metres", F.floor(F.col("metres") * 10_000 + 0.5) / 10_000)  # F.round goes through decimals, which takes longer than the join


@query("j21_lines_in_the_same_street", f"""WITH {v.VERTICES}, {_EDGES}, n AS (SELECT *, CAST(greatest(1, ceil({v.flat('lat1', 'lng1', 'lat2', 'lng2')} / 10)) AS BIGINT) AS n FROM edges),
dots AS (SELECT seg, i, k, lat1 + (lat2 - lat1) * (k / n) AS lat, lng1 + (lng2 - lng1) * (k / n) AS lng FROM n, unnest(range(n + 1)) AS t(k))
SELECT DISTINCT a.seg, b.seg AS other FROM dots a JOIN edges b ON a.seg <> b.seg AND {_segment_sql('a.lat', 'a.lng').replace('lat1', 'b.lat1').replace('lng1', 'b.lng1').replace('lat2', 'b.lat2').replace('lng2', 'b.lng2')} <= 20""")
def _(spark, sf):
    lines = v.vertices(spark, sf)
    dots = ops.densified(lines, 10.0).select(F.col("seg").alias("line"), "lat", "lng")
    found = ops.near_segments(dots, lines, "line", 20.0, 40.0)
    return found.where("line <> seg").select(F.col("line").alias("seg"), F.col("seg").alias("other")).distinct()


_DOORS = f"{v.STOPS}, doors AS (SELECT DISTINCT stop AS door, street, number, district, lat, lng FROM stops)"


@query("j23_census_by_street", f"""WITH {_DOORS}, q AS (SELECT stop AS query, street, (number * 7) % 500 AS wanted, district AS stated, lat AS q_lat, lng AS q_lng FROM stops),
g AS (SELECT query, wanted, stated, q_lat, q_lng, d.district, d.door, d.lat, d.lng, abs(d.number - wanted) AS gap,
  row_number() OVER (PARTITION BY query, d.district ORDER BY abs(d.number - wanted), d.door) AS r FROM q JOIN doors d USING (street) WHERE abs(d.number - wanted) <= 20),
b AS (SELECT *, round({v.flat('q_lat', 'q_lng', 'lat', 'lng')}, 3) AS metres, count(*) OVER (PARTITION BY query) AS districts,
  row_number() OVER (PARTITION BY query ORDER BY stated <> district, {v.flat('q_lat', 'q_lng', 'lat', 'lng')}, door) AS best FROM g WHERE r = 1)
SELECT query, district, door, gap, metres FROM b WHERE best = 1 AND (districts = 1 OR stated = district OR metres <= 1500)""")
def _(spark, sf):
    s = v.stops(spark, sf)
    doors = s.select(F.col("stop").alias("door"), "street", "number", "district", "lat", "lng")
    q = s.selectExpr("stop AS query", "street", "(number * 7) % 500 AS wanted", "district AS stated", "lat AS q_lat", "lng AS q_lng")
    best = ops.nearest_numbers(doors, q.select("street", "wanted").distinct(), ["street"], ["district"], 20)
    # a query meets one door of each district of its street
    best = q.join(best, ["street", "wanted"])
    far = flat_distance("q_lat", "q_lng", "lat", "lng")
    rank = F.struct((F.col("stated") != F.col("district")).alias("other"), far.alias("far"), "door", "gap", "district")
    one = best.groupBy("query", "stated").agg(F.count("*").alias("districts"), F.min(rank).alias("b")).select("query", "stated", "districts", "b.*").withColumn("metres", F.round("far", 3))
    return one.where("districts = 1 OR stated = district OR metres <= 1500").select("query", "district", "door", "gap", "metres")


@query("j27_same_named_place", """WITH n AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS name FROM part), w AS (SELECT name, list_sort(list_distinct(list_filter(string_split(lower(name), ' '), lambda x: length(x) >= 5))) AS hints FROM n)
SELECT a.name AS a, b.name AS b FROM w a JOIN w b ON a.name < b.name
AND (len(list_intersect(a.hints, b.hints)) >= 2 OR len(list_filter(list_intersect(a.hints, b.hints), lambda x: length(x) >= 8)) >= 1)""")
def _(spark, sf):
    hints = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("name"), " "), lambda x: F.length(x) >= 5)))
    w = load(spark, sf, "part").selectExpr("p_name || ' ' || lower(p_type) AS name").distinct().select("name", hints.alias("hints"))
    # names meet by a pair of hints, or by one long hint: what the rule asks for, so no pair is made for nothing
    pair = F.flatten(F.transform("hints", lambda x, i: F.transform(F.slice(F.col("hints"), i + 2, F.size("hints")), lambda y: F.concat(x, F.lit(" "), y))))
    long = F.filter("hints", lambda x: F.length(x) >= 8)
    each = w.select("name", F.explode(F.array_distinct(F.concat(pair, long))).alias("key"))
    other = each.select(F.col("name").alias("b"), "key")
    return each.select(F.col("name").alias("a"), "key").join(other, "key").where("a < b").select("a", "b").distinct()


_READ = "CASE stop % 4 WHEN 0 THEN district WHEN 1 THEN 'Condominio ' || district || ' Norte' WHEN 2 THEN 'nowhere' ELSE lower(district) END"


@query("j28_district_anchor", f"""WITH {v.STOPS}, anchors AS (SELECT lower(district) AS name, median(lat) AS lat FROM stops GROUP BY ALL), q AS (SELECT stop, lower({_READ}) AS said FROM stops),
d AS (SELECT stop, name, a.lat, row_number() OVER (PARTITION BY stop ORDER BY said <> name, length(name) DESC, name) AS r FROM q JOIN anchors a ON contains(said, name))
SELECT stop, name, lat FROM d WHERE r = 1""")
def _(spark, sf):
    s = v.stops(spark, sf)
    anchors = s.groupBy(F.lower("district").alias("name")).agg(F.median("lat").alias("lat"))
    said = s.selectExpr("stop", f"lower({_READ}) AS said")
    # a name is found in a reading as a run of its words, so runs of words are the join key
    words = F.split("said", " ")
    runs = F.flatten(F.transform(words, lambda _, i: F.transform(F.sequence(F.lit(1), F.size(words) - i), lambda n: F.array_join(F.slice(words, i + 1, n), " "))))
    found = said.select("stop", "said", F.explode(F.array_distinct(runs)).alias("name")).join(anchors, "name")
    return rel.first_per_key(found, ["stop"], F.col("said") != F.col("name"), F.length("name").desc(), F.col("name")).select("stop", "name", "lat")


@query("j29_anchor_order", f"""WITH {v.STOPS}, learned AS (SELECT cep, avg(lat) AS lat FROM stops WHERE precision = 'confirmado' GROUP BY cep HAVING count(*) >= 2),
told AS (SELECT district, avg(lat) AS lat FROM stops WHERE stop % 2 = 0 GROUP BY district HAVING count(*) >= 40), pre AS (SELECT CAST(floor(cep / 1000) AS BIGINT) AS p, avg(lat) AS lat FROM stops GROUP BY ALL),
c AS (SELECT stop, 1 AS rank, 'cep' AS source, l.lat FROM stops JOIN learned l USING (cep) UNION ALL SELECT stop, 2, 'district', t.lat FROM stops JOIN told t USING (district)
  UNION ALL SELECT stop, 3, 'prefix', pre.lat FROM stops JOIN pre ON p = CAST(floor(cep / 1000) AS BIGINT))
SELECT stop, source, round(lat, 6) AS lat FROM (SELECT *, row_number() OVER (PARTITION BY stop ORDER BY rank) AS r FROM c) WHERE r = 1""")
def _(spark, sf):
    s = v.stops(spark, sf).withColumn("prefix", F.floor(F.col("cep") / 1000).cast("long"))
    mean = F.avg("lat").alias("a_lat")
    learned = s.where("precision = 'confirmado'").groupBy("cep").agg(mean, F.count("*").alias("n")).where("n >= 2").drop("n")
    told = s.where("stop % 2 = 0").groupBy("district").agg(mean, F.count("*").alias("n")).where("n >= 40").drop("n")
    anchors = (("cep", learned), ("district", told), ("prefix", s.groupBy("prefix").agg(mean)))
    found = s
    for name, a in anchors:
        found = found.join(a.withColumnRenamed("a_lat", f"{name}_lat"), name, "left")
    source = F.when(F.col("cep_lat").isNotNull(), "cep").when(F.col("district_lat").isNotNull(), "district").otherwise("prefix")
    return found.select("stop", source.alias("source"), F.round(F.coalesce("cep_lat", "district_lat", "prefix_lat"), 6).alias("lat"))


@query("j32_doors_of_a_street", f"""WITH {_DOORS}, q AS (SELECT DISTINCT street, min(lat) AS q_lat, min(lng) AS q_lng FROM stops GROUP BY street)
SELECT q.street, d.door FROM q JOIN doors d USING (street) WHERE {v.flat('q_lat', 'q_lng', 'd.lat', 'd.lng')} <= 1500""")
def _(spark, sf):
    s = v.stops(spark, sf)
    q = s.groupBy("street").agg(F.min("lat").alias("lat"), F.min("lng").alias("lng"))
    near = within(q, s.select("street", F.col("stop").alias("door"), "lat", "lng"), 1500.0, ["street"])
    return near.select("street", F.col("r_door").alias("door"))


@query("j33_candidate_acceptance", f"""WITH {_DOORS}, n AS (SELECT street, count(DISTINCT district) AS districts FROM doors GROUP BY street), x AS (SELECT DISTINCT street, number FROM doors)
SELECT stop, CASE WHEN x.street IS NOT NULL THEN 'exact' WHEN districts >= 2 THEN 'name in several districts' ELSE 'refused' END AS verdict
FROM (SELECT stop, street, (number * 7) % 500 AS wanted FROM stops) q LEFT JOIN x ON x.street = q.street AND x.number = wanted LEFT JOIN n ON n.street = q.street""")
def _(spark, sf):
    s = v.stops(spark, sf)
    known = s.select("street", F.col("number").alias("wanted")).distinct().withColumn("exact", F.lit(True))
    spread = s.groupBy("street").agg(F.countDistinct("district").alias("districts"))
    q = s.selectExpr("stop", "street", "(number * 7) % 500 AS wanted").join(known, ["street", "wanted"], "left").join(spread, "street", "left")
    verdict = F.when(F.col("exact"), "exact").when(F.col("districts") >= 2, "name in several districts").otherwise("refused")
    return q.select("stop", verdict.alias("verdict"))


@query("j34_complement_street_rescue", f"""WITH {_DOORS}, known AS (SELECT DISTINCT street FROM doors WHERE number % 2 = 0),
q AS (SELECT stop, CASE WHEN stop % 5 = 0 THEN 'Rua Nova' ELSE street END AS street, street AS inner_street, number, district, lat, lng FROM stops),
b AS (SELECT q.stop, d.door, {v.flat('q.lat', 'q.lng', 'd.lat', 'd.lng')} AS metres, row_number() OVER (PARTITION BY q.stop ORDER BY d.door) AS r
  FROM q JOIN doors d ON d.street = q.inner_street AND d.number % 10 = q.number % 10 AND d.district = q.district WHERE q.street NOT IN (SELECT street FROM known))
SELECT stop, door, round(metres, 3) AS metres FROM b WHERE r = 1 AND metres > 80""")
def _(spark, sf):
    s = v.stops(spark, sf)
    q = s.selectExpr("stop", "CASE WHEN stop % 5 = 0 THEN 'Rua Nova' ELSE street END AS street", "street AS inner_street", "number % 10 AS number", "district", "lat", "lng")
    lost = q.join(s.where("number % 2 = 0").select("street"), "street", "left_anti")
    doors = s.selectExpr("street AS inner_street", "number % 10 AS number", "district", "stop AS door", "lat AS d_lat", "lng AS d_lng")
    # the least door answers every stop of its key, so a key is one row before stops meet it
    least = doors.groupBy("inner_street", "number", "district").agg(F.min(F.struct("door", "d_lat", "d_lng")).alias("d")).select("inner_street", "number", "district", "d.*")
    found = lost.join(least, ["inner_street", "number", "district"]).withColumn("metres", flat_distance("lat", "lng", "d_lat", "d_lng"))
    return found.where("metres > 80").select("stop", "door", F.round("metres", 3).alias("metres"))


@query("j35_segments_to_label", f"""WITH {v.SEGMENTS}, today AS (SELECT DISTINCT 'rua ' || (stop % 6) AS name_key FROM (SELECT c_custkey AS stop FROM customer WHERE c_custkey % 4 = 1))
SELECT seg FROM segments s WHERE source = 'prefeitura' AND seg % 3 <> 2 AND EXISTS (SELECT 1 FROM today t WHERE t.name_key = s.name_key)""")
def _(spark, sf):
    today = v.stops(spark, sf).where("stop % 4 = 1").selectExpr("'rua ' || (stop % 6) AS name_key").distinct()
    return v.segments(spark, sf).where("source = 'prefeitura' AND seg % 3 <> 2").join(today, "name_key", "left_semi").select("seg")


@query("j36_packages_behind_a_mark", f"""WITH {v.PACKAGES}, {v.ROUTES}, last AS (SELECT driver, stop, arg_max(route, (day, route)) AS route FROM packages JOIN routes USING (route) GROUP BY ALL)
SELECT l.driver, l.stop, l.route, count(*) AS packages FROM last l JOIN packages p ON p.route = l.route AND p.stop = l.stop GROUP BY ALL""")
def _(spark, sf):
    p = v.packages(spark, sf)
    counted = p.groupBy("route", "stop").agg(F.count("*").alias("packages")).join(v.routes(spark, sf), "route")
    best = counted.groupBy("driver", "stop").agg(F.max(F.struct("day", "route", "packages")).alias("last"))
    return best.select("driver", "stop", "last.route", "last.packages")


@query("j38_complaints_onto_stops", f"""WITH {v.STOPS}, {v.EVIDENCE}, c AS (SELECT place, kind, max(happened) AS last_at, bool_or(driver = 8) AS mine FROM evidence WHERE kind IN ('error', 'view') GROUP BY ALL)
SELECT stop, kind AS reason, mine OR stop % 13 = 0 AS mine FROM stops JOIN c ON c.place = CAST(stop % 100 AS VARCHAR)""")
def _(spark, sf):
    c = v.evidence(spark, sf).where("kind IN ('error', 'view')").groupBy("place", F.col("kind").alias("reason")).agg(F.bool_or(F.col("driver") == 8).alias("mine"))
    s = v.stops(spark, sf).select("stop", F.expr("CAST(stop % 100 AS STRING)").alias("place"))
    return s.join(c, "place").select("stop", "reason", (F.col("mine") | (F.col("stop") % 13 == 0)).alias("mine"))


@query("j39_commercial_wishes", f"""WITH {v.STOPS}, {v.EVIDENCE}, server AS (SELECT place, true AS flag FROM evidence WHERE pinned GROUP BY place), wishes AS (SELECT DISTINCT CAST(k AS VARCHAR) AS place, k % 2 = 0 AS flag FROM range(100) t(k) WHERE k % 4 < 2)
SELECT stop, coalesce(w.flag, s.flag, false) AS commercial, w.place IS NOT NULL AS waiting FROM stops LEFT JOIN wishes w ON w.place = CAST(stop % 100 AS VARCHAR) LEFT JOIN server s ON s.place = CAST(stop % 100 AS VARCHAR)""")
def _(spark, sf):
    s = v.stops(spark, sf).select("stop", F.expr("CAST(stop % 100 AS STRING)").alias("place"))
    server = v.evidence(spark, sf).where("pinned").select("place", F.lit(True).alias("known")).distinct()
    wishes = spark.range(100).where("id % 4 < 2").selectExpr("CAST(id AS STRING) AS place", "id % 2 = 0 AS wish")
    both = s.join(wishes, "place", "left").join(server, "place", "left")
    return both.select("stop", F.coalesce("wish", "known", F.lit(False)).alias("commercial"), F.col("wish").isNotNull().alias("waiting"))


@query("a07_street_naming", f"""WITH {v.VERTICES}, {v.STOPS}, near AS (SELECT DISTINCT x.seg, p.stop, lower(p.street) AS name_key FROM vertices x JOIN segments s ON s.seg = x.seg AND s.name_key IS NULL
  JOIN stops p ON {v.flat('x.lat', 'x.lng', 'p.lat', 'p.lng')} <= 400), n AS (SELECT seg, name_key, count(*) AS times FROM near GROUP BY ALL)
SELECT seg, name_key, times FROM (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY times DESC, name_key) AS r FROM n) WHERE r = 1""")
def _(spark, sf):
    seen = v.stops(spark, sf).select(F.col("stop").alias("id"), F.lower("street").alias("street_key"), "lat", "lng")
    return ops.name_unnamed(v.segments(spark, sf), v.vertices(spark, sf), seen, 400.0)


@query("a08_street_synthesis", f"""WITH {v.STOPS}, p AS (SELECT street || ' ' || CAST(floor(lat * 50) AS BIGINT) || ' ' || CAST(floor(lng * 50) AS BIGINT) AS street_key, street AS name, {_PLACE} AS place, round(lat + 1e-8, 5) AS lat, round(lng, 5) AS lng FROM stops),
n AS (SELECT street_key, name, count(*) AS n FROM p GROUP BY ALL), m AS (SELECT street_key, count(DISTINCT place) AS doors, avg(lat) AS lat, avg(lng) AS lng, count(*) AS times, count(DISTINCT (lat, lng)) AS line_points,
  max(lat) - min(lat) AS sa, (max(lng) - min(lng)) * cos(radians(avg(lat))) AS so FROM p GROUP BY street_key)
SELECT street_key, arg_max(name, (n, name)) AS name, CAST(round(any_value(lat * times) * 100000) AS BIGINT) AS lat_sum, CAST(round(any_value(lng * times) * 100000) AS BIGINT) AS lng_sum, any_value(times) AS times, any_value(line_points) AS line_points, any_value(sa >= so) AS long_in_lat
FROM m JOIN n USING (street_key) WHERE doors >= 2 AND 111320 * sqrt(pow(sa, 2) + pow(so, 2)) <= 2000 GROUP BY street_key""")
def _(spark, sf):
    p = v.stops(spark, sf).selectExpr("street || ' ' || CAST(floor(lat * 50) AS BIGINT) || ' ' || CAST(floor(lng * 50) AS BIGINT) AS street_key", "street AS name", _PLACE.replace("VARCHAR", "STRING") + " AS place", "round(lat + 1e-8, 5) AS lat", "round(lng, 5) AS lng")
    found = ops.streets_of_deliveries(p, 2000.0)
    sums = (F.round(F.col(c) * F.col("times") * 100000).cast("long").alias(f"{c}_sum") for c in ("lat", "lng"))
    return found.select("street_key", "name", *sums, "times", "line_points", "long_in_lat")


@query("f11_inside_box", f"WITH {v.STOPS} SELECT stop FROM stops WHERE lat BETWEEN -9.47 AND -9.43 AND lng BETWEEN -35.68 AND -35.64")
def _(spark, sf):
    return v.stops(spark, sf).where("lat BETWEEN -9.47D AND -9.43D AND lng BETWEEN -35.68D AND -35.64D").select("stop")


@query("f12_inside_region", f"WITH {v.STOPS} SELECT stop FROM stops WHERE {v.haversine_sql('-9.45e0', '-35.65e0', 'lat', 'lng')} <= 4000")
def _(spark, sf):
    return v.stops(spark, sf).where(haversine(*map(F.lit, _CENTRE), F.col("lat"), F.col("lng")) <= 4000).select("stop")


@query("g02_flat_distance", f"WITH {v.STOPS} SELECT stop, round({v.flat('lat', 'lng', '-9.45e0', '-35.65e0')}, 4) AS there, round({v.flat('-9.45e0', '-35.65e0', 'lat', 'lng')}, 4) AS back FROM stops")
def _(spark, sf):
    y, x = map(F.lit, _CENTRE)
    return v.stops(spark, sf).select("stop", F.round(flat_distance("lat", "lng", y, x), 4).alias("there"), F.round(flat_distance(y, x, "lat", "lng"), 4).alias("back"))


@query("g03_median", f"WITH {v.STOPS} SELECT route, median(lat) AS lat, median(number) AS number FROM stops GROUP BY route")
def _(spark, sf):
    return ranks.medians(v.stops(spark, sf), ["route"], ["lat", "number"]).drop("n")


@query("g04_segment_distance", f"WITH {v.VERTICES}, {_EDGES} SELECT seg, i, round({_segment_sql('-9.45e0', '-35.65e0')}, 4) AS metres FROM edges")
def _(spark, sf):
    y, x = map(F.lit, _CENTRE)
    return ops.edges_of(v.vertices(spark, sf)).select("seg", "i", F.round(geo.segment_distance(y, x, "lat1", "lng1", "lat2", "lng2"), 4).alias("metres"))


@query("g05_densified_lines", f"""WITH {v.VERTICES}, {_EDGES}, n AS (SELECT *, CAST(greatest(1, ceil({v.flat('lat1', 'lng1', 'lat2', 'lng2')} / 10)) AS BIGINT) AS n FROM edges)
SELECT seg, i, k, round(lat1 + (lat2 - lat1) * (k / n), 7) AS lat, round(lng1 + (lng2 - lng1) * (k / n), 7) AS lng FROM n, unnest(range(n + 1)) AS t(k)""")
def _(spark, sf):
    return ops.densified(v.vertices(spark, sf), 10.0).withColumns({"lat": F.round("lat", 7), "lng": F.round("lng", 7)})


@query("g06_ray_crossings", f"WITH {v.STOPS}, {v.AREAS} SELECT p.stop, {_INSIDE} AS inside FROM stops p JOIN areas a ON a.area = p.stop % 25")
def _(spark, sf):
    rings = _rings(spark, sf).select("area", "ring")
    p = v.stops(spark, sf).withColumn("area", (F.col("stop") % 25).cast("int")).join(rings, "area")
    return p.select("stop", (ops.crossings(F.col("ring"), F.col("lat"), F.col("lng")) % 2 == 1).alias("inside"))


@query("g07_nearest_vertex", f"""WITH {v.VERTICES}, d AS (SELECT seg, i, round({v.flat('-9.45e0', '-35.65e0', 'lat', 'lng')}, 4) AS metres FROM vertices)
SELECT seg, i, metres FROM (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY metres, i) AS r FROM d) WHERE r = 1""")
def _(spark, sf):
    far = F.round(flat_distance(*map(F.lit, _CENTRE), "lat", "lng"), 4)
    best = v.vertices(spark, sf).groupBy("seg").agg(F.min(F.struct(far.alias("metres"), "i")).alias("best"))
    return best.select("seg", "best.i", "best.metres")


_BOX = {"south": "lat - 2000 / 111320e0", "north": "lat + 2000 / 111320e0", "west": "lng - 2000 / (111320e0 * cos(radians(lat)))", "east": "lng + 2000 / (111320e0 * cos(radians(lat)))"}


@query("g08_box_of_a_radius", f"WITH {v.STOPS} SELECT stop, {', '.join(f'round({e}, 7) AS {n}' for n, e in _BOX.items())} FROM stops")
def _(spark, sf):
    return v.stops(spark, sf).selectExpr("stop", *(f"round({e}, 7) AS {n}" for n, e in _BOX.items()))


_GPS = ("(lat + (stop % 50) * 0.0008e0)", "(lng + (stop % 7) * 0.00003e0)")
_FAR = v.haversine_sql("lat", "lng", *_GPS)
_FLAGS = {
    "on_pin": f"{_FAR} <= 30",
    "far_from_door": f"{_FAR} > 3000 AND precision NOT IN ('rua', 'bairro')",
    "walk_m": f"CASE WHEN {_FAR} BETWEEN 10 AND 300 THEN CAST(round({_FAR} / 10) * 10 AS BIGINT) END",
}


@query("g09_gps_flags", f"WITH {v.STOPS} SELECT stop, {', '.join(f'{e} AS {n}' for n, e in _FLAGS.items())} FROM stops")
def _(spark, sf):
    return v.stops(spark, sf).selectExpr("stop", *(f"{e} AS {n}" for n, e in _FLAGS.items()))


@query("g10_approximate_matrix", f"""WITH {v.STOPS} SELECT a.route, a.stop, b.stop AS other, round({v.haversine_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')} * 1.35e0, 3) AS metres,
round({v.haversine_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')} * 1.35e0 / 7, 3) AS seconds FROM stops a JOIN stops b ON a.route = b.route AND a.carrier = b.carrier""")
def _(spark, sf):
    s = v.stops(spark, sf).select("route", "carrier", "stop", "lat", "lng")
    b = s.select("route", "carrier", F.col("stop").alias("other"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    metres = haversine("lat", "lng", "lat2", "lng2") * 1.35
    return s.join(b, ["route", "carrier"]).select("route", "stop", "other", F.round(metres, 3).alias("metres"), F.round(metres / 7, 3).alias("seconds"))


@query("g11_anchor_limit", f"""WITH {v.STOPS}, c AS (SELECT cep, median(lat) AS lat0, median(lng) AS lng0, count(*) AS n FROM stops GROUP BY cep),
f AS (SELECT cep, n, {v.haversine_sql('lat0', 'lng0', 'lat', 'lng')} AS far FROM stops JOIN c USING (cep)), r AS (SELECT cep, n, far, row_number() OVER (PARTITION BY cep ORDER BY far) AS place FROM f)
SELECT cep, round(greatest(3000, 2 * far), 3) AS limit_m FROM r WHERE place - 1 = least(n - 1, CAST(floor(n * 0.99) AS BIGINT))""")
def _(spark, sf):
    from ..operators.evidence import anchors_with_radius

    return anchors_with_radius(v.stops(spark, sf), "cep").select("cep", F.round(F.greatest(F.lit(3000.0), 2 * F.col("radius_m")), 3).alias("limit_m"))


@query("g12_path_cost", f"""WITH {v.STOPS}, l AS (SELECT *, lag(lat) OVER w AS lat0, lag(lng) OVER w AS lng0 FROM stops WINDOW w AS (PARTITION BY route ORDER BY seq, stop))
SELECT route, round(coalesce(sum({v.haversine_sql('lat0', 'lng0', 'lat', 'lng')}), 0), 3) AS metres, round(avg(lat), 6) AS c_lat, round(avg(lng), 6) AS c_lng FROM l GROUP BY route""")
def _(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("route").orderBy("seq", "stop")
    s = v.stops(spark, sf).withColumns({"lat0": F.lag("lat").over(w), "lng0": F.lag("lng").over(w)})
    legs = F.sum(haversine("lat0", "lng0", "lat", "lng"))
    return s.groupBy("route").agg(F.round(F.coalesce(legs, F.lit(0.0)), 3).alias("metres"), F.round(F.avg("lat"), 6).alias("c_lat"), F.round(F.avg("lng"), 6).alias("c_lng"))


@query("x01_plain_text_of_names", "SELECT DISTINCT n_name AS name, lower(strip_accents('São ' || n_name || ' Škoda Ýé')) AS plain FROM nation")
def _(spark, sf):
    said = F.concat(F.lit("São "), "name", F.lit(" Škoda Ýé"))
    return load(spark, sf, "nation").select(F.col("n_name").alias("name")).distinct().select("name", t.normal(said).alias("plain"))
