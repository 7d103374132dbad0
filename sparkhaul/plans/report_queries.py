"""Roll-ups for dashboards, reviews and audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.geo import haversine, within
from ..operators import evidence as ops
from ..operators import merging, ranks
from ..operators import relational as rel
from ..scratch import settled
from . import views as v
from .registry import registry

QUERIES, query = registry()

#: The moment at which day reports are made, and the threshold of an idle route in minutes.
_NOW, _IDLE = "TIMESTAMP '1998-08-15 12:00:00'", 60
_STATE = f"CASE WHEN packages > 0 AND delivered >= packages THEN 'finished' WHEN delivered = 0 THEN 'not started' WHEN idle_minutes >= {_IDLE} THEN 'stopped' ELSE 'on the road' END"
_CONFIRMED = "(stop % 3 = 0)"


def _by_route(spark, sf):
    """Per route: packages, delivered, stops, verified stops, last delivery and whole minutes since."""
    p = v.packages(spark, sf)
    ok = F.expr(_CONFIRMED)
    out = p.groupBy("route").agg(
        F.count("*").alias("packages"),
        F.count_if("delivered").alias("delivered"),
        F.countDistinct("stop").alias("addresses"),
        F.countDistinct(F.when(ok, F.col("stop"))).alias("verified"),
        F.max(F.when(F.col("delivered"), F.col("delivered_at"))).alias("last_at"),
    )
    return out.withColumn("idle_minutes", F.floor((F.unix_timestamp(F.expr(_NOW)) - F.unix_timestamp("last_at")) / 60))


_BY_ROUTE = f"""by_route AS (SELECT *, CAST(floor((epoch({_NOW}) - epoch(last_at)) / 60) AS BIGINT) AS idle_minutes FROM (
SELECT route, count(*) AS packages, count(*) FILTER (WHERE delivered) AS delivered, count(DISTINCT stop) AS addresses, count(DISTINCT stop) FILTER (WHERE {_CONFIRMED}) AS verified,
max(delivered_at) FILTER (WHERE delivered) AS last_at FROM packages GROUP BY route))"""


@query("a12_day_report", f"""WITH {v.PACKAGES}, {v.ROUTES}, {_BY_ROUTE} SELECT driver, route, packages, delivered, addresses, verified, {_STATE} AS state,
CASE WHEN {_STATE} = 'stopped' THEN idle_minutes ELSE 0 END AS idle_minutes FROM by_route JOIN routes USING (route)""")
def _(spark, sf):
    r = _by_route(spark, sf).join(v.routes(spark, sf), "route").withColumn("state", F.expr(_STATE))
    idle = F.when(F.col("state") == "stopped", F.col("idle_minutes")).otherwise(F.lit(0).cast("long"))
    return r.select("driver", "route", "packages", "delivered", "addresses", "verified", "state", idle.alias("idle_minutes"))


@query("a13_route_states", f"WITH {v.PACKAGES}, {_BY_ROUTE} SELECT {_STATE} AS state, count(*) AS routes FROM by_route GROUP BY 1")
def _(spark, sf):
    return _by_route(spark, sf).groupBy(F.expr(_STATE).alias("state")).agg(F.count("*").alias("routes"))


#: First names by driver, and the file name of a route's sheet: another month's date, another driver's name and copies among them.
_FIRST = "CASE {} % 8 WHEN 0 THEN 'ana' WHEN 1 THEN 'bruno' WHEN 2 THEN 'carla' WHEN 3 THEN 'jo' WHEN 4 THEN 'edu' WHEN 5 THEN 'fabio' WHEN 6 THEN 'gil' ELSE 'hugo' END"
_DATED = "CASE WHEN route % 10 = 3 THEN CAST(day + INTERVAL 1 MONTH AS DATE) ELSE day END"
_FILE = "lower(replace('Rota ' || {date} || ' lane ' || lane || ' ' || " + _FIRST.format("(CASE WHEN route % 3 = 0 THEN route ELSE driver END)") + " || ' (' || (route % 3) || ')', '(0)', ''))"
_BASE = "trim(regexp_replace(regexp_replace({}, '[(][0-9]+[)]', '', 'g'), ' +', ' ', 'g'))"


@query("a14_suspicious_routes", f"""WITH {v.ROUTES}, {v.PACKAGES}, f AS (SELECT r.*, CAST(day + to_days(CAST(route % 2 AS INTEGER)) AS DATE) AS today, {_FIRST.format('driver')} AS own, driver % 11 = 0 AS admin,
  {_FILE.format(date=f"strftime({_DATED}, '%d-%m-%Y')")} AS file FROM routes r), n AS (SELECT *, {_BASE.format('file')} AS base, regexp_split_to_array(file, '[^a-z]+') AS words FROM f),
names AS (SELECT DISTINCT own AS name FROM n WHERE length(own) > 2), others AS (SELECT DISTINCT route FROM n JOIN names ON name <> own AND list_contains(words, name) WHERE NOT list_contains(words, own)),
d AS (SELECT route, count(*) FILTER (WHERE delivered) AS delivered FROM packages GROUP BY route), g AS (SELECT base, min((day, route)) AS first, count(*) AS copies FROM n GROUP BY base),
s AS (SELECT n.route, CASE WHEN regexp_extract(file, '[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}') <> strftime(today, '%d-%m-%Y') THEN 'another day' WHEN NOT admin AND n.route IN (FROM others) THEN 'another driver'
  WHEN copies > 1 AND first <> (day, n.route) THEN 'repeated' END AS suspicion FROM n JOIN g USING (base) LEFT JOIN d ON d.route = n.route WHERE coalesce(delivered, 0) = 0)
SELECT route, suspicion FROM s WHERE suspicion IS NOT NULL""")
def _(spark, sf):
    r = v.routes(spark, sf).withColumns({"today": F.date_add("day", (F.col("route") % 2).cast("int")), "own": F.expr(_FIRST.format("driver")), "admin": F.col("driver") % 11 == 0})
    r = r.withColumn("file", F.expr(_FILE.format(date=f"date_format({_DATED}, 'dd-MM-yyyy')").replace("VARCHAR", "STRING")))
    r = r.withColumn("base", F.trim(F.regexp_replace(F.regexp_replace("file", r"[(][0-9]+[)]", ""), " +", " "))).withColumn("words", F.split("file", "[^a-z]+"))
    r = settled(r, "sheets")
    names = r.select(F.col("own").alias("name")).distinct().where("length(name) > 2")
    said = r.where(~F.array_contains("words", F.col("own"))).select("route", "own", F.explode(F.array_distinct("words")).alias("name"))
    others = said.join(names, "name").where("name <> own").select("route").distinct().withColumn("other", F.lit(True))
    d = v.packages(spark, sf).groupBy("route").agg(F.count_if("delivered").alias("delivered"))
    g = r.groupBy("base").agg(F.min(F.struct("day", "route")).alias("first"), F.count("*").alias("copies"))
    suspicion = (
        F.when(F.regexp_extract("file", "[0-9]{2}-[0-9]{2}-[0-9]{4}", 0) != F.date_format("today", "dd-MM-yyyy"), "another day")
        .when(~F.col("admin") & F.col("other"), "another driver")
        .when((F.col("copies") > 1) & (F.col("first") != F.struct("day", "route")), "repeated")
    )
    all_ = r.join(g, "base").join(d, "route", "left").join(others, "route", "left").where("coalesce(delivered, 0) = 0")
    return all_.select("route", suspicion.alias("suspicion")).where("suspicion IS NOT NULL")


_MARK = f"WITH {v.EVIDENCE}, marks AS (SELECT * FROM evidence WHERE active)"
_WHY = """CASE WHEN place IS NULL THEN 'no key' WHEN passages = 0 AND minutes_ago < 15 THEN 'going up' WHEN passages = 0 AND corrections > 0 THEN 'only a correction' WHEN passages = 0 THEN 'no mark'
WHEN would AND some_pending THEN 'to approve' WHEN some_refused THEN 'refused' WHEN would THEN 'not counted' WHEN corrections = 0 THEN 'far' ELSE 'do not agree' END"""


@query("a15_reasons_not_verified", f"""{_MARK}, spots AS (SELECT place, lat, lng, count(*) AS n FROM marks GROUP BY ALL),
pairs AS (SELECT a.place, bool_or(a.n > 1 OR a.lat <> b.lat OR a.lng <> b.lng) AS agree FROM spots a JOIN spots b ON a.place = b.place AND {v.haversine_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 30 GROUP BY a.place),
m AS (SELECT place, count(*) FILTER (WHERE NOT correction) AS passages, count(*) FILTER (WHERE correction) AS corrections, bool_or(pinned) AS pinned, bool_or(pending) AS some_pending, bool_or(refused AND NOT correction) AS some_refused FROM marks GROUP BY place),
d AS (SELECT CASE WHEN stop % 50 = 0 THEN NULL ELSE CAST(stop % 130 AS VARCHAR) END AS place, stop, count(*) AS packages, CAST(floor((epoch({_NOW}) - epoch(max(delivered_at))) / 60) AS BIGINT) AS minutes_ago
  FROM (SELECT l_suppkey * 3 + l_linenumber AS stop, l_shipdate AS delivered_at FROM lineitem WHERE l_linestatus = 'F') GROUP BY stop),
j AS (SELECT d.*, coalesce(passages, 0) AS passages, coalesce(corrections, 0) AS corrections, coalesce(pinned OR agree, false) AS would, coalesce(some_pending, false) AS some_pending, coalesce(some_refused, false) AS some_refused
  FROM d LEFT JOIN m USING (place) LEFT JOIN pairs USING (place))
SELECT stop, packages, {_WHY} AS reason FROM j""")
def _(spark, sf):
    marks = v.evidence(spark, sf).where("active")
    spots = marks.groupBy("place", "lat", "lng").agg(F.count("*").alias("n"))
    near = within(spots, spots.select("place", "lat", "lng"), 30.5, ["place"]).where(haversine("lat", "lng", "r_lat", "r_lng") <= 30)
    pairs = near.groupBy("place").agg(F.bool_or((F.col("n") > 1) | (F.col("lat") != F.col("r_lat")) | (F.col("lng") != F.col("r_lng"))).alias("agree"))
    m = marks.groupBy("place").agg(
        F.count_if(~F.col("correction")).alias("passages"),
        F.count_if("correction").alias("corrections"),
        F.bool_or("pinned").alias("pinned"),
        F.bool_or("pending").alias("some_pending"),
        F.bool_or(F.col("refused") & ~F.col("correction")).alias("some_refused"),
    )
    p = v.packages(spark, sf).where("delivered").selectExpr("stop * 3 + seq AS stop", "delivered_at")
    d = p.groupBy("stop").agg(F.count("*").alias("packages"), F.max("delivered_at").alias("last_at"))
    minutes = F.floor((F.unix_timestamp(F.expr(_NOW)) - F.unix_timestamp("last_at")) / 60)
    place = F.when(F.col("stop") % 50 != 0, (F.col("stop") % 130).cast("string"))
    j = d.withColumns({"place": place, "minutes_ago": minutes}).join(m, "place", "left").join(pairs, "place", "left").na.fill(0, ["passages", "corrections"]).na.fill(False, ["some_pending", "some_refused"])
    j = j.withColumn("would", F.coalesce(F.col("pinned") | F.col("agree"), F.lit(False)))
    return j.select("stop", "packages", F.expr(_WHY).alias("reason"))


@query("a17_my_doors", f"""WITH {v.PACKAGES}, {v.ROUTES} SELECT route, day, count(DISTINCT stop) AS doors, count(DISTINCT stop) FILTER (WHERE {_CONFIRMED}) AS verified
FROM packages JOIN routes USING (route) WHERE driver = 8 AND delivered GROUP BY ALL ORDER BY day DESC, route""")
def _(spark, sf):
    own = v.routes(spark, sf).where("driver = 8").select("route", "day")
    p = v.packages(spark, sf).where("delivered").join(own, "route")
    doors = p.groupBy("route", "day").agg(F.countDistinct("stop").alias("doors"), F.countDistinct(F.when(F.expr(_CONFIRMED), F.col("stop"))).alias("verified"))
    return doors.orderBy(F.col("day").desc(), "route")


@query("a18_usage_and_successors", f"""WITH {v.EVIDENCE}, l AS (SELECT driver, kind, day, lag(kind) OVER w AS before, epoch(happened) - epoch(lag(happened) OVER w) AS gap FROM evidence WINDOW w AS (PARTITION BY driver, day ORDER BY happened, id)),
b AS (SELECT before AS button, kind AS next, count(*) AS n FROM l WHERE gap <= 7200 GROUP BY ALL),
s AS (SELECT button, string_agg(next || ':' || n, ',' ORDER BY n DESC, next) AS successors FROM b GROUP BY button),
t AS (SELECT kind AS button, count(*) AS times, count(DISTINCT day) AS days, count(DISTINCT driver) AS drivers FROM evidence GROUP BY kind)
SELECT t.*, coalesce(successors, '') AS successors FROM t LEFT JOIN s USING (button)""")
def _(spark, sf):
    e, w = v.evidence(spark, sf), Window.partitionBy("driver", "day").orderBy("happened", "id")
    gap = (F.unix_micros("happened") - F.unix_micros(F.lag("happened").over(w))) / 1e6
    pairs = e.select(F.lag("kind").over(w).alias("button"), F.col("kind").alias("next"), gap.alias("gap")).where("gap <= 7200").groupBy("button", "next").agg(F.count("*").alias("n"))
    # one entry for each button, so the sorted lists are as short as there are buttons
    each = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "next"))), lambda x: F.concat(x["next"], F.lit(":"), (-x["m"]).cast("string")))
    after = pairs.groupBy("button").agg(F.array_join(each, ",").alias("successors"))
    totals = e.groupBy(F.col("kind").alias("button")).agg(F.count("*").alias("times"), F.countDistinct("day").alias("days"), F.countDistinct("driver").alias("drivers"))
    return totals.join(after, "button", "left").na.fill("", ["successors"])


#: Where searches end: the eight categories, by source.
_CATEGORY = "CASE WHEN lat IS NULL THEN 'no position' WHEN source = 'IBGE' THEN 'census' WHEN source = 'nossa base' THEN 'base' WHEN source IN ('CEP', 'entregas') THEN 'cep' WHEN source = 'OpenStreetMap' THEN 'osm' WHEN source IN ('minha correcao', 'outro motorista') THEN 'known' WHEN source = 'memoria do aparelho' THEN 'memory' ELSE 'other' END"
_SOURCE = "CASE stop % 11 WHEN 0 THEN 'IBGE' WHEN 1 THEN 'nossa base' WHEN 2 THEN 'CEP' WHEN 3 THEN 'entregas' WHEN 4 THEN 'OpenStreetMap' WHEN 5 THEN 'minha correcao' WHEN 6 THEN 'outro motorista' WHEN 7 THEN 'memoria do aparelho' WHEN 8 THEN 'LocationIQ' ELSE 'planilha' END"
_KINDS = ("memory", "census", "base", "cep", "osm", "known", "no position", "other")


def _searches(spark, sf):
    s = v.stops(spark, sf).selectExpr("driver", "number", "stop", f"{_SOURCE} AS source", "CASE WHEN stop % 17 = 0 THEN NULL ELSE lat END AS lat", "lng", "lat + (stop % 9) * 0.0001e0 AS found_lat")
    return s.withColumn("category", F.expr(_CATEGORY))


_SEARCHES = f"searches AS (SELECT *, {_CATEGORY} AS category FROM (SELECT driver, number, stop, {_SOURCE} AS source, CASE WHEN stop % 17 = 0 THEN NULL ELSE lat END AS lat, lng, lat + (stop % 9) * 0.0001e0 AS found_lat FROM stops))"
_ENDED = {k: f"ended_{k.replace(' ', '_')}" for k in _KINDS}


@query("a19_search_roll_up", f"""WITH {v.STOPS}, {_SEARCHES} SELECT driver, {', '.join(f"count(*) FILTER (WHERE category = '{k}') AS {n}" for k, n in _ENDED.items())},
CAST(sum(least(greatest(CASE WHEN category = 'known' THEN number - 100 ELSE 0 END, 0), 250)) AS BIGINT) AS known_ms, count(*) FILTER (WHERE category = 'known' AND {v.haversine_sql('found_lat', 'lng', 'lat', 'lng')} >= 30) AS known_far FROM searches GROUP BY driver""")
def _(spark, sf):
    s = _searches(spark, sf)
    known = F.col("category") == "known"
    cost = F.least(F.greatest(F.when(known, F.col("number") - 100).otherwise(0), F.lit(0)), F.lit(250))
    far = known & (haversine("found_lat", "lng", "lat", "lng") >= 30)
    ended = (F.count_if(F.col("category") == k).alias(n) for k, n in _ENDED.items())
    return s.groupBy("driver").agg(*ended, F.sum(cost).alias("known_ms"), F.count_if(far).alias("known_far"))


@query("f15_source_categories", f"WITH {v.STOPS}, {_SEARCHES} SELECT category, source, count(*) AS n FROM searches GROUP BY ALL")
def _(spark, sf):
    return _searches(spark, sf).groupBy("category", "source").agg(F.count("*").alias("n"))


@query("a20_triage_with_news", f"""WITH {v.EVIDENCE}, c AS (SELECT *, row_number() OVER (PARTITION BY place, driver ORDER BY happened DESC, id DESC) AS r, count(*) OVER (PARTITION BY place, driver) AS repeats FROM evidence WHERE correction),
t AS (SELECT max(day) AS today, max(happened) - INTERVAL 6 HOUR AS seen FROM evidence)
SELECT place, driver, repeats, CASE WHEN pending THEN 'decide' WHEN day > today - 7 THEN 'recent' ELSE 'other' END AS bucket, happened > seen AS is_new FROM c, t WHERE r = 1""")
def _(spark, sf):
    e = v.evidence(spark, sf)
    newest = e.where("correction").groupBy("place", "driver").agg(F.max_by(F.struct("pending", "day", "happened"), F.struct("happened", "id")).alias("last"), F.count("*").alias("repeats"))
    now = e.agg(F.max("day").alias("today"), (F.max("happened") - F.expr("INTERVAL 6 HOURS")).alias("seen"))
    bucket = F.when(F.col("last.pending"), "decide").when(F.col("last.day") > F.date_sub("today", 7), "recent").otherwise("other")
    return newest.crossJoin(F.broadcast(now)).select("place", "driver", "repeats", bucket.alias("bucket"), (F.col("last.happened") > F.col("seen")).alias("is_new"))  # one row


@query("a21_review_groups", f"""WITH {v.EVIDENCE}, p AS (SELECT driver, place, id, happened, kind = 'error' AS disputed, pinned, CASE WHEN id % 5 <> 0 THEN value END AS from_pin FROM evidence WHERE pending)
SELECT driver, CASE WHEN disputed THEN 'disputed' WHEN pinned THEN 'on the pin' ELSE 'moves' END AS bucket, id, row_number() OVER (PARTITION BY driver, CASE WHEN disputed THEN 2 WHEN pinned THEN 1 ELSE 0 END
  ORDER BY CASE WHEN disputed OR pinned THEN 0 ELSE coalesce(from_pin, 1e18) END DESC, happened DESC, id) AS place_in_list FROM p""")
def _(spark, sf):
    p = v.evidence(spark, sf).where("pending").withColumns({"disputed": F.col("kind") == "error", "from_pin": F.when(F.col("id") % 5 != 0, F.col("value"))})
    bucket = F.when(F.col("disputed"), "disputed").when(F.col("pinned"), "on the pin").otherwise("moves")
    risk = F.when(F.col("disputed") | F.col("pinned"), F.lit(0.0)).otherwise(F.coalesce("from_pin", F.lit(1e18)))
    p = p.withColumns({"bucket": bucket, "risk": risk})
    w = Window.partitionBy("driver", "bucket").orderBy(F.col("risk").desc(), F.col("happened").desc(), "id")
    return p.select("driver", "bucket", "id", F.row_number().over(w).cast("long").alias("place_in_list"))


_LANES = f"{v.STOPS}, m AS (SELECT route AS lane, district || ' ' || CAST(floor((lng + 35.7e0) * 12) AS BIGINT) || CASE WHEN stop % 9 = 0 THEN ' far' ELSE '' END AS district, lat + CASE WHEN stop % 9 = 0 THEN 0.08e0 ELSE 0 END AS lat, lng FROM stops)"
_AUDIT = f"""centres AS (SELECT district, median(lat) AS lat, median(lng) AS lng FROM m GROUP BY district), n AS (SELECT lane, district, count(*) AS n FROM m GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY lane) AS share FROM n), core AS (SELECT lane, district, n FROM s WHERE share >= 0.1),
far AS (SELECT s.lane, s.district, s.n, min({v.haversine_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')}) AS metres FROM s JOIN centres a USING (district) JOIN core c ON c.lane = s.lane JOIN centres b ON b.district = c.district
  WHERE s.share < 0.1 AND s.n <= 3 GROUP BY ALL), suspects AS (SELECT lane, district, n, CAST(round(metres) AS BIGINT) AS metres FROM far WHERE metres > 5000)"""


def _manifest(spark, sf):
    far = "CASE WHEN stop % 9 = 0 THEN 0.08e0 ELSE 0 END"
    district = "district || ' ' || CAST(floor((lng + 35.7e0) * 12) AS BIGINT) || CASE WHEN stop % 9 = 0 THEN ' far' ELSE '' END AS district"
    return v.stops(spark, sf).selectExpr("route AS lane", district, f"lat + {far} AS lat", "lng")


def _suspects(spark, sf):
    """Lanes' core districts (a share of 0.1) and suspects: districts of a lane with three packages at most, over 5 km from its core."""
    m = _manifest(spark, sf)
    centres = m.groupBy("district").agg(F.median("lat").alias("lat"), F.median("lng").alias("lng"))
    n = m.groupBy("lane", "district").agg(F.count("*").alias("n"))
    shares = n.withColumn("share", rel.share_of_group(n, "lane", "n")).join(centres, "district")
    core = shares.where("share >= 0.1").select("lane", F.col("district").alias("home"), F.col("n").alias("home_n"), F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))
    pairs = shares.where("share < 0.1 AND n <= 3").join(core, "lane")
    far = pairs.groupBy("lane", "district", "n").agg(F.min(haversine("lat", "lng", "c_lat", "c_lng")).alias("metres")).where("metres > 5000")
    return core, far.select("lane", "district", "n", F.round("metres").cast("long").alias("metres"))


@query("a22_manifest_suspects", f"WITH {_LANES}, {_AUDIT} SELECT * FROM suspects")
def _(spark, sf):
    return _suspects(spark, sf)[1]


@query("a44_lane_view", f"""WITH {_LANES}, {_AUDIT}, homes AS (SELECT district, lane AS home FROM core)
SELECT lane, district, n, metres, 'here' AS side FROM suspects WHERE lane = 20 UNION ALL SELECT s.lane, s.district, s.n, s.metres, 'elsewhere' FROM suspects s JOIN homes h ON h.district = s.district AND h.home = 20 WHERE s.lane <> 20""")
def _(spark, sf):
    core, s = _suspects(spark, sf)
    home = core.where("lane = 20").select(F.col("home").alias("district"))
    return s.where("lane = 20").withColumn("side", F.lit("here")).unionByName(s.where("lane <> 20").join(home, "district", "left_semi").withColumn("side", F.lit("elsewhere")))


@query("x28_suspect_lines", f"""WITH {_LANES}, {_AUDIT} SELECT lane || ': ' || n || ' package(s) of ' || district || ', ' || CAST(round(metres / 1000) AS BIGINT) || ' km from the lane' AS line FROM suspects""")
def _(spark, sf):
    s = _suspects(spark, sf)[1]
    km = F.round(F.col("metres") / 1000).cast("long").cast("string")
    return s.select(F.concat(F.col("lane").cast("string"), F.lit(": "), F.col("n").cast("string"), F.lit(" package(s) of "), "district", F.lit(", "), km, F.lit(" km from the lane")).alias("line"))


@query("a23_district_centres", f"""WITH RECURSIVE {v.STOPS}, c AS (SELECT district, carrier % 30 AS id, median(lat) AS lat, median(lng) AS lng FROM stops GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY id) AS r FROM c),
{merging.first_fit_sql('p', 'district', 3000, v.haversine_sql('h.lat', 'h.lng', 'lat', 'lng'))} SELECT f.district, head AS city, count(*) AS cities, round(any_value(c.lat), 7) AS lat, round(any_value(c.lng), 7) AS lng FROM fitted f JOIN c ON c.district = f.district AND c.id = head GROUP BY f.district, head""")
def _(spark, sf):
    """The median of a district's doors in each city that has the name; what lies within 3 km of an earlier city's is the same district."""
    c = ranks.medians(v.stops(spark, sf).withColumn("city", F.col("carrier") % 30), ["district", "city"], ["lat", "lng"])
    c = settled(c.select("district", "city", "lat", "lng"), "centres")
    heads = merging.first_fit(c, ["district"], "city", [], 3000.0).groupBy("district", F.col("head").alias("city")).agg(F.count("*").alias("cities"))
    return heads.join(c, ["district", "city"]).select("district", "city", "cities", F.round("lat", 7).alias("lat"), F.round("lng", 7).alias("lng"))


@query("a24_district_anchors", f"""WITH {v.STOPS}, c AS (SELECT district, median(lat) AS lat, median(lng) AS lng, count(*) AS doors FROM stops GROUP BY district),
f AS (SELECT s.district, {v.haversine_sql('c.lat', 'c.lng', 's.lat', 's.lng')} AS far FROM stops s JOIN c USING (district)),
r AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY far) AS r, count(*) OVER (PARTITION BY district) AS n FROM f)
SELECT c.district, round(c.lat, 7) AS lat, round(c.lng, 7) AS lng, c.doors, round(far, 3) AS radius_m FROM c JOIN r USING (district) WHERE r.r = CAST(floor(n * 0.99) AS BIGINT) + 1""")
def _(spark, sf):
    return ops.anchors_with_radius(v.stops(spark, sf), "district").withColumns({c: F.round(c, k) for c, k in (("lat", 7), ("lng", 7), ("radius_m", 3))})


@query("a25_census_with_district", f"""WITH {v.STOPS} SELECT cep, number % 20 AS number, avg(lat) AS lat, avg(lng) AS lng, count(*) AS units, count(*) >= 3 AS building, arg_min(district, stop) AS district, arg_min(street, stop) AS street FROM stops GROUP BY ALL""")
def _(spark, sf):
    s = v.stops(spark, sf).withColumn("number", F.col("number") % 20)
    first = (F.min_by(c, "stop").alias(c) for c in ("district", "street"))
    return s.groupBy("cep", "number").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.count("*").alias("units"), (F.count("*") >= 3).alias("building"), *first)


@query("a27_same_point_many_districts", f"""WITH {v.STOPS}, p AS (SELECT CASE WHEN stop % 4 = 0 THEN -9.45e0 + (stop % 3) * 0.01e0 ELSE lat END AS lat, CASE WHEN stop % 4 = 0 THEN -35.65e0 ELSE lng END AS lng, lower(district) AS district, stop FROM stops WHERE NOT delivered AND precision = 'planilha' OR stop % 4 = 0),
g AS (SELECT lat, lng FROM p GROUP BY ALL HAVING count(DISTINCT district) >= 3) SELECT p.stop FROM p JOIN g USING (lat, lng)""")
def _(spark, sf):
    p = v.stops(spark, sf).where("NOT delivered AND precision = 'planilha' OR stop % 4 = 0").selectExpr(
        "CASE WHEN stop % 4 = 0 THEN -9.45e0 + (stop % 3) * 0.01e0 ELSE lat END AS lat", "CASE WHEN stop % 4 = 0 THEN -35.65e0 ELSE lng END AS lng", "lower(district) AS district", "stop")
    g = p.groupBy("lat", "lng").agg(F.countDistinct("district").alias("n")).where("n >= 3")
    return p.join(g, ["lat", "lng"], "left_semi").select("stop")


_SPREAD = "lat + CASE WHEN stop % 23 = 0 THEN 0.4e0 WHEN stop % 29 = 0 THEN 0.9e0 ELSE 0 END"


#: Routes of any size, which grow with the stops: 60 in all.
_ROUTE = "c_custkey % 60"
_ROUTED = v.STOPS.replace("CAST(floor(c_custkey / 60) AS BIGINT) AS route", f"{_ROUTE} AS route")


@query("a28_isolated_stops", f"""WITH {_ROUTED}, s AS (SELECT route, stop, district, precision, {_SPREAD} AS lat, lng FROM stops WHERE NOT delivered), c AS (SELECT route, median(lat) AS lat0, median(lng) AS lng0, count(*) AS n FROM s GROUP BY route),
f AS (SELECT s.*, {v.haversine_sql('lat', 'lng', 'lat0', 'lng0')} AS far, n FROM s JOIN c USING (route)), l AS (SELECT route, greatest(7000, 4 * median(far)) AS limit_m FROM f GROUP BY route),
k AS (SELECT a.stop, count(*) - 1 AS neighbours FROM s a JOIN s b ON a.route = b.route AND {v.haversine_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 2000 GROUP BY a.stop)
SELECT route, stop, round(far, 2) AS far_m FROM f JOIN l USING (route) JOIN k USING (stop) WHERE n >= 4 AND far > limit_m AND neighbours < 2 AND precision NOT IN ('manual', 'confirmado')""")
def _(spark, sf):
    s = v.stops(spark, sf).where("NOT delivered").selectExpr(f"{_ROUTE.replace('c_custkey', 'stop')} AS route", "stop", "district", "precision", f"{_SPREAD} AS lat", "lng")
    return ops.isolated_stops(s).where("precision NOT IN ('manual', 'confirmado')").select("route", "stop", F.round("far", 2).alias("far_m"))


@query("a28_far_from_district", f"""WITH {_ROUTED}, s AS (SELECT route, stop, district, {_SPREAD} AS lat, lng FROM stops WHERE NOT delivered),
o AS (SELECT a.route, a.stop, count(*) AS others, median(b.lat) AS m_lat, median(b.lng) AS m_lng FROM s a JOIN s b ON a.route = b.route AND a.district = b.district AND a.stop <> b.stop GROUP BY ALL),
t AS (SELECT o.stop, median({v.haversine_sql('b.lat', 'b.lng', 'm_lat', 'm_lng')}) AS spread FROM o JOIN s a ON a.stop = o.stop JOIN s b ON a.route = b.route AND a.district = b.district AND a.stop <> b.stop GROUP BY o.stop)
SELECT s.stop, others FROM s JOIN o ON o.stop = s.stop JOIN t ON t.stop = s.stop WHERE others >= 3 AND spread <= 6000 AND {v.haversine_sql('lat', 'lng', 'm_lat', 'm_lng')} > 5000""")
def _(spark, sf):
    s = v.stops(spark, sf).where("NOT delivered").selectExpr(f"{_ROUTE.replace('c_custkey', 'stop')} AS route", "stop", "district", f"{_SPREAD} AS lat", "lng")
    return ops.far_from_others(s, ["route", "district"]).select("stop", "others")


@query("a32_service_seconds", f"""WITH {v.EVIDENCE}, g AS (SELECT driver, epoch(happened) - epoch(lag(happened) OVER w) - {v.haversine_sql('lag(lat) OVER w', 'lag(lng) OVER w', 'lat', 'lng')} * 1.35e0 / 7 AS gap FROM evidence WINDOW w AS (PARTITION BY driver, day ORDER BY happened, id)),
k AS (SELECT driver, list_sort(list(CAST(floor(gap) AS BIGINT))) AS gaps FROM g WHERE gap >= 20 AND gap <= 1800 GROUP BY driver)
SELECT d.driver, CASE WHEN len(gaps) >= 3 THEN gaps[len(gaps) // 2 + 1] ELSE 180 END AS seconds FROM (SELECT DISTINCT driver FROM evidence) d LEFT JOIN k USING (driver)""")
def _(spark, sf):
    e, w = v.evidence(spark, sf), Window.partitionBy("driver", "day").orderBy("happened", "id")
    since = (F.unix_micros("happened") - F.unix_micros(F.lag("happened").over(w))) / 1e6
    drive = haversine(F.lag("lat").over(w), F.lag("lng").over(w), "lat", "lng") * 1.35 / 7
    gaps = e.select("driver", (since - drive).alias("gap")).where("gap BETWEEN 20 AND 1800").withColumn("gap", F.floor("gap"))
    return e.select("driver").distinct().join(ops.upper_median(gaps, "driver", "gap", 3), "driver", "left").select("driver", F.coalesce("value", F.lit(180)).cast("long").alias("seconds"))


@query("a35_groups_that_fit", f"""WITH {v.STOPS}, g AS (SELECT *, street || ' ' || CAST(floor(lat * 100) AS BIGINT) || ' ' || CAST(floor(lng * 100) AS BIGINT) AS grp FROM stops), c AS (SELECT grp, avg(lat) AS c_lat, avg(lng) AS c_lng, count(*) AS n FROM g GROUP BY grp)
SELECT grp, n, round(any_value(c_lat), 6) AS lat, round(any_value(c_lng), 6) AS lng, bool_and({v.haversine_sql('c_lat', 'c_lng', 'lat', 'lng')} <= 800) AS together FROM g JOIN c USING (grp) GROUP BY grp, n""")
def _(spark, sf):
    g = v.stops(spark, sf).withColumn("grp", F.expr("street || ' ' || CAST(floor(lat * 100) AS BIGINT) || ' ' || CAST(floor(lng * 100) AS BIGINT)"))
    c = g.groupBy("grp").agg(F.avg("lat").alias("c_lat"), F.avg("lng").alias("c_lng"), F.count("*").alias("n"))
    fit = g.join(c, "grp").groupBy("grp", "n", "c_lat", "c_lng").agg(F.bool_and(haversine("c_lat", "c_lng", "lat", "lng") <= 800).alias("together"))
    return fit.select("grp", "n", F.round("c_lat", 6).alias("lat"), F.round("c_lng", 6).alias("lng"), "together")


@query("a36_verified_today", f"WITH {v.STOPS} SELECT route, count(*) FILTER (WHERE precision = 'confirmado' OR stop % 7 = 0) AS verified, count(*) AS total FROM stops GROUP BY route")
def _(spark, sf):
    ok = F.expr("precision = 'confirmado' OR stop % 7 = 0")
    return v.stops(spark, sf).groupBy("route").agg(F.count_if(ok).alias("verified"), F.count("*").alias("total"))


@query("a38_import_outcome", f"""WITH {v.STOPS}, lines AS (SELECT route, lower(street) || '|' || (number % 60) || '|' || cep AS key, stop, stop % 10 = 3 AS there FROM stops), old AS (SELECT DISTINCT key FROM lines WHERE there),
g AS (SELECT route, key, count(*) AS packages, min(stop) AS first_stop FROM lines WHERE NOT there GROUP BY ALL)
SELECT route, count(*) FILTER (WHERE old.key IS NULL) AS added, CAST(sum(packages - 1) FILTER (WHERE old.key IS NULL) AS BIGINT) AS merged, CAST(coalesce(sum(packages) FILTER (WHERE old.key IS NOT NULL), 0) AS BIGINT) AS repeated
FROM g LEFT JOIN old USING (key) GROUP BY route HAVING count(*) FILTER (WHERE old.key IS NULL) > 0""")
def _(spark, sf):
    lines = v.stops(spark, sf).selectExpr("route", "lower(street) || '|' || (number % 60) || '|' || cep AS key", "stop", "stop % 10 = 3 AS there")
    old = lines.where("there").select("key", F.lit(True).alias("known")).distinct()
    g = lines.where("NOT there").groupBy("route", "key").agg(F.count("*").alias("packages")).join(old, "key", "left")
    new = F.col("known").isNull()
    out = g.groupBy("route").agg(F.count_if(new).alias("added"), F.sum(F.when(new, F.col("packages") - 1)).alias("merged"), F.coalesce(F.sum(F.when(~new, F.col("packages"))), F.lit(0).cast("long")).alias("repeated"))
    return out.where("added > 0")


@query("a40_reasons_by_period", f"""WITH {v.EVIDENCE}, c AS ({v.consensus_sql('(' + v.standing() + ')')}), e AS (SELECT DISTINCT driver, day, place FROM evidence WHERE NOT correction)
SELECT driver, count(*) AS doors, count(*) FILTER (WHERE status = 'confirmed') AS verified, count(*) FILTER (WHERE status IS NULL) AS unknown FROM e LEFT JOIN c USING (place) WHERE day >= DATE '2024-01-10' GROUP BY driver""")
def _(spark, sf):
    e = v.evidence(spark, sf)
    c = ops.consensus(ops.standing_marks(e)).select("place", "status")
    doors = e.where("NOT correction AND day >= DATE '2024-01-10'").select("driver", "day", "place").distinct().join(c, "place", "left")
    return doors.groupBy("driver").agg(F.count("*").alias("doors"), F.count_if(F.col("status") == "confirmed").alias("verified"), F.count_if(F.col("status").isNull()).alias("unknown"))


@query("a41_names_filled_back", f"""WITH {v.EVIDENCE}, k AS (SELECT place, arg_max(kind, (happened, id)) FILTER (WHERE correction AND pending) AS a, arg_max(kind, (happened, id)) FILTER (WHERE correction) AS b, arg_max(kind, (happened, id)) FILTER (WHERE NOT correction) AS c FROM evidence GROUP BY place)
SELECT place, coalesce(a, b, c) AS name FROM k""")
def _(spark, sf):
    by, cases = F.struct("happened", "id"), (F.expr("correction AND pending"), F.col("correction"), ~F.col("correction"))
    names = (F.max_by(F.when(c, F.col("kind")), F.when(c, by)) for c in cases)
    return v.evidence(spark, sf).groupBy("place").agg(F.coalesce(*names).alias("name"))


@query("a42_place_search", f"""WITH {v.EVIDENCE}, c AS ({v.consensus_sql('(' + v.standing() + ')')}), keys AS (SELECT place FROM evidence WHERE kind = 'error' AND value > 50 UNION SELECT place FROM evidence WHERE kind = 'signup' AND value > 60 UNION SELECT place FROM evidence WHERE place LIKE '4%')
SELECT place, status, n_corrections, n_passages FROM keys JOIN c USING (place)""")
def _(spark, sf):
    e = v.evidence(spark, sf)
    keys = e.where("kind = 'error' AND value > 50 OR kind = 'signup' AND value > 60 OR place LIKE '4%'").select("place")
    return ops.consensus(ops.standing_marks(e.join(keys.distinct(), "place", "left_semi"))).select("place", "status", "n_corrections", "n_passages")


@query("a43_stops_by_address", f"WITH {v.STOPS} SELECT route, lower(street) || '|' || (number % 40) AS address, count(*) AS stops, CAST(sum(units) AS BIGINT) AS packages FROM stops GROUP BY ALL")
def _(spark, sf):
    return v.stops(spark, sf).groupBy("route", F.expr("lower(street) || '|' || (number % 40)").alias("address")).agg(F.count("*").alias("stops"), F.sum("units").alias("packages"))


@query("a45_route_day", f"""WITH {v.PACKAGES}, {v.ROUTES}, d AS (SELECT route, max(CAST(delivered_at - INTERVAL 3 HOUR AS DATE)) FILTER (WHERE delivered) AS last_day FROM packages GROUP BY route)
SELECT route, greatest(day, coalesce(last_day, day)) AS day FROM routes LEFT JOIN d USING (route)""")
def _(spark, sf):
    d = v.packages(spark, sf).where("delivered").groupBy("route").agg(F.max(v.local_day("delivered_at")).alias("last_day"))
    return v.routes(spark, sf).join(d, "route", "left").select("route", F.greatest("day", F.coalesce("last_day", "day")).alias("day"))


@query("a46_unit_disagreement", f"""WITH {v.STOPS}, u AS (SELECT district, regexp_extract(lower(extra), '(apto|bloco|casa) *0*([0-9a-z]+)', 1) AS unit, regexp_extract(lower(extra), '(apto|bloco|casa) *0*([0-9a-z]+)', 2) AS value FROM stops WHERE extra <> '')
SELECT district, unit, count(DISTINCT value) AS readings FROM u WHERE unit <> '' GROUP BY ALL HAVING count(DISTINCT value) > 1""")
def _(spark, sf):
    unit = lambda k: F.regexp_extract(F.lower("extra"), "(apto|bloco|casa) *0*([0-9a-z]+)", k)
    u = v.stops(spark, sf).select("district", unit(1).alias("unit"), unit(2).alias("value")).where("unit <> ''")
    return u.groupBy("district", "unit").agg(F.countDistinct("value").alias("readings")).where("readings > 1")


@query("a47_registered_packages", f"WITH {v.STOPS} SELECT route, stop, k AS package, CASE WHEN precision = 'bairro' THEN NULL ELSE round(lat + 1e-8, 5) END AS lat FROM stops, unnest(range(units)) AS t(k)")
def _(spark, sf):
    s = v.stops(spark, sf).withColumn("package", F.explode(F.sequence(F.lit(0).cast("long"), F.col("units") - 1)))
    return s.select("route", "stop", "package", F.when(F.col("precision") != "bairro", F.round(F.col("lat") + 1e-8, 5)).alias("lat"))


@query("a48_package_rows", f"WITH {v.PACKAGES} SELECT route, count(*) AS items, count(DISTINCT stop) AS stops, min(seq) AS first_seq, string_agg(CAST(item AS VARCHAR), ',' ORDER BY seq, item) AS items_in_order FROM packages GROUP BY route")
def _(spark, sf):
    items = F.transform(F.array_sort(F.collect_list(F.struct("seq", "item"))), lambda x: x["item"].cast("string"))  # a route has a few items
    return v.packages(spark, sf).groupBy("route").agg(F.count("*").alias("items"), F.countDistinct("stop").alias("stops"), F.min("seq").alias("first_seq"), F.array_join(items, ",").alias("items_in_order"))


@query("a06_coverage_scalars", f"""WITH {v.SEGMENTS}, {v.EVIDENCE}, p AS (SELECT place, count(DISTINCT (driver, day)) AS n FROM evidence GROUP BY place)
SELECT (SELECT count(DISTINCT name_key) FROM segments) AS names, (SELECT count(*) FROM segments WHERE name_key IS NULL) AS unnamed, (SELECT count(*) FROM segments WHERE source = 'entregas') AS own,
(SELECT count(*) FROM p) AS places, (SELECT count(*) FROM p WHERE n >= 2) AS seen_twice""")
def _(spark, sf):
    s = v.segments(spark, sf).agg(F.countDistinct("name_key").alias("names"), F.count_if(F.col("name_key").isNull()).alias("unnamed"), F.count_if(F.col("source") == "entregas").alias("own"))
    p = v.evidence(spark, sf).groupBy("place").agg(F.countDistinct(F.struct("driver", "day")).alias("n")).agg(F.count("*").alias("places"), F.count_if(F.col("n") >= 2).alias("seen_twice"))
    return s.crossJoin(p)  # one row each


@query("a11_review_work_list", f"""WITH {v.EVIDENCE.replace("AS place,", "|| '-' || event_id % 40 AS place,", 1)}, mine AS (SELECT DISTINCT driver AS who, place FROM evidence WHERE pending),
seen AS (SELECT m.who, e.* REPLACE (m.who || '/' || e.place AS place, CASE WHEN e.driver = m.who THEN false ELSE e.pending END AS pending), e.pending AS held FROM mine m JOIN evidence e ON e.place = m.place),
s1 AS (SELECT * EXCLUDE (who, held) FROM seen WHERE NOT held), s2 AS (SELECT * EXCLUDE (who, held) FROM seen), m1 AS ({v.standing(None, 's1')}), m2 AS ({v.standing(None, 's2')}),
before AS ({v.consensus_sql('m1')}), after AS ({v.consensus_sql('m2')})
SELECT place, a.status, b.status AS status_before, round(a.lat, 6) AS lat, round(a.lng, 6) AS lng FROM after a LEFT JOIN before b USING (place)
WHERE b.status IS NULL OR a.status IS DISTINCT FROM b.status OR {v.flat('a.lat', 'a.lng', 'b.lat', 'b.lng')} > 1""")
def _(spark, sf):
    e = v.evidence(spark, sf).withColumn("place", F.concat("place", F.lit("-"), (F.col("id") % 40).cast("string")))
    return ops.review_list(e).select("place", "status", "status_before", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))
