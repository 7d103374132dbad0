"""Queries that run as streams over the events, with the SQL of their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as ops
from ..streaming import rules
from . import views as v
from .registry import registry

QUERIES, query = registry()

_EVENT = "event_id AS id, user_id AS driver, event_type AS kind, ts, value, regexp_extract(props, '([0-9]+)', 1) AS place"
_EVENTS = f"e AS (SELECT {_EVENT}, CAST(ts - INTERVAL 3 HOUR AS DATE) AS day FROM events)"


def _events(spark, sf):
    return rules.event_stream(spark, sf).selectExpr(*_EVENT.split(", ", 5)[:5], "regexp_extract(props, '([0-9]+)', 1) AS place").withColumn("day", v.local_day("ts"))


@query("st01_replayed_queue", f"WITH {_EVENTS} SELECT driver, count(DISTINCT id) AS n FROM e GROUP BY driver")
def _(spark, sf):
    e = _events(spark, sf).select("id", "driver", "ts").withWatermark("ts", "30 days")
    twice = e.union(e)  # what is sent again arrives again
    return rules.written(twice.dropDuplicatesWithinWatermark(["id"]), "queue").groupBy("driver").agg(F.count("*").alias("n"))


@query("st03_stream_counters", f"WITH {_EVENTS}, n AS (SELECT driver, day, kind, id % 5 AS times FROM e) SELECT driver, day, kind, max(times) AS times FROM n GROUP BY ALL")
def _(spark, sf):
    n = _events(spark, sf).select("driver", "day", "kind", (F.col("id") % 5).alias("times"))
    merged = rules.written(n.groupBy("driver", "day", "kind").agg(F.max("times").alias("times")), "counters", "update")
    return merged.groupBy("driver", "day", "kind").agg(F.max("times").alias("times"))


_TODAY = "DATE '2024-02-03'"


_SENT = "id - id % 25 AS request"


@query("st04_days_in_bounds", f"WITH {_EVENTS}, b AS (SELECT *, {_SENT}, bool_or(day NOT BETWEEN {_TODAY} - 30 AND {_TODAY} + 1) OVER (PARTITION BY id - id % 25) AS bad FROM e) SELECT request, id FROM b WHERE NOT bad")
def _(spark, sf):
    sizes = v.evidence(spark, sf).groupBy(F.expr(_SENT)).agg(F.count("*").alias("size"))  # what the senders say
    sent = _events(spark, sf).selectExpr(_SENT, "id", f"NOT (day BETWEEN date_sub({_TODAY}, 30) AND date_add({_TODAY}, 1)) AS bad")
    return rules.written(rules.whole_or_not(sent.join(sizes, "request"), ["request"], "request long, id long"), "bounds")


def _quiet(key: str, starts: str, ends: str, seconds: int) -> str:
    """Rows that start, without an end within the time, told once the last row is an hour beyond the deadline."""
    return f"""WITH {_EVENTS}, k AS (SELECT *, epoch_us(ts) AS us, {starts} AS starts, {ends} AS ends FROM e), n AS (SELECT (max(us) // 1000) * 1000 - 3600000000 AS now FROM k)
SELECT a.{key}, a.id FROM k a, n WHERE a.starts AND a.us + {seconds}000000 < now AND NOT EXISTS (SELECT 1 FROM k b WHERE b.{key} = a.{key} AND b.ends AND (b.us, b.id) > (a.us, a.id) AND b.us - a.us <= {seconds}000000)"""


def _told(spark, sf, key: str, starts: str, ends: str, seconds: int, name: str):
    e = _events(spark, sf).selectExpr(key, "id", "ts", f"{starts} AS starts", f"{ends} AS ends")
    kind = "string" if key == "place" else "long"
    return rules.written(rules.unfollowed(e, [key], f"{key} {kind}, id long", seconds), name)


@query("st05_held_then_sent", _quiet("driver", "kind = 'click'", "kind = 'error'", 36000))
def _(spark, sf):
    return _told(spark, sf, "driver", "kind = 'click'", "kind = 'error'", 36000, "held")


@query("st06_latest_wish", f"WITH {_EVENTS} SELECT driver, place, arg_max(kind, (ts, id)) AS wish FROM e GROUP BY ALL")
def _(spark, sf):
    e = _events(spark, sf)
    last = rules.written(e.groupBy("driver", "place").agg(F.max(F.struct("ts", "id", "kind")).alias("last")), "wishes", "update")
    return last.groupBy("driver", "place").agg(F.max("last").alias("last")).select("driver", "place", F.col("last.kind").alias("wish"))


@query("st07_undone_operations", f"WITH {_EVENTS}, n AS (SELECT *, lead(kind) OVER (PARTITION BY driver ORDER BY ts, id) AS after, lag(kind) OVER (PARTITION BY driver ORDER BY ts, id) AS before FROM e) SELECT driver, id, kind FROM n WHERE NOT (kind = 'error') AND after = 'error'")
def _(spark, sf):
    pairs = rules.per_key(_events(spark, sf).select("driver", "id", "ts", "kind"), ["driver"], "driver long, id long, kind string, undoes long, undone string", "id long, kind string", _undo, (-1, ""))
    return rules.written(pairs.where("kind = 'error' AND undone <> 'error' AND undone <> ''"), "undone").selectExpr("driver", "undoes AS id", "undone AS kind")


def _undo(rows, state):
    """Every row with the row before it of the same key."""
    last, kind, out = state[0], state[1], []
    for ident, k in zip(rows.id, rows.kind, strict=True):
        out.append((ident, k, last, kind))
        last, kind = int(ident), k
    return out, (int(last), str(kind))


@query("st08_rolling_cap", f"""WITH RECURSIVE {_EVENTS}, o AS (SELECT driver, id, epoch_us(ts) / 1e6 AS tm, row_number() OVER (PARTITION BY driver ORDER BY ts, id) AS r FROM e),
s AS (SELECT driver, id, r, true AS taken, [tm] AS accepted FROM o WHERE r = 1
UNION ALL SELECT o.driver, o.id, o.r, len(list_filter(s.accepted, lambda x: x > o.tm - 864000)) < 5, CASE WHEN len(list_filter(s.accepted, lambda x: x > o.tm - 864000)) < 5
  THEN list_append(list_filter(s.accepted, lambda x: x > o.tm - 864000), o.tm) ELSE s.accepted END FROM s JOIN o ON o.driver = s.driver AND o.r = s.r + 1)
SELECT driver, id FROM s WHERE taken""")
def _(spark, sf):
    e = _events(spark, sf).select("driver", "id", "ts")
    return rules.written(rules.per_key(e, ["driver"], "driver long, id long", "accepted array<double>", rules.rolling_cap(5, 864_000.0), ([],)), "cap")


@query("st09_time_to_live", "SELECT event_id AS id FROM events WHERE ts >= TIMESTAMP '2024-04-20 00:00:00' - INTERVAL 90 DAY")
def _(spark, sf):
    return rules.written(_events(spark, sf).where("ts >= TIMESTAMP '2024-04-20 00:00:00' - INTERVAL 90 DAYS").select("id"), "ttl")


@query("st09_expired_places", _quiet("place", "true", "true", 86400))
def _(spark, sf):
    """The last word on a place that had no newer one for a day."""
    return _told(spark, sf, "place", "true", "true", 86400, "expired")


@query("st10_click_pairs", f"WITH {_EVENTS}, l AS (SELECT id, kind, lag(kind) OVER w AS before, epoch_ms(ts) - epoch_ms(lag(ts) OVER w) AS gap FROM e WINDOW w AS (PARTITION BY driver, day ORDER BY ts, id)) SELECT kind, CASE WHEN gap <= 7200000 THEN before ELSE '' END AS before, count(*) AS n FROM l GROUP BY ALL")
def _(spark, sf):
    e = _events(spark, sf).select("driver", "day", "id", "ts", "kind")
    gap = v.epoch_ms("ts") - v.epoch_ms("ts_before")
    pairs = rules.with_row_before(e, ["driver", "day"], "pairs").withColumn("before", F.when(gap <= 7_200_000, F.col("kind_before")).otherwise(""))
    return pairs.groupBy("kind", "before").agg(F.count("*").alias("n"))


@query("st11_followed_positions", f"""WITH RECURSIVE {_EVENTS}, o AS (SELECT driver, id, epoch_us(ts) / 1e6 AS tm, value * 4000 AS x, CAST(id % 7 AS DOUBLE) * 3000 AS y, row_number() OVER (PARTITION BY driver ORDER BY ts, id) AS r FROM e),
s AS (SELECT driver, id, r, 'moves' AS what, x, y, tm, x AS sx, y AS sy, -1e0 AS suspected FROM o WHERE r = 1
UNION ALL SELECT driver, id, r, what, CASE WHEN what = 'moves' THEN nx ELSE x END, CASE WHEN what = 'moves' THEN ny ELSE y END, CASE WHEN what = 'moves' THEN now ELSE tm END,
  CASE WHEN what = 'waits' AND suspected <> now THEN nx ELSE sx END, CASE WHEN what = 'waits' AND suspected <> now THEN ny ELSE sy END, CASE WHEN what = 'waits' THEN now ELSE -1e0 END
  FROM (SELECT o.driver, o.id, o.r, s.x, s.y, s.tm, s.sx, s.sy, s.suspected, o.x AS nx, o.y AS ny, o.tm AS now,
    CASE WHEN sqrt(pow(o.x - s.x, 2) + pow(o.y - s.y, 2)) < 5 THEN 'stays' WHEN sqrt(pow(o.x - s.x, 2) + pow(o.y - s.y, 2)) / greatest(o.tm - s.tm, 1) <= 50 THEN 'moves'
    WHEN s.suspected >= 0 AND o.tm > s.suspected AND sqrt(pow(o.x - s.sx, 2) + pow(o.y - s.sy, 2)) / greatest(o.tm - s.suspected, 1) <= 50 THEN 'moves' ELSE 'waits' END AS what FROM s JOIN o ON o.driver = s.driver AND o.r = s.r + 1))
SELECT driver, id, what FROM s""")
def _(spark, sf):
    e = _events(spark, sf).selectExpr("driver", "id", "ts", "value * 4000 AS x", "CAST(id % 7 AS DOUBLE) * 3000 AS y")
    moves = rules.per_key(e, ["driver"], "driver long, id long, what string", "x double, y double, at double, sx double, sy double, suspected double", rules.follow(), (0.0, 0.0, -1.0, 0.0, 0.0, -1.0))
    return rules.written(moves, "followed")


@query("st12_proximity_alerts", f"""WITH RECURSIVE {_EVENTS}, o AS (SELECT driver, id, value * 2 AS metres, row_number() OVER (PARTITION BY driver ORDER BY ts, id) AS r FROM e),
s AS (SELECT driver, id, r, metres <= 40 AS fired, CASE WHEN metres <= 40 THEN false ELSE true END AS armed FROM o WHERE r = 1
UNION ALL SELECT o.driver, o.id, o.r, s.armed AND o.metres <= 40, CASE WHEN s.armed AND o.metres <= 40 THEN false WHEN NOT s.armed AND o.metres > 100 THEN true ELSE s.armed END FROM s JOIN o ON o.driver = s.driver AND o.r = s.r + 1)
SELECT driver, id FROM s WHERE fired""")
def _(spark, sf):
    e = _events(spark, sf).selectExpr("driver", "id", "ts", "value * 2 AS metres")
    return rules.written(rules.per_key(e, ["driver"], "driver long, id long", "armed boolean", rules.alerts(), (True,)), "alerts")


@query("st13_idle_drivers", f"WITH {_EVENTS} SELECT driver, epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(max(ts)) >= 86400 AS idle FROM e GROUP BY driver")
def _(spark, sf):
    last = rules.written(_events(spark, sf).groupBy("driver").agg(F.max("ts").alias("last")), "idle", "update").groupBy("driver").agg(F.max("last").alias("last"))
    return last.select("driver", (F.unix_micros(F.expr("TIMESTAMP '2024-02-01 00:00:00'")) - F.unix_micros("last") >= 86_400_000_000).alias("idle"))


@query("st13_idle_alerts", _quiet("driver", "true", "true", 86400))
def _(spark, sf):
    """Each time a driver is still for a day: told when the day is over, not when the driver comes back."""
    return _told(spark, sf, "driver", "true", "true", 86400, "idle-alerts")


@query("st14_disputes_on_arrival", f"""WITH {v.EVIDENCE}, m AS ({v.standing(None, '(SELECT * FROM evidence WHERE id % 2 = 0)')}), c AS ({v.consensus_sql('m')})
SELECT e.id FROM evidence e JOIN c USING (place) WHERE e.id % 2 = 1 AND c.status = 'confirmed' AND {v.flat('c.lat', 'c.lng', 'e.lat', 'e.lng')} > 30""")
def _(spark, sf):
    from ..functions.geo import flat_distance

    known = v.evidence(spark, sf).where("id % 2 = 0")
    doors = ops.consensus(ops.standing_marks(known)).where("status = 'confirmed'").select("place", F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))
    new = _events(spark, sf).where("id % 2 = 1").selectExpr("id", "place", "floor(value) / 10000 - 10.9e0 AS lat", "(id % 3) / 10000 - 37.05e0 AS lng")
    return rules.written(new.join(doors, "place").where(flat_distance("c_lat", "c_lng", "lat", "lng") > 30).select("id"), "disputes")


@query("st15_verified_latch", f"WITH {_EVENTS} SELECT place, bool_or(kind = 'purchase' AND value > 90) AS verified FROM e GROUP BY place")
def _(spark, sf):
    seen = _events(spark, sf).groupBy("place").agg(F.max(F.expr("kind = 'purchase' AND value > 90")).alias("verified"))
    return rules.written(seen, "latch", "update").groupBy("place").agg(F.max("verified").alias("verified"))


@query("st16_generation_guard", f"WITH {_EVENTS}, g AS (SELECT driver, max(id % 4) AS now FROM e WHERE kind = 'signup' GROUP BY driver) SELECT e.id FROM e JOIN g USING (driver) WHERE e.kind <> 'signup' AND e.id % 4 = g.now")
def _(spark, sf):
    now = v.evidence(spark, sf).where("kind = 'signup'").groupBy("driver").agg(F.max(F.col("id") % 4).alias("now"))
    answers = _events(spark, sf).where("kind <> 'signup'").select("id", "driver", (F.col("id") % 4).alias("generation"))
    return rules.written(answers.join(now, "driver").where("generation = now").select("id"), "guard")


@query("st17_measured_calls", f"WITH {_EVENTS} SELECT place, kind, count(*) AS calls, CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) AS ms FROM e GROUP BY ALL")
def _(spark, sf):
    e = _events(spark, sf).groupBy("place", "kind").agg(F.count("*").alias("calls"), F.sum(F.floor(F.col("value") * 1000)).alias("ms"))
    last = rules.written(e, "calls", "complete")
    return last.groupBy("place", "kind").agg(F.max("calls").alias("calls"), F.max("ms").alias("ms"))
