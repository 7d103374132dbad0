"""Queries over the evidence log, postal doors and drivers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evidence as ops
from ..operators import relational as rel
from . import views as v

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


@query("a01_evidence_consensus", f"WITH {v.EVIDENCE}, marks AS ({v.standing()}) {v.consensus_sql('marks')}")
def _(spark, sf):
    return ops.consensus(ops.standing_marks(v.evidence(spark, sf)))


@query("j12_what_if_pending", f"""WITH {v.EVIDENCE}, doors AS (SELECT * REPLACE (place || '-' || id % 40 AS place) FROM evidence), m1 AS ({v.standing(None, 'doors')}), m2 AS ({v.standing(8, 'doors')}), now AS ({v.consensus_sql('m1')}), later AS ({v.consensus_sql('m2')})
SELECT later.place, now.status, later.status AS then_status, later.lat AS then_lat, later.lng AS then_lng FROM later LEFT JOIN now USING (place)
WHERE now.status IS NULL OR now.status IS DISTINCT FROM later.status OR {v.flat('now.lat', 'now.lng', 'later.lat', 'later.lng')} > 1""")
def _(spark, sf):
    return ops.what_if(v.evidence(spark, sf).withColumn("place", F.concat("place", F.lit("-"), F.col("id") % 40)), 8)


@query("a02_postal_anchors", f"""WITH {v.DOORS}, c AS (SELECT cep, quantile_cont(lat, 0.5) AS lat0, quantile_cont(lng, 0.5) AS lng0 FROM doors GROUP BY cep)
SELECT cep, lat0 AS lat, lng0 AS lng, greatest(60.0, least(1500.0, quantile_disc({v.flat('lat0', 'lng0', 'lat', 'lng')}, 0.9))) AS radius_m, count(*) AS doors FROM doors JOIN c USING (cep) GROUP BY ALL""")
def _(spark, sf):
    return ops.postal_anchors(v.doors(spark, sf))


@query("a03_named_places", f"""WITH {v.EVIDENCE}, s AS (SELECT place, lat, lng, max(happened) AS happened, max(id) AS id FROM evidence WHERE NOT correction GROUP BY ALL),
n AS (SELECT s.*, count(DISTINCT (e.driver, e.day)) AS seen FROM s JOIN evidence e ON NOT e.correction AND s.place = e.place AND {v.flat('s.lat', 's.lng', 'e.lat', 'e.lng')} <= 120 GROUP BY ALL)
SELECT place, lat, lng, seen FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY seen DESC, happened DESC, id DESC) AS r FROM n WHERE seen >= 2) WHERE r = 1""")
def _(spark, sf):
    return ops.named_places(v.evidence(spark, sf).where("NOT correction"))


@query("a04_day_accuracy", f"""WITH {v.EVIDENCE} SELECT driver, kind, count(*) AS marks, count(*) FILTER (WHERE value >= 1) AS measured,
quantile_disc(value, 0.5) FILTER (WHERE value >= 1) AS median_error, max(value) AS worst_error FROM evidence GROUP BY ALL""")
def _(spark, sf):
    median = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value) FILTER (WHERE value >= 1)")
    return v.evidence(spark, sf).groupBy("driver", "kind").agg(F.count("*").alias("marks"), F.count_if(F.col("value") >= 1).alias("measured"), median.alias("median_error"), F.max("value").alias("worst_error"))


@query("a06_coverage", f"""WITH {v.EVIDENCE}, p AS (SELECT place, count(DISTINCT (driver, day)) AS n FROM evidence GROUP BY place)
SELECT (SELECT count(*) FROM p) AS places, (SELECT count(*) FROM p WHERE n >= 2) AS seen_twice, (SELECT count(DISTINCT driver) FROM evidence) AS drivers, (SELECT count(*) FROM evidence WHERE pinned) AS pinned""")
def _(spark, sf):
    e = v.evidence(spark, sf)
    days = e.groupBy("place").agg(F.countDistinct(F.struct("driver", "day")).alias("n")).agg(F.count("*").alias("places"), F.count_if(F.col("n") >= 2).alias("seen_twice"))
    return days.crossJoin(e.agg(F.countDistinct("driver").alias("drivers"), F.count_if("pinned").alias("pinned")))  # one row each


@query("a09_complaints", f"WITH {v.EVIDENCE} SELECT place, kind AS reason, max(happened) AS last_at, bool_or(driver = 8) AS mine FROM evidence WHERE kind IN ('error', 'view') GROUP BY ALL")
def _(spark, sf):
    return v.evidence(spark, sf).where("kind IN ('error', 'view')").groupBy("place", F.col("kind").alias("reason")).agg(F.max(F.col("happened").cast("timestamp_ntz")).alias("last_at"), F.bool_or(F.col("driver") == 8).alias("mine"))


@query("a10_commercial_flags", f"WITH {v.EVIDENCE} SELECT place, bool_or(driver = 8) AS mine, bool_or(driver <> 8) AS others FROM evidence WHERE pinned GROUP BY place")
def _(spark, sf):
    return v.evidence(spark, sf).where("pinned").groupBy("place").agg(F.bool_or(F.col("driver") == 8).alias("mine"), F.bool_or(F.col("driver") != 8).alias("others"))


_REASONS = "CASE WHEN NOT active THEN 'inactive' WHEN refused THEN 'refused' WHEN pending THEN 'pending' WHEN others = 0 THEN 'alone' WHEN NOT pinned THEN 'not on the pin' ELSE 'other' END"


@query("a15_why_not_verified", f"""WITH {v.EVIDENCE}, n AS (SELECT place, count(DISTINCT driver) - 1 AS others FROM evidence GROUP BY place)
SELECT driver, {_REASONS} AS reason, count(*) AS n FROM evidence JOIN n USING (place) WHERE NOT correction GROUP BY ALL""")
def _(spark, sf):
    e = v.evidence(spark, sf)
    others = e.groupBy("place").agg((F.countDistinct("driver") - 1).alias("others"))
    return e.where("NOT correction").join(others, "place").withColumn("reason", F.expr(_REASONS)).groupBy("driver", "reason").agg(F.count("*").alias("n"))


@query("a16_verified_ratio", f"""WITH {v.EVIDENCE} SELECT driver, count(*) AS marks, count(*) FILTER (WHERE pinned) AS verified, count(*) FILTER (WHERE pinned) / count(*) AS ratio FROM evidence WHERE active GROUP BY driver""")
def _(spark, sf):
    out = v.evidence(spark, sf).where("active").groupBy("driver").agg(F.count("*").alias("marks"), F.count_if("pinned").alias("verified"))
    return out.withColumn("ratio", F.col("verified") / F.col("marks")).orderBy("ratio", "driver")


@query("a18_button_usage", f"""WITH {v.EVIDENCE}, p AS (SELECT *, lag(kind) OVER w AS before, lag(happened) OVER w AS before_at FROM evidence WINDOW w AS (PARTITION BY driver, day ORDER BY happened, id))
SELECT coalesce(CASE WHEN date_diff('second', before_at, happened) <= 120 THEN before END, '') AS before, kind AS button, count(*) AS times, count(DISTINCT day) AS days FROM p GROUP BY ALL""")
def _(spark, sf):
    w = Window.partitionBy("driver", "day").orderBy("happened", "id")
    seconds = F.unix_timestamp("happened") - F.unix_timestamp(F.lag("happened").over(w))
    pairs = v.evidence(spark, sf).select("day", F.coalesce(F.when(seconds <= 120, F.lag("kind").over(w)), F.lit("")).alias("before"), F.col("kind").alias("button"))
    return pairs.groupBy("before", "button").agg(F.count("*").alias("times"), F.countDistinct("day").alias("days"))


@query("a19_search_telemetry", f"""WITH {v.EVIDENCE} SELECT day, count(*) AS searches, CAST(sum(least(greatest(CAST(round_even(value, 0) AS BIGINT), 0), 100)) AS BIGINT) AS cost,
count(*) FILTER (WHERE kind = 'error') AS failed, count(*) FILTER (WHERE value >= 30) AS far FROM evidence GROUP BY day""")
def _(spark, sf):
    cost = F.least(F.greatest(F.rint("value").cast("long"), F.lit(0)), F.lit(100))
    return v.evidence(spark, sf).groupBy("day").agg(F.count("*").alias("searches"), F.sum(cost).alias("cost"), F.count_if(F.col("kind") == "error").alias("failed"), F.count_if(F.col("value") >= 30).alias("far"))


@query("a20_correction_triage", f"""WITH {v.EVIDENCE}, c AS (SELECT *, row_number() OVER (PARTITION BY place, driver ORDER BY happened DESC, id DESC) AS r, count(*) OVER (PARTITION BY place, driver) AS repeats FROM evidence WHERE correction)
SELECT place, driver, repeats, CASE WHEN pending THEN 'decide' WHEN day >= DATE '2024-01-20' THEN 'recent' ELSE 'other' END AS bucket FROM c WHERE r = 1""")
def _(spark, sf):
    c = v.evidence(spark, sf).where("correction")
    newest = c.groupBy("place", "driver").agg(F.max_by(F.struct("pending", "day"), F.struct("happened", "id")).alias("last"), F.count("*").alias("repeats"))
    bucket = F.when(F.col("last.pending"), "decide").when(F.col("last.day") >= F.lit("2024-01-20").cast("date"), "recent").otherwise("other")
    return newest.select("place", "driver", "repeats", bucket.alias("bucket"))


@query("j13_latest_text", f"""WITH {v.EVIDENCE} SELECT place, coalesce(arg_max(kind, (happened, id)) FILTER (WHERE correction), arg_max(kind, (happened, id))) AS latest FROM evidence GROUP BY place""")
def _(spark, sf):
    by = F.struct("happened", "id")
    return v.evidence(spark, sf).groupBy("place").agg(F.coalesce(F.max_by(F.when(F.col("correction"), F.col("kind")), F.when(F.col("correction"), by)), F.max_by("kind", by)).alias("latest"))


@query("st03_counter_snapshots", f"""WITH {v.EVIDENCE}, n AS (SELECT driver, day, kind, count(*) AS times FROM evidence GROUP BY ALL) SELECT driver, day, kind, max(times) AS times FROM (SELECT * FROM n UNION ALL SELECT driver, day, kind, times - 1 FROM n) GROUP BY ALL""")
def _(spark, sf):
    n = v.evidence(spark, sf).groupBy("driver", "day", "kind").agg(F.count("*").alias("times"))
    return rel.merge_greatest(n, n.withColumn("times", F.col("times") - 1), ["driver", "day", "kind"], ["times"])


@query("st08_daily_cap", f"WITH {v.EVIDENCE} SELECT driver, day, id FROM (SELECT *, row_number() OVER (PARTITION BY driver, day ORDER BY happened, id) AS r FROM evidence) WHERE r <= 3")
def _(spark, sf):
    w = Window.partitionBy("driver", "day").orderBy("happened", "id")
    return v.evidence(spark, sf).withColumn("r", F.row_number().over(w)).where("r <= 3").select("driver", "day", "id")


@query("f09_domain_checks", f"WITH {v.EVIDENCE} SELECT count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS rejected FROM (SELECT lat BETWEEN -90 AND 90 AND length(place) BETWEEN 2 AND 300 AND value BETWEEN 0 AND 100 AS ok FROM evidence)")
def _(spark, sf):
    ok = F.expr("lat BETWEEN -90 AND 90 AND length(place) BETWEEN 2 AND 300 AND value BETWEEN 0 AND 100")
    return v.evidence(spark, sf).agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("rejected"))
