"""Evidence consensus: many noisy marks of a place become one trusted position with a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import flat_distance, haversine, within
from ..scratch import settled
from . import ranks
from .relational import first_per_key

#: Metres within which marks support each other.
NEAR_M = 30.0


def standing_marks(evidence: DataFrame, include_driver: int | None = None) -> DataFrame:
    """Latest correction per place and driver, and latest passage per place, driver and day, of active drivers.

    evidence: id, place, driver, happened, day, correction, admin, pinned, pending, refused, active, lat, lng. Pending marks count
    only if they are include_driver's.
    """
    shown = ~F.col("pending") if include_driver is None else (~F.col("pending") | (F.col("driver") == include_driver))
    used = evidence.where(F.col("active") & shown)
    newest = (F.col("happened").desc(), F.col("id").desc())
    corrections = first_per_key(used.where("correction"), ["place", "driver"], *newest).withColumn("pinned", F.lit(False))
    passages = first_per_key(used.where("NOT correction AND NOT refused"), ["place", "driver", "day"], *newest).withColumn("admin", F.lit(False))
    return corrections.unionByName(passages)


def consensus(marks: DataFrame) -> DataFrame:
    """place, lat, lng, status, source, n_corrections, n_passages: the best supported mark of each place.

    Marks are counted per exact position first, and positions are paired within a grid, so a place with very many marks is
    neither one task nor a square.
    """
    spots = marks.groupBy("place", "lat", "lng").agg(*(F.count_if(c).alias(n) for n, c in (("nc", F.col("correction")), ("np", ~F.col("correction")), ("npp", F.col("pinned")))))
    support = within(spots.select("place", "lat", "lng"), spots, NEAR_M, ["place"]).groupBy("place", "lat", "lng").agg(*(F.sum(f"r_{n}").alias(n) for n in ("nc", "np", "npp")))
    best = first_per_key(marks, ["place", "lat", "lng"], F.col("admin").desc(), F.col("correction").desc(), F.col("happened").desc(), F.col("id").desc())
    sure = F.col("admin") | (F.col("nc") >= 2) | ((F.col("nc") >= 1) & (F.col("np") >= 1)) | (F.col("np") >= 2) | (F.col("npp") >= 1)
    rated = best.join(support, ["place", "lat", "lng"]).withColumn("sure", sure)
    winner = first_per_key(rated, ["place"], F.col("admin").desc(), F.col("sure").desc(), (F.col("nc") * 2 + F.col("np")).desc(), F.col("correction").desc(), F.col("happened").desc(), F.col("id").desc())
    status = F.when(F.col("sure"), "confirmed").when(F.col("correction"), "suggested")
    source = F.when(F.col("admin"), "admin").when(F.col("nc") > 0, "correction").otherwise("delivery")
    return winner.select("place", "lat", "lng", status.alias("status"), source.alias("source"), F.col("nc").alias("n_corrections"), F.col("np").alias("n_passages")).where("status IS NOT NULL")


def what_if(evidence: DataFrame, driver: int) -> DataFrame:
    """Places whose consensus changes if a driver's pending marks counted: new, another status, or moved by over a metre."""
    now, then = consensus(standing_marks(evidence)), consensus(standing_marks(evidence, driver))
    then = then.select("place", *(F.col(c).alias(f"then_{c}") for c in ("lat", "lng", "status")))
    both = then.join(now.select("place", "lat", "lng", "status"), "place", "left")
    moved = flat_distance("lat", "lng", "then_lat", "then_lng") > 1
    return both.where(F.col("status").isNull() | ~F.col("status").eqNullSafe(F.col("then_status")) | moved).select("place", "status", "then_status", "then_lat", "then_lng")


def named_places(sightings: DataFrame, metres: float = 120.0, least: int = 2) -> DataFrame:
    """place, lat, lng, seen: the sighting of each place that most driver-days share within a distance; places with enough of them."""
    distinct = settled(sightings.groupBy("place", "lat", "lng", "driver", "day").agg(F.max("happened").alias("happened"), F.max("id").alias("id")), "sightings")
    spots = distinct.groupBy("place", "lat", "lng").agg(F.max("happened").alias("happened"), F.max("id").alias("id"))
    spots = settled(spots.withColumn("i", F.row_number().over(Window.partitionBy("place").orderBy("lng", "lat"))), "spots")
    # the spots around a position, as runs of numbers that follow each other; no driver or day is paired with spots
    near = within(spots.select("place", "lat", "lng", "i"), spots.select("place", "lat", "lng"), metres, ["place"]).select("place", F.col("r_lat").alias("lat"), F.col("r_lng").alias("lng"), "i")
    at = ["place", "lat", "lng"]
    run = F.col("i") - F.row_number().over(Window.partitionBy(*at).orderBy("i"))
    runs = settled(near.withColumn("run", run).groupBy(*at, "run").agg(F.min("i").alias("start"), F.max("i").alias("end")).drop("run"), "runs")
    # of each driver-day the spots it is near to, once: what of a run lies behind the runs before it
    mine = distinct.select(*at, "driver", "day").join(runs, at).groupBy("place", "driver", "day", "start").agg(F.max("end").alias("end"))
    before = F.max("end").over(Window.partitionBy("place", "driver", "day").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    own = mine.withColumn("start", F.greatest(F.col("start"), before + 1)).where("start <= end")
    steps = own.select("place", F.explode(F.array(F.struct(F.col("start").alias("i"), F.lit(1).alias("more")), F.struct((F.col("end") + 1).alias("i"), F.lit(-1).alias("more")))).alias("s"))
    steps = steps.select("place", "s.*").groupBy("place", "i").agg(F.sum("more").alias("more"))
    counted = F.sum(F.coalesce("more", F.lit(0))).over(Window.partitionBy("place").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    seen = spots.join(steps, ["place", "i"], "left").withColumn("seen", counted).where(F.col("seen") >= least)
    return first_per_key(seen, ["place"], F.col("seen").desc(), F.col("happened").desc(), F.col("id").desc()).select("place", "lat", "lng", "seen")


def postal_anchors(doors: DataFrame, least_m: float = 60.0, most_m: float = 1500.0) -> DataFrame:
    """cep, lat, lng (medians by component), radius_m (90th percentile of the distances, clamped), doors."""
    centres = settled(ranks.medians(doors, ["cep"], ["lat", "lng"]).withColumnsRenamed({"lat": "c_lat", "lng": "c_lng", "n": "doors"}), "centres")
    far = ranks.beside(doors, centres, ["cep"]).withColumn("far", flat_distance("c_lat", "c_lng", "lat", "lng"))
    radius = ranks.value_at(far, ["cep"], "far", F.ceil(F.col("n") * 0.9) - 1)
    out = centres.join(radius, "cep")
    return out.select("cep", F.col("c_lat").alias("lat"), F.col("c_lng").alias("lng"), F.greatest(F.lit(least_m), F.least(F.lit(most_m), F.col("far"))).alias("radius_m"), "doors")


def stop_outliers(stops: DataFrame, least_m: float = 7000.0, times: float = 4.0) -> DataFrame:
    """Stops of a route farther from its median centre than max(least_m, times x the median distance)."""
    centre = ranks.medians(stops, ["route"], ["lat", "lng"]).select("route", F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))
    far = settled(ranks.beside(stops, centre, ["route"]).withColumn("far", F.round(flat_distance("c_lat", "c_lng", "lat", "lng"), 3)), "far")
    limit = ranks.medians(far, ["route"], ["far"]).select("route", F.greatest(F.lit(least_m), times * F.col("far")).alias("limit_m"))
    return ranks.beside(far, limit, ["route"]).where("far > limit_m").select("route", "stop", F.col("far").alias("far_m"), "limit_m")


def review_list(evidence: DataFrame) -> DataFrame:
    """place (driver/place), status, lat, lng, status_before: what the consensus of a place would be if a driver's pending marks counted.

    Only places with pending marks of the driver, whose consensus is new, has another status or moves by over a metre. All drivers at
    once, and no place is read again for each of them: its positions are rated once without pending marks. A driver's marks there are
    taken out and put in again, which changes the positions around them only; those are rated anew, and the best of them meets the best
    position that is left as it was.
    """
    at, counts = ["place", "lat", "lng"], ("nc", "np", "npp")
    kinds = dict(zip(counts, (F.col("correction"), ~F.col("correction"), F.col("pinned")), strict=True))
    value = F.struct("admin", "correction", "happened", "id")
    rank = F.struct("mark.admin", _sure().alias("sure"), (F.col("nc") * 2 + F.col("np")).alias("weight"), "mark.correction", "mark.happened", "mark.id", "lat", "lng", "nc", "np")
    mine = evidence.where("pending").select("driver", "place").distinct()
    standing = settled(standing_marks(evidence.where("NOT pending")), "standing")
    then = standing_marks(evidence.join(mine, ["driver", "place"], "left_semi").withColumn("pending", F.lit(False)))

    # where a driver's marks of a place change: how many more of each kind, and the best of the driver's own there
    own = standing.join(mine, ["driver", "place"], "left_semi").withColumn("sign", F.lit(-1)).unionByName(then.withColumn("sign", F.lit(1)))
    more = (F.sum(F.when(c, F.col("sign")).otherwise(0)).alias(n) for n, c in kinds.items())
    both = own.groupBy("driver", *at).agg(*more, F.max(F.when(F.col("sign") > 0, value)).alias("mark"), F.max(F.when(F.col("sign") < 0, value)).alias("was"))
    changed = both.where("nc <> 0 OR np <> 0 OR npp <> 0 OR NOT mark <=> was").drop("was").withColumnRenamed("driver", "who")
    changed = settled(changed, "changed")

    # of a position the marks of all, the best one, and the best one of another driver
    drivers = standing.groupBy(*at, "driver").agg(*(F.count_if(c).alias(n) for n, c in kinds.items()), F.max(value).alias("mark"))
    spots = drivers.groupBy(*at).agg(*(F.sum(n).alias(n) for n in counts))
    two = drivers.withColumn("r", F.row_number().over(Window.partitionBy(*at).orderBy(F.col("mark").desc()))).where("r <= 2")
    two = two.groupBy(*at).agg(F.max(F.when(F.col("r") == 1, F.col("mark"))).alias("mark"), F.max(F.when(F.col("r") == 1, F.col("driver"))).alias("of"), F.max(F.when(F.col("r") == 2, F.col("mark"))).alias("second"))
    places = spots.select(*at).unionByName(changed.where("mark IS NOT NULL").select(*at)).distinct()
    support = within(places, spots, NEAR_M, ["place"]).groupBy(*at).agg(*(F.sum(f"r_{n}").alias(n) for n in counts))
    rated = places.join(support, at, "left").fillna(0, list(counts)).join(two, at, "left").withColumn("rank", rank)
    order = Window.partitionBy("place").orderBy(F.col("rank").desc())
    rated = settled(rated.withColumn("r", F.when(F.col("mark").isNotNull(), F.row_number().over(order.partitionBy("place", F.col("mark").isNull())))), "rated")
    before = rated.where("r = 1").select("place", F.col("rank").alias("b"))

    near = within(rated.select(*at), changed.select("who", *at, *counts), NEAR_M, ["place"])
    near = near.groupBy(F.col("r_who").alias("who"), *at).agg(*(F.sum(f"r_{n}").alias(f"more_{n}") for n in counts))
    own = changed.select("who", *at, F.col("mark").alias("own"), F.lit(True).alias("touched"))
    anew = near.join(rated.drop("rank"), at).join(own, ["who", *at], "left")
    others = F.when(F.col("of") == F.col("who"), F.col("second")).otherwise(F.col("mark"))
    anew = anew.withColumns({**{n: F.col(n) + F.col(f"more_{n}") for n in counts}, "mark": F.when(F.col("touched"), F.greatest("own", others)).otherwise(F.col("mark"))})
    best = anew.groupBy("who", "place").agg(F.max(F.when(F.col("mark").isNotNull(), rank)).alias("best"), F.collect_list("r").alias("rs"))  # positions around the driver's own
    # the first rank that is left as it was: the ranks of n positions miss one of the first n + 1
    best = best.withColumn("r", F.array_min(F.array_except(F.sequence(F.lit(1), F.size("rs") + 1), F.col("rs"))))
    left = best.drop("rs").join(rated.where("r IS NOT NULL").select("place", "r", "rank"), ["place", "r"], "left")
    after = left.select("who", "place", F.greatest("best", "rank").alias("a")).where("a IS NOT NULL").join(before, "place", "left")

    status = lambda c: F.when(F.col(f"{c}.sure"), "confirmed").when(F.col(f"{c}.correction"), "suggested")
    source = F.when(F.col("a.admin"), "admin").when(F.col("a.nc") > 0, "correction").otherwise("delivery")
    after = after.select(
        F.concat(F.col("who").cast("string"), F.lit("/"), "place").alias("place"), "a.lat", "a.lng", status("a").alias("status"), source.alias("source"), F.col("a.nc").alias("n_corrections"), F.col("a.np").alias("n_passages"),
        *(F.when(status("b").isNotNull(), F.col(f"b.{c}")).alias(f"{c}_before") for c in ("lat", "lng")), status("b").alias("status_before"),
    ).where("status IS NOT NULL")
    moved = flat_distance("lat", "lng", "lat_before", "lng_before") > 1
    return after.where(F.col("status_before").isNull() | ~F.col("status").eqNullSafe(F.col("status_before")) | moved)


def _sure() -> Column:
    """A mark that counts as confirmed: `mark` with the numbers of marks around it."""
    return F.col("mark.admin") | (F.col("nc") >= 2) | ((F.col("nc") >= 1) & (F.col("np") >= 1)) | (F.col("np") >= 2) | (F.col("npp") >= 1)


def anchors_with_radius(doors: DataFrame, key: str, share: float = 0.99) -> DataFrame:
    """key, lat, lng (medians), doors, radius_m: the distance at place floor(n * share) of all, counted from 0."""
    centres = settled(ranks.medians(doors, [key], ["lat", "lng"]).withColumnsRenamed({"lat": "c_lat", "lng": "c_lng", "n": "doors"}), "centres")
    far = ranks.beside(doors, centres, [key]).withColumn("far", haversine("c_lat", "c_lng", "lat", "lng"))
    radius = ranks.value_at(far, [key], "far", F.least(F.col("n") - 1, F.floor(F.col("n") * share)))
    return centres.join(radius, key).select(key, F.col("c_lat").alias("lat"), F.col("c_lng").alias("lng"), "doors", F.col("far").alias("radius_m"))


def isolated_stops(stops: DataFrame, least_m: float = 7000.0, times: float = 4.0, near_m: float = 2000.0, neighbours: int = 2, least_stops: int = 4) -> DataFrame:
    """Stops of routes with enough stops, farther from the median centre than max(least_m, times x the median distance), with too few neighbours."""
    centre = ranks.medians(stops, ["route"], ["lat", "lng"]).where(F.col("n") >= least_stops).select("route", F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))
    far = settled(ranks.beside(stops, centre, ["route"]).withColumn("far", haversine("lat", "lng", "c_lat", "c_lng")), "far")
    limit = ranks.medians(far, ["route"], ["far"]).select("route", F.greatest(F.lit(least_m), times * F.col("far")).alias("limit_m"))
    out = ranks.beside(far, limit, ["route"]).where("far > limit_m").select(*stops.columns, "far", "limit_m")
    near = within(out.select("route", "stop", "lat", "lng"), stops.select("route", "stop", "lat", "lng"), near_m * 1.01, ["route"])
    close = near.where((F.col("stop") != F.col("r_stop")) & (haversine("lat", "lng", "r_lat", "r_lng") <= near_m)).groupBy("stop").agg(F.count("*").alias("close"))
    return out.join(close, "stop", "left").where(F.coalesce("close", F.lit(0)) < neighbours).drop("close")


def far_from_others(stops: DataFrame, keys: list[str], far_m: float = 5000.0, together_m: float = 6000.0, least: int = 3) -> DataFrame:
    """Stops with `others`, of which there are `least` at least with equal keys: farther than far_m from the median centre of the others, which lie together_m
    from that centre in the median at most.

    No pairs of stops: without one stop a group's middle moves by one place at most, so a group has nine such centres at most, three
    latitudes by three longitudes (more only if positions are missing), and its stops meet those that some far stop asks for.
    """
    ways = {f"m_{c}": ranks.median_without(c) for c in ("lat", "lng")}
    own = ranks.beside(stops, ranks.middles(stops, keys, ["lat", "lng"]), keys).withColumn("others", F.col("n") - 1).where(F.col("others") >= least)
    own = own.withColumns(ways).select(*stops.columns, "others", *ways).withColumn("far", haversine("lat", "lng", "m_lat", "m_lng"))
    own = settled(own.where(F.col("far") > far_m), "far")
    centre = [*keys, *ways]
    far = ranks.beside(stops, own.select(*centre).distinct(), keys).select(*centre, haversine("lat", "lng", "m_lat", "m_lng").alias("far"))
    return ranks.beside(own, ranks.middles(far, centre, ["far"]), centre).where(ranks.median_without("far") <= together_m).select(*stops.columns, "others")


def upper_median(values: DataFrame, key: str, value: str, least: int) -> DataFrame:
    """key, value: the element behind half of a key's values, for keys with enough of them; counted by distinct value."""
    counts = values.groupBy(key, value).agg(F.count("*").alias("n"))
    upto, total = (F.sum("n").over(w) for w in (Window.partitionBy(key).orderBy(value), Window.partitionBy(key)))
    ranked = counts.withColumns({"upto": upto, "total": total}).where((F.col("total") >= least) & (F.col("upto") > F.floor(F.col("total") / 2)))
    return ranked.groupBy(key).agg(F.min(value).alias("value"))
