"""Sequencing of routes: each route is one small group (some tens of stops), so its search runs in one task with others in parallel.

Searches have fixed numbers of rounds instead of a time limit, so the same input gives the same route.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M
from ..scratch import settled

#: Legs looked at for starts, stops of a small route, nearest stops that a stop may be put beside in a small and in a large one, and
#: paths improved of a small one.
TRIED, SMALL, NEAR_SMALL, NEAR, PATHS = 2_000_000, 100, 16, 10, 6
#: Changes for each stop, metres on the road for a metre in a straight line, and metres a second.
ROUNDS, DETOUR, SPEED = 30, 1.35, 7.0
#: Metres within which stops are one block, one visit, one visit of the same carrier stop, and one visit of the same address.
BLOCK_M, VISIT_M, CARRIER_M, ADDRESS_M = 10.0, 25.0, 300.0, 150.0
#: What no read line of an address has: neither letter, digit, blank nor , . - / _
ODD = r"[^\p{L}\p{N}_\t-\r\x1c-\x1f \x85\p{Z},.\-/]"


def straight_metres(lat: np.ndarray, lng: np.ndarray, lat2: np.ndarray, lng2: np.ndarray) -> np.ndarray:
    """Great-circle distances between points that broadcast against each other."""
    lat, lng, lat2, lng2 = (np.radians(x) for x in (lat, lng, lat2, lng2))
    a = np.sin((lat2 - lat) / 2) ** 2 + np.cos(lat) * np.cos(lat2) * np.sin((lng2 - lng) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(a)))


def matrix(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    """Approximate seconds between all stops of one route."""
    return straight_metres(lat[:, None], lng[:, None], lat, lng) * DETOUR / SPEED


def path_cost(order: np.ndarray, seconds: np.ndarray) -> float:
    return float(seconds[order[:-1], order[1:]].sum())


def _nearest_neighbour(seconds: np.ndarray, begin: list[int], last: int) -> np.ndarray:
    """The path that begins so and goes on to the nearest stop each time; `last` comes last, unless it is below 0."""
    n = len(seconds)
    left = np.ones(n, bool)
    left[[*begin, last] if last >= 0 else begin] = False
    path = list(begin)
    for _ in range(int(left.sum())):
        nearest = int(np.argmin(np.where(left, seconds[path[-1]], np.inf)))
        path.append(nearest)
        left[nearest] = False
    return np.array([*path, last] if last >= 0 else path)


def _improved(path: np.ndarray, seconds: np.ndarray, near: np.ndarray, fixed_start: bool, fixed_end: bool, most: int) -> np.ndarray:
    """The path after the best reversal or move, again and again, while one makes it shorter; `most` of them at most.

    Only changes that put a stop beside one of its nearest ones are tried. What a change gains is worked out from the legs it takes
    away and adds; running sums tell the legs of a part read backwards, so seconds need not be the same both ways.
    """
    n = len(path)
    # a stop that stands before the path and behind it: its legs cost nothing, or keep a fixed end where it is
    padded = np.zeros((n + 1, n + 1))
    padded[:n, :n] = seconds
    low, high = int(fixed_start), n - int(fixed_end)
    for _ in range(most):
        around = np.concatenate([[n], path, [n]])  # position + 1
        place = np.empty(n, np.int64)
        place[path] = np.arange(n)
        legs = padded[around[:-1], around[1:]]  # legs[k] goes into position k
        back = np.concatenate([[0.0], np.cumsum(padded[path[1:], path[:-1]] - legs[1:n])])  # up to each position, read backwards less forwards
        i = np.repeat(np.arange(n), near.shape[1])
        j = place[near[path].ravel()]
        best = (-1e-6, None)

        # reversals of first..end that make the two stops neighbours, or bring one to a free end of the path
        firsts, ends = np.minimum(i, j), np.maximum(i, j)
        first = np.concatenate([firsts + 1, firsts, np.arange(low, high), np.full(high - low, low)])
        end = np.concatenate([ends, ends - 1, np.full(high - low, high - 1), np.arange(low, high)])
        good = (first >= low) & (end < high) & (first < end)
        first, end = first[good], end[good]
        if len(first):
            before, after = around[first], around[end + 2]
            gain = padded[before, path[end]] + padded[path[first], after] - legs[first] - legs[end + 1] + back[end] - back[first]
            k = int(np.argmin(gain))
            if gain[k] < best[0]:
                best = (gain[k], ("reverse", int(first[k]), int(end[k])))

        # parts of one to three stops, as they are or backwards, put before or behind the other stop or at an end of the path
        for size in range(1, min(3, high - low) + 1):
            begin = np.concatenate([i, i, i - size + 1, i - size + 1, np.arange(n), np.arange(n)])
            to = np.concatenate([j, j + 1, j, j + 1, np.full(n, low), np.full(n, high)])  # before which position
            stop = begin + size - 1
            good = (begin >= low) & (stop < high) & (to >= low) & (to <= high) & ((to < begin) | (to > stop + 1))
            begin, to, stop = begin[good], to[good], stop[good]
            if not len(begin):
                continue
            left, right, before, after = around[begin], around[stop + 2], around[to], around[to + 1]
            a, z = path[begin], path[stop]
            without = padded[left, right] - legs[begin] - legs[stop + 1] - legs[to]
            for turned in (False, True):
                x, y = (z, a) if turned else (a, z)
                gain = without + padded[before, x] + padded[y, after] + (back[stop] - back[begin] if turned else 0.0)
                k = int(np.argmin(gain))
                if gain[k] < best[0]:
                    best = (gain[k], ("turn" if turned else "move", int(begin[k]), int(stop[k]), int(to[k])))
        change = best[1]
        if change is None:
            break
        if change[0] == "reverse":
            path[change[1] : change[2] + 1] = path[change[1] : change[2] + 1][::-1].copy()
        else:
            what, begin, stop, to = change
            part = path[begin : stop + 1][::-1] if what == "turn" else path[begin : stop + 1]
            rest = np.concatenate([path[:begin], path[stop + 1 :]])
            to -= stop - begin + 1 if to > stop else 0
            path = np.concatenate([rest[:to], part, rest[to:]])
    return path


def shortest_path(seconds: np.ndarray, fixed_start: bool = False, fixed_end: bool = False, rounds: int = ROUNDS) -> np.ndarray:
    """An open path over all stops: the best of nearest-neighbour paths, each made shorter by reversals and moves.

    fixed_start: it begins at stop 0, and starts differ in the next one; fixed_end: it ends at the last stop. Starts are tried while TRIED legs are looked at in all, the
    PATHS shortest are improved if the route has up to SMALL stops, else one. A stop is put beside one of its nearest stops only.
    At most `rounds` changes for each stop.
    """
    n = len(seconds)
    if n < 3:
        return np.arange(n)
    last = n - 1 if fixed_end else -1
    starts = [[0, k] if fixed_start else [k] for k in range(int(fixed_start), n) if k != last]
    step = -(-len(starts) * n * n // TRIED)
    paths = sorted((_nearest_neighbour(seconds, k, last) for k in starts[::step]), key=lambda p: path_cost(p, seconds))
    masked = seconds + np.diag(np.full(n, np.inf))
    count = min(n - 1, NEAR_SMALL if n <= SMALL else NEAR)
    near = np.argsort(masked, axis=1, kind="stable")[:, :count]
    found = [_improved(p, seconds, near, fixed_start, fixed_end, rounds * n) for p in paths[: PATHS if n <= SMALL else 1]]
    return min(found, key=lambda p: path_cost(p, seconds))


def sequenced(stops: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """route, stop, place (from 0), leg_seconds of the path of each route; stops: route, stop, lat, lng."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("stop").reset_index(drop=True)
        seconds = matrix(rows.lat.to_numpy(), rows.lng.to_numpy())
        order = shortest_path(seconds, rounds=rounds)
        legs = np.concatenate([[0.0], seconds[order[:-1], order[1:]]])
        return pd.DataFrame({"route": rows.route, "stop": rows.stop.to_numpy()[order], "place": np.arange(len(order)), "leg_seconds": legs})

    return stops.select("route", "stop", "lat", "lng").groupBy("route").applyInPandas(one, "route long, stop long, place long, leg_seconds double")


def assembled(areas: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """route, stop, place, leg_seconds, at_seconds: a route through its areas in order, from the end of one to the nearest of the next.

    areas: route, area, deadline (minutes or null), stop, lat, lng. The area with the earliest deadline comes first, then the one whose
    centre is nearest to where the last one ended.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        groups = {k: g.sort_values("stop").reset_index(drop=True) for k, g in rows.groupby("area")}
        centre = {k: (g.lat.mean(), g.lng.mean(), g.deadline.min()) for k, g in groups.items()}
        here: tuple[float, float] | None = None
        out: list[tuple] = []
        while groups:

            def rank(k):
                lat, lng, deadline = centre[k]
                far = 0.0 if here is None else float(straight_metres(np.float64(here[0]), np.float64(here[1]), np.float64(lat), np.float64(lng)))
                return (np.inf if pd.isna(deadline) else deadline, far, k)

            chosen = min(groups, key=rank)
            g = groups.pop(chosen)
            lat, lng = g.lat.to_numpy(), g.lng.to_numpy()
            if here is not None:
                lat, lng = np.r_[here[0], lat], np.r_[here[1], lng]
            seconds = matrix(lat, lng)
            order = shortest_path(seconds, fixed_start=here is not None, rounds=rounds)
            legs = np.concatenate([[0.0], seconds[order[:-1], order[1:]]])
            shift = int(here is not None)
            out += [(g.route[0], g.stop[i - shift], leg) for i, leg in zip(order, legs, strict=True) if i >= shift]
            here = (lat[order[-1]], lng[order[-1]])
        frame = pd.DataFrame(out, columns=["route", "stop", "leg_seconds"])
        return frame.assign(place=np.arange(len(frame)), at_seconds=frame.leg_seconds.cumsum())

    return areas.groupBy("route").applyInPandas(one, "route long, stop long, leg_seconds double, place long, at_seconds double")


def resequenced(plan: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """route, stop, place: what is left of each route after its last delivery, in a new order from there.

    plan: route, stop, place, lat, lng, delivered_at. A route whose deliveries follow its plan keeps its order.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place").reset_index(drop=True)
        done, left = rows[rows.delivered_at.notna()].sort_values("delivered_at"), rows[rows.delivered_at.isna()]
        if len(done) and len(left) > 1 and not (done.place.to_numpy() == np.arange(len(done))).all():
            at = done.iloc[-1]
            seconds = matrix(np.r_[at.lat, left.lat], np.r_[at.lng, left.lng])
            order = shortest_path(seconds, fixed_start=True, rounds=rounds)[1:] - 1
            left = left.iloc[order]
        return pd.DataFrame({"route": left.route, "stop": left.stop, "place": np.arange(len(left))})

    return plan.groupBy("route").applyInPandas(one, "route long, stop long, place long")


def anchored_groups(stops: DataFrame, order: str, metres: float, consecutive: bool = False) -> DataFrame:
    """route, stop, grp: each stop joins the first group whose first stop is within `metres`, else begins one.

    consecutive: only the group before it is asked (runs of stops). Groups are numbered in the order they begin.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([order, "stop"]).reset_index(drop=True)
        anchors: list[tuple[float, float]] = []
        grp = []
        for lat, lng in zip(rows.lat, rows.lng, strict=True):
            asked = range(max(0, len(anchors) - 1), len(anchors)) if consecutive else range(len(anchors))
            found = next((k for k in asked if straight_metres(*map(np.float64, (*anchors[k], lat, lng))) <= metres), None)
            if found is None:
                anchors.append((lat, lng))
                found = len(anchors) - 1
            grp.append(found)
        return pd.DataFrame({"route": rows.route, "stop": rows.stop, "grp": grp})

    columns = list(dict.fromkeys(["route", "stop", order, "lat", "lng"]))
    return stops.select(*columns).groupBy("route").applyInPandas(one, "route long, stop long, grp long")


def visits(stops: DataFrame) -> DataFrame:
    """route, stop, visit: first fit by the visit's first stop, farther for the same carrier stop or the same address. stops: also carrier, address_key, seq."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["seq", "stop"]).reset_index(drop=True)
        lat, lng, carrier = (rows[c].to_numpy() for c in ("lat", "lng", "carrier"))
        address = pd.factorize(rows.address_key)[0]
        heads, n = np.empty(len(rows), dtype=np.int64), 0  # the first stop of each visit
        found = np.empty(len(rows), dtype=np.int64)
        for i in range(len(rows)):
            h = heads[:n]
            far = straight_metres(lat[h], lng[h], lat[i], lng[i])
            reach = np.where(carrier[h] == carrier[i], CARRIER_M, np.where(address[h] == address[i], ADDRESS_M, VISIT_M))
            fits = np.flatnonzero(far <= np.maximum(reach, VISIT_M))
            if len(fits):
                found[i] = fits[0]
            else:
                heads[n], found[i], n = i, n, n + 1
        return pd.DataFrame({"route": rows.route, "stop": rows.stop, "visit": found})

    return stops.select("route", "stop", "seq", "carrier", "address_key", "lat", "lng").groupBy("route").applyInPandas(one, "route long, stop long, visit long")


def claimed(points: DataFrame, lassos: DataFrame, inside: Column) -> DataFrame:
    """route, stop, area: the first lasso (by number) of its route that holds a stop, else the last area of all. lassos: route, lasso, ring."""
    held = points.join(lassos, "route").where(inside)
    first = held.groupBy("route", "stop").agg(F.min("lasso").alias("lasso"))
    count = lassos.groupBy("route").agg(F.count("*").alias("n"))
    return points.select("route", "stop").join(first, ["route", "stop"], "left").join(count, "route", "left").select("route", "stop", F.coalesce("lasso", "n", F.lit(0)).alias("area"))


def running(value: str, *order: str) -> Column:
    return F.sum(value).over(Window.partitionBy("route").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def linked_readings(lines: DataFrame) -> DataFrame:
    """document, line, readings: one line for each door that several readings of a document saw, the cleanest text of it.

    lines: document, reading, line, door (street and number), unit. Lines of one door are the same unless their units differ or one reading
    has both; a line without a unit is taken into the one line with a unit, if there is just one. The cleanest text has the fewest
    odd symbols, then the most letters, then comes first. What one reading saw several times is several stops.
    """
    lines = settled(lines, "readings").where("door IS NOT NULL AND unit IS NOT NULL")
    clean = F.struct(F.regexp_count("line", F.lit(ODD)).alias("odd"), (-F.length("line")).alias("letters"), "line")
    seen = lines.groupBy("document", "door", "unit", "reading").agg(F.count("*").alias("n"), F.min(clean).alias("clean"))
    of_door, bare = Window.partitionBy("document", "door"), F.col("unit") == ""
    of_reading = Window.partitionBy("document", "door", "reading")
    named = F.when(~bare, F.col("unit"))
    seen = seen.withColumn("both", F.bool_or(bare).over(of_reading) & F.bool_or(~bare).over(of_reading))
    seen = seen.withColumns({"only": F.min(named).over(of_door), "last": F.max(named).over(of_door), "both": F.bool_or("both").over(of_door)})
    unit = F.when(bare & (F.col("only") == F.col("last")) & ~F.col("both"), F.col("only")).otherwise(F.col("unit"))
    stops = seen.groupBy("document", "door", unit.alias("unit")).agg(F.max("n").alias("copies"), F.min("clean").alias("clean"), F.count("reading").alias("readings"))
    return stops.select("document", F.explode(F.array_repeat("clean.line", F.col("copies").cast("int"))).alias("line"), "readings")
