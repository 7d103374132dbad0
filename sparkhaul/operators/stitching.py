"""Lines made of pieces: ends that meet are one node, and pieces go on through nodes where just two ends meet.

No line is one task: nodes are found by a grid, and the order of a line's pieces by pointer doubling, each round of which is an equi-join
and goes twice as far. A piece stands for two darts, one for each way to run through it (2 * seg forwards, 2 * seg + 1 backwards).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import flat_distance
from ..scratch import settled
from .merging import first_fit

#: Fixed value: metres within which two ends are one.
SAME_END_M = 2.0


def to_the_end(links: DataFrame) -> DataFrame:
    """dart, end, steps, least: how many links lead from each dart to the last one, and the least dart on the way, both ends included.

    links: dart, nxt (null at the end); no two darts have the same next one. On a closed line the way never ends: end is any dart of it, and
    least the least of all.
    """
    now = settled(links.select("dart", F.coalesce("nxt", "dart").alias("end"), F.col("nxt").isNotNull().cast("long").alias("steps"), F.least("dart", F.coalesce("nxt", "dart")).alias("least")), "darts")
    for _ in range(math.ceil(math.log2(max(2, now.count()))) + 1):
        on = now.select(F.col("dart").alias("at"), F.col("end").alias("then"), F.col("steps").alias("more"), F.col("least").alias("other"))
        step = now.join(on, F.col("end") == F.col("at"))
        now = settled(step.select("dart", F.col("then").alias("end"), (F.col("steps") + F.col("more")).alias("steps"), F.least("least", "other").alias("least"), (F.col("then") != F.col("end")).alias("on")), "darts")
        if now.where("on").isEmpty():
            break
        now = now.drop("on")
    return now.select("dart", "end", "steps", "least")


def stitched(lines: DataFrame, metres: float = SAME_END_M) -> DataFrame:
    """name, chain (its least piece), segs (in order): pieces of one name joined at ends that just two of them share.

    lines: name, seg (distinct), from_lat, from_lng, to_lat, to_lng. An end is the first node, by piece and end, within `metres`, else a
    node of its own. The least piece of a chain is run through forwards, and a closed line begins with it. Where more than two ends
    meet, or both of one piece, nothing is joined.
    """
    both = F.explode(F.array(*(F.struct(F.lit(e).alias("e"), F.col(f"{w}_lat").alias("lat"), F.col(f"{w}_lng").alias("lng")) for e, w in enumerate(("from", "to")))))
    ends = settled(lines.select("name", "seg", both.alias("x")).select("name", (2 * F.col("seg") + F.col("x.e")).alias("end"), "x.lat", "x.lng"), "ends")
    nodes = first_fit(ends, ["name"], "end", [], metres, flat_distance).withColumnRenamed("head", "node")
    met = nodes.groupBy("name", "node").agg(F.count("*").alias("n"), F.min("end").alias("a"), F.max("end").alias("b"))
    met = met.where("n = 2 AND a div 2 <> b div 2").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.a", "p.b")
    # who leaves at end a enters at end b: a piece is left at its end 1 forwards and at its end 0 backwards
    turn = lambda c: F.col(c) - F.col(c) % 2 + (1 - F.col(c) % 2)
    links = met.select(turn("a").alias("dart"), F.col("b").alias("nxt"))
    darts = ends.select(F.col("end").alias("dart"))
    links = settled(darts.join(links, "dart", "left"), "links")
    open_ends = links.where("nxt IS NULL").select(F.col("dart").alias("end"))
    way = settled(to_the_end(links), "ways")
    paths = way.join(open_ends, "end", "left_semi")
    closed = links.join(way.join(open_ends, "end", "left_anti").select("dart", "least"), "dart")
    # closed lines are cut before their least dart; the other way round has the backward dart of the same piece as its least
    cut = closed.where("least % 2 = 0").select("dart", F.when(F.col("nxt") != F.col("least"), F.col("nxt")).alias("nxt"))
    rings = to_the_end(cut)
    ways = settled(paths.unionByName(rings), "all-ways")
    least = ways.groupBy("end").agg(F.min("dart").alias("first")).where("first % 2 = 0")  # of the two ways, the one that runs the least piece forwards
    names = lines.select(F.col("seg").alias("chain"), "name")
    order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("place"), F.expr("dart div 2").alias("seg")))), lambda x: x["seg"])
    chains = ways.join(least, "end").groupBy(F.expr("first div 2").alias("chain")).agg(order.alias("segs"))
    return chains.join(names, "chain").select("name", "chain", "segs")
