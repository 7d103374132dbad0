"""Lines of pieces against a walk from piece to piece."""

import math
import random

from sparkhaul.operators import stitching


def near(a, b):
    return 111320.0 * math.hypot(b[0] - a[0], (b[1] - a[1]) * math.cos(math.radians(a[0]))) <= 2.0


def walked(pieces):
    """pieces: seg -> (from, to), of one name."""
    nodes, at = [], {}
    for seg in sorted(pieces):
        for e in (0, 1):
            k = next((i for i, n in enumerate(nodes) if near(n, pieces[seg][e])), None)
            if k is None:
                nodes.append(pieces[seg][e])
                k = len(nodes) - 1
            at[seg, e] = k
    meet = {}
    for end, k in at.items():
        meet.setdefault(k, []).append(end)
    left, out = set(pieces), set()
    while left:
        chain = [min(left)]
        left.discard(chain[0])
        for forward in (True, False):
            end = (chain[0], 1 if forward else 0)
            while len(meet[at[end]]) == 2:
                seg, e = next((x for x in meet[at[end]] if x != end), end)
                if seg not in left:
                    break
                left.discard(seg)
                chain = [*chain, seg] if forward else [seg, *chain]
                end = (seg, 1 - e)
        out.add(tuple(chain))
    return out


def test_chains_rings_and_branches(spark):
    rng = random.Random(7)
    rows, number = [], 0
    for name in range(12):
        at = lambda k: (-9.5 + 0.001 * k + rng.uniform(-4e-6, 4e-6), -35.7 + 0.01 * name + rng.uniform(-4e-6, 4e-6))  # noqa: B023, E731
        kinds = [(k, k + 1) for k in range(name * 3)]
        kinds += [(50, 51), (51, 52), (52, 50)] if name % 2 else []  # a ring
        kinds += [(70, 71), (71, 72), (71, 73)] if name % 3 == 0 else []  # a branch
        kinds += [(90, 90)] + [(95, 96), (95, 96)]  # a loop, and two pieces beside each other
        rng.shuffle(kinds)
        for a, b in kinds:
            a, b = (a, b) if rng.random() < 0.5 else (b, a)
            rows.append((f"n{name}", number, *at(a), *at(b)))
            number += 1
    df = spark.createDataFrame(rows, "name string, seg long, from_lat double, from_lng double, to_lat double, to_lng double").repartition(3)
    found = {(r.name, tuple(r.segs)) for r in stitching.stitched(df).collect()}
    expected = set()
    for name in {r[0] for r in rows}:
        expected |= {(name, c) for c in walked({s: ((a, b), (c, d)) for n, s, a, b, c, d in rows if n == name})}
    assert found == expected


def test_a_long_line(spark):
    n = 3000
    order = list(range(n))
    random.Random(8).shuffle(order)
    rows = [("long", seg, -9.5 + 1e-4 * k, -35.7, -9.5 + 1e-4 * (k + 1), -35.7) for k, seg in enumerate(order)]
    (found,) = stitching.stitched(spark.createDataFrame(rows, "name string, seg long, from_lat double, from_lng double, to_lat double, to_lng double")).collect()
    assert list(found.segs) in (order, order[::-1])
