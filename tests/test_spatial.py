"""Neighbour joins and the greedy merge against brute force, on frames with one crowded frame."""

import random

from pyspark.sql import functions as F

from sightlog.functions import geometry as g
from sightlog.operators import boxes as bx
from sightlog.operators import spatial as sp


def points(rnd, n):
    return [(1 if rnd.random() < 0.6 else rnd.randint(2, 5), rnd.randint(0, 300), rnd.randint(0, 200)) for _ in range(n)]


def test_nearest_against_all_pairs(spark):
    rnd = random.Random(1)
    left, right = points(rnd, 120), points(rnd, 80)
    l = spark.createDataFrame(left, "f INT, x INT, y INT")
    r = spark.createDataFrame(right, "f INT, x INT, y INT")
    want = {}
    for f, x, y in left:
        near = [((x - a) ** 2 + (y - b) ** 2, b, a) for g, a, b in right if g == f]
        near = [v for v in near if v[0] <= 60 * 60]
        if near:
            want[f, x, y] = min(near)
    got = {(q.f, q.x, q.y): (q.d2, q.py, q.px) for q in sp.nearest(l, r, ["f"], 60).collect()}
    assert got == want


def test_neighbours_of_several_roles_in_one_pass(spark):
    rows = [(1, "t", 10, 10), (1, "t", 10, 10), (1, "t", 50, 10), (1, "d", 13, 14), (1, "d", 13, 6), (2, "t", 0, 0), (2, "l", 300, 0), (3, "l", 1, 1), (4, "t", 5, 5), (4, "d", 5, 5)]
    got = sp.neighbours(spark.createDataFrame(rows, "f INT, role STRING, x INT, y INT"), ["f"], "t", {"d": 30, "l": 299}).collect()
    have = {(r.f, r.x, r.y): (r.has_d, r.has_l, r.d and tuple(r.d), r.l and tuple(r.l)) for r in got}
    assert have == {
        (1, 10, 10): (True, False, (25, 6, 13), None), (1, 50, 10): (True, False, None, None), (2, 0, 0): (False, True, None, None),
        (4, 5, 5): (True, False, (0, 5, 5), None),
    }
    assert len(got) == 4


def test_crowded_frame_ends(spark):
    # 15,000 points of either side in one frame: pairs would be 225 millions
    side = lambda a, b, role: spark.range(15_000).selectExpr("1 AS f", f"'{role}' AS role", f"CAST((id * {a}) % 1280 AS INT) AS x", f"CAST((id * {b}) div 7 % 720 AS INT) AS y")
    points = side(37, 11, "t").unionByName(side(53, 29, "d"))
    got = sp.neighbours(points, ["f"], "t", {"d": 200})
    total = got.agg(F.count("*").alias("n"), F.count("d").alias("found"), F.max("d.d2").alias("far")).first()
    assert total.n == points.filter("role = 't'").distinct().count() == total.found and total.far < 1600


def test_first_in_reach_takes_the_first_not_the_nearest(spark):
    l = spark.createDataFrame([(1, 50, 50)], "f INT, x INT, y INT")
    r = spark.createDataFrame([(1, 50, 50, 9), (1, 60, 50, 3), (1, 80, 50, 1)], "f INT, x INT, y INT, o INT")
    assert sp.first_in_reach(l, r, ["f"], 24, "o", []).collect()[0].o == 3


def test_reach_includes_the_radius(spark):
    l = spark.createDataFrame([(1, 0, 0)], "f INT, x INT, y INT")
    r = spark.createDataFrame([(1, 24, 0), (1, 0, 25)], "f INT, px INT, py INT")
    assert sp.within_reach(l, r, ["f"], 24).count() == 1


def test_crossing_layers(spark):
    routes = spark.createDataFrame([(1, 0, 0, 300, 0), (2, 0, 0, 300, 300)], "f INT, x INT, y INT, px INT, py INT")
    walls = [
        (1, 10, -5, 10, 5), (1, 20, 0, 20, 9), (1, 40, 0, 90, 0), (1, 5, 1, 300, 1),  # crossing, touching, collinear, apart
        (2, 200, 100, 300, 101), (2, 290, 280, 280, 290),
    ]
    w = spark.createDataFrame(walls, "f INT, x1 INT, y1 INT, x2 INT, y2 INT")
    got = {r.f: r.layers for r in sp.crossing_layers(routes, w, ["f"], cap=5).collect()}
    assert got == {1: 3, 2: 1}
    capped = {r.f: r.layers for r in sp.crossing_layers(routes, w, ["f"]).collect()}
    assert capped == {1: 2, 2: 1}


def test_lines_meet_as_the_column_expression_says(spark):
    rnd = random.Random(6)
    lines = [tuple(rnd.randint(-9, 9) for _ in range(8)) for _ in range(600)]
    df = spark.createDataFrame(lines, ", ".join(f"v{i} INT" for i in range(8)))
    for r in df.withColumn("meet", g.segments_meet(*[F.col(f"v{i}") for i in range(8)])).collect():
        assert g.lines_meet(tuple(r[:4]), tuple(r[4:8])) == r.meet


def test_crossings_against_all_pairs(spark):
    rnd = random.Random(5)
    line = lambda reach: (lambda x, y: (x, y, x + rnd.randint(-reach, reach), y + rnd.randint(-reach, reach)))(rnd.randint(0, 500), rnd.randint(-50, 400))
    routes, walls = [(rnd.randint(1, 2), *line(300)) for _ in range(120)], [(rnd.randint(1, 2), *line(80)) for _ in range(150)]
    walls += walls[:20]
    got = {tuple(r[:5]): r.layers for r in sp.crossing_layers(spark.createDataFrame(routes, "f INT, x INT, y INT, px INT, py INT"), spark.createDataFrame(walls, "f INT, x1 INT, y1 INT, x2 INT, y2 INT"), ["f"], cap=4).collect()}
    want = {r: min(4, sum(w[0] == r[0] and g.lines_meet(r[1:], w[1:]) for w in walls)) for r in routes}
    assert got == {r: n for r, n in want.items() if n} and len(got) > 50


def iou(a, b):
    i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i
    return i / u if u > 0 else 0


def test_merge_sources_against_greedy(spark):
    rnd = random.Random(3)
    rows = []
    for n in range(400):
        x, y, w, h = rnd.randint(0, 60), rnd.randint(0, 60), rnd.choice([8, 20, 33, 70]), rnd.choice([9, 25, 64])
        rows.append((1 if rnd.random() < 0.5 else 2, rnd.randint(0, 1), n, rnd.choice(["ocr", "llm", "llm", "local"]), x, y, x + w, y + h))
    rows += [(1, 0, 1000 + i, "llm", 5, 5, 30, 30) for i in range(20)]  # many copies of one box
    df = spark.createDataFrame(rows, "frame_id INT, class_id INT, det_no INT, source STRING, x1 INT, y1 INT, x2 INT, y2 INT")
    want = set()
    for key in {(r[0], r[1]) for r in rows}:
        group = [r for r in rows if (r[0], r[1]) == key]
        kept = [r for r in group if r[3] == "ocr"]
        for r in sorted((r for r in group if r[3] == "llm"), key=lambda r: r[2]):
            if all(iou(k[4:], r[4:]) <= 0.5 for k in kept):
                kept.append(r)
        want |= {r[2] for r in kept}
    got = [r.det_no for r in bx.merge_sources(df, ["frame_id", "class_id"], "det_no", "ocr", "llm").collect()]
    assert sorted(got) == sorted(want)


def test_overlapping_pairs_are_complete(spark):
    rnd = random.Random(4)
    rows = []
    for n in range(150):
        x, y = rnd.randint(-20, 40), rnd.randint(0, 40)
        rows.append((1 + n % 2 if n % 5 else None, n, x, y, x + rnd.randint(0, 60), y + rnd.randint(0, 60)))
    rows.append((1, 999, None, 0, 10, 10))
    df = spark.createDataFrame(rows, "f INT, n INT, x1 INT, y1 INT, x2 INT, y2 INT").repartition(4)
    got = {(r.a_rank, r.b_rank): r.iou for r in bx.overlapping_pairs(df, ["f"], "n").collect()}
    want = {(a[1], b[1]): iou(a[2:], b[2:]) for a in rows[:-1] for b in rows[:-1] if a[0] == b[0] and a[1] < b[1] and iou(a[2:], b[2:]) > 0.5}
    assert got == want and len(want) > 30


def test_crowded_frame_of_jittered_boxes_ends(spark):
    # 100,000 boxes within a few pixels of each other: pairs would be five thousand millions
    rows = spark.range(100_000).selectExpr(
        "1 AS frame_id", "0 AS class_id", "id AS det_no", "'llm' AS source", "CAST(id % 40 AS INT) AS x1", "CAST(id div 40 % 50 AS INT) AS y1",
        "CAST(id % 40 + 60 + id div 2000 % 10 AS INT) AS x2", "CAST(id div 40 % 50 + 50 + id div 20000 AS INT) AS y2",
    )
    kept = bx.merge_sources(rows, ["frame_id", "class_id"], "det_no", "ocr", "llm").collect()
    boxes = [(r.x1, r.y1, r.x2, r.y2) for r in kept]
    assert 0 < len(boxes) < 30 and all(iou(a, b) <= 0.5 for i, a in enumerate(boxes) for b in boxes[:i])
