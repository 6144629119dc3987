"""Sites and target rotation against plain folds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sightlog.operators import rotation as rt
from sightlog.operators import sites as st

KEYS, ORDER = ["session_id", "name"], ["frame_id", "det_no"]


def sites_by_hand(rows):
    founded, out = {}, {}
    for s, f, d, name, x, y in sorted(rows, key=lambda r: (r[0] or -1, r[1], r[2])):
        known = founded.setdefault((s, name), [])
        site = next((p for p in known if math.dist(p, (x, y)) <= 32), None)
        if site is None:
            site = (x, y)
            known.append(site)
        out[s, f, d] = site
    return out


@pytest.mark.parametrize("spread, hot", [(60, 0.3), (200, 0.9), (20, 0.5)])
def test_sites_are_those_of_a_fold(spark, spread, hot):
    rnd = random.Random(spread)
    rows = [(1 if rnd.random() < hot else rnd.choice([None, 2, 3]), n // 5, n, rnd.choice("ab"), rnd.randint(0, spread), rnd.randint(0, spread)) for n in range(700)]
    df = spark.createDataFrame(rows, "session_id LONG, frame_id LONG, det_no LONG, name STRING, x INT, y INT").repartition(5)
    got = {(r.session_id, r.frame_id, r.det_no): (r.site_x, r.site_y) for r in st.with_sites(df, KEYS, ORDER).collect()}
    assert got == sites_by_hand(rows)


def test_reach_is_inclusive_and_the_first_founder_wins(spark):
    rows = [(1, 1, 1, "a", 0, 0), (1, 2, 2, "a", 60, 0), (1, 3, 3, "a", 32, 0), (1, 4, 4, "a", 33, 0), (1, 4, 5, "b", 33, 0), (1, 5, 6, "a", -33, -1)]
    df = spark.createDataFrame(rows, "session_id LONG, frame_id LONG, det_no LONG, name STRING, x INT, y INT")
    got = {r.det_no: (r.site_x, r.site_y) for r in st.with_sites(df, KEYS, ORDER).collect()}
    assert got == {1: (0, 0), 2: (60, 0), 3: (0, 0), 4: (60, 0), 5: (33, 0), 6: (-33, -1)}


def test_memory_of_a_site(spark):
    rows = [(1, 1, 1, "a", 0, 0, 5, 1), (1, 2, 2, "a", 3, 0, 9, 2), (1, 7, 3, "a", 0, 3, 7, 3), (1, 7, 4, "a", 90, 3, 2, 3)]
    df = spark.createDataFrame(rows, "session_id LONG, frame_id LONG, det_no LONG, name STRING, x INT, y INT, cap INT, step LONG")
    m = st.site_memory(st.with_sites(df, KEYS, ORDER), KEYS, ORDER, F.col("cap"), "step", segments=3)
    got = {r.det_no: (r.times_seen, r.max_capacity, r.last_seen) for r in m.collect()}
    assert got == {1: (1, 5, 1), 2: (2, 9, 2), 3: (3, 9, 3), 4: (1, 2, 3)}


def plans_by_hand(ranked):
    """Target rotation as one loop over the ticks of each session."""
    out = {}
    for s in sorted({r["session_id"] for r in ranked}):
        last, repeats, hits = None, 0, {}
        near = lambda a, b: a is not None and a["name"] == b["name"] and math.dist((a["x"], a["y"]), (b["x"], b["y"])) <= 48
        for f in sorted({r["frame_id"] for r in ranked if r["session_id"] == s}):
            able = []
            for c in sorted((r for r in ranked if (r["session_id"], r["frame_id"]) == (s, f)), key=lambda r: (-r["score"], r["det_no"])):
                d, wall, walk, needed = hits.get((c["name"], c["site_x"], c["site_y"]), (0, 0, 0, None))
                left = max(0, c["capacity"] - (min(c["capacity"], max(0, d - wall - walk) * 1000) if d > 0 else 0))
                if c["seen"] >= 2 and (left <= 0 or d >= (math.ceil(c["capacity"] / 1000) if needed is None else needed)):
                    continue
                troops = math.ceil(left / 1000) + c["wall_cost"] + c["walk_extra"]
                loot = min(left, int(math.ceil(left / 1000) * 1000 * c["loot_factor"]), int(max(0, 30 - c["wall_cost"] - c["walk_extra"]) * 1000 * c["loot_factor"]))
                if troops <= 30 and left > 0 and loot >= 400:
                    able.append(c | {"troops": troops, "loot": loot})
            if not able:
                continue
            tired = lambda c: near(last, c) and repeats >= 2
            asked = next((c for c in able if c["asked"]), None)
            pick = asked if asked and not tired(asked) else next((c for c in able if not tired(c)), able[0])
            way = next(c for c in able if near(c, pick))
            same = near(last, pick)
            now = repeats + 1 if same else 1
            if same and now >= 2:
                reason = "repeat_limit_only_candidate" if len(able) == 1 else "repeat_limit_reached"
            elif last is not None and not same and repeats >= 2:
                reason = "rotated_after_repeat_limit"
            elif pick["r_name"] == pick["name"]:
                reason = "requested_target_honored"
            else:
                reason = "only_candidate" if len(able) == 1 else "top_scored_target"
            last, repeats = pick, now
            key = pick["name"], pick["site_x"], pick["site_y"]
            hits[key] = (hits.get(key, (0,))[0] + 1, way["wall_cost"], way["walk_extra"], way["troops"])
            out[s, f] = (pick["name"], pick["x"], pick["y"], way["px"], way["py"], now, reason, len(able), way["troops"], way["loot"])
    return out


RANKED = (
    "session_id LONG, frame_id LONG, det_no LONG, name STRING, x INT, y INT, score DOUBLE, site_x INT, site_y INT, seen LONG, capacity LONG, px INT, py INT, "
    "wall_cost INT, walk_extra INT, loot_factor DOUBLE, asked BOOLEAN, r_name STRING"
)


def test_sites_move_each_row_once(spark, capsys):
    """Rows went through four shuffles for their sites, which filled the disks."""
    df = spark.createDataFrame([(1, 1, 1, "a", 0, 0)], "session_id LONG, frame_id LONG, det_no LONG, name STRING, x INT, y INT")
    st.with_sites(df, KEYS, ORDER).explain()
    assert capsys.readouterr().out.count("Exchange ") == 1


@pytest.mark.parametrize("large", [1_000_000, 20])
def test_memory_of_detections_seen_at_once(spark, large):
    """What is known of a site after each frame, also of sites that are laid out in segments."""
    rnd = random.Random(5)
    rows = [(1 if rnd.random() < 0.6 else rnd.choice([None, 2]), rnd.randint(0, 40), n, rnd.choice("ab"), rnd.randint(0, 90), 5, rnd.choice([None, *range(9)]), 0) for n in range(400)]
    df = spark.createDataFrame(rows, "session_id LONG, frame_id LONG, det_no LONG, name STRING, x INT, y INT, cap INT, step LONG").repartition(4)
    seen = st.site_memory(st.with_sites(df, KEYS, ORDER), KEYS, ["frame_id"], F.col("cap"), "step", segments=5, together=True, large=large)
    got = {r.det_no: (r.times_seen, r.max_capacity) for r in seen.collect()}
    site = sites_by_hand([r[:6] for r in rows])
    of = lambda r: (r[0], r[3], site[r[:3]])
    want = {}
    for r in rows:
        until = [q for q in rows if of(q) == of(r) and q[1] <= r[1]]
        want[r[2]] = len(until), max((q[6] for q in until if q[6] is not None), default=None)
    assert len(got) == 400 and got == want


def test_candidates_of_repeated_and_incomplete_rows(spark):
    """Each row of a repeated number has the capacities of all of them; frames may ask for several places; rows without a frame or a session name no candidate."""
    t = [(1, 5, "金矿", 100, 100, 900), (1, 5, "金矿", 100, 100, 900), (2, 6, "金矿", 105, 100, 2500), (3, 7, "圣水瓶", 300, 300, None), (None, 8, "金矿", 1, 1, 5), (4, 9, "金矿", 100, 100, 700)]
    targets = spark.createDataFrame(t, "frame_id LONG, det_no LONG, name STRING, x INT, y INT, cap INT")
    frames = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, None, 1)], "frame_id LONG, session_id LONG, step LONG")
    asked = [(2, "圣水瓶", 150, 100), (2, "金矿", 100, 100), (3, "金矿", 310, 300)]
    requests = spark.createDataFrame(asked, "frame_id LONG, r_name STRING, rx INT, ry INT")
    land = [(f, "landable", x + 10, x) for f, x in ((1, 100), (2, 100), (3, 300), (4, 100))]
    points = spark.createDataFrame(land + [(f, "target", x, y) for f, _, _, x, y, _ in t], "frame_id LONG, role STRING, x INT, y INT")
    walls = spark.createDataFrame([(1, 1, 105, 90, 105, 110)], "frame_id LONG, wall_no LONG, x1 INT, y1 INT, x2 INT, y2 INT")
    full = spark.createDataFrame([(2, "elixir")], "frame_id LONG, resource STRING")
    found = rt.candidates(targets, frames, requests, points, walls, full, (1280, 720)).collect()
    got = sorted((r.frame_id, r.det_no, r.name, r.x, r.site_x, r.seen, r.capacity, r.px, r.wall_cost, r.asked, r.r_name or "") for r in found)
    assert got == [
        *[(1, 5, "金矿", 100, 100, 4, 900, 110, 3, False, "")] * 4,
        (2, 6, "金矿", 105, 100, 5, 2500, 110, 0, False, "圣水瓶"), (2, 6, "金矿", 105, 100, 5, 2500, 110, 0, True, "金矿"),
        (3, 7, "圣水瓶", 300, 300, 1, 4000, 310, 0, False, "金矿"), (3, rt.REQUESTED, "金矿", 310, 310, 1, 1500, 310, 0, True, "金矿"),
    ]


def test_rotation_against_a_loop(spark):
    rnd = random.Random(7)
    rows, names = [], ["金矿", "圣水瓶"]
    for f in range(240):
        s, wanted = 1 + f % 3, rnd.choice([None, None, "金矿"])
        for d in range(rnd.randint(1, 4)):
            name, (x, y) = rnd.choice(names), rnd.choice([(100, 100), (130, 100), (400, 300), (60, 500)])
            site = (100, 100) if x < 140 and y == 100 else (x, y)
            rows.append((s, f, d, name, x, y, round(rnd.random(), 2), *site, rnd.choice([1, 2, 5]), rnd.choice([900, 2500, 4000]), x + 5, y - 5, rnd.choice([0, 0, 3]), rnd.choice([0, 1]), rnd.choice([1.0, 0.5]), wanted == name and x < 140, wanted))
    df = spark.createDataFrame(rows + rows[:3], RANKED).repartition(4)
    columns = df.columns
    want = plans_by_hand([dict(zip(columns, r, strict=True)) for r in rows + rows[:3]])
    got = {(r.session_id, r.frame_id): (r.name, r.x, r.y, r.land_x, r.land_y, r.repeats, r.reason, r.n_candidates, r.troops_needed, r.expected_loot) for r in rt.rotate_targets(df).collect()}
    assert got == want
    assert {v[6] for v in want.values()} == {"repeat_limit_only_candidate", "repeat_limit_reached", "rotated_after_repeat_limit", "requested_target_honored", "only_candidate", "top_scored_target"}


def test_requests_join_the_candidates_only_where_none_is_near(spark):
    t = spark.createDataFrame([(1, 5, "金矿", 100, 100), (2, 6, "圣水瓶", 100, 100)], "frame_id LONG, det_no LONG, name STRING, x INT, y INT")
    asked = [(1, "金矿", 148, 100), (2, "金矿", 100, 100), (3, "金矿", 5000, -4), (4, "进攻按钮", 1, 1), (5, None, 1, 1)]
    r = spark.createDataFrame(asked, "frame_id LONG, r_name STRING, rx INT, ry INT")
    got = {(x.frame_id, x.det_no, x.name, x.x, x.y) for x in rt.add_requests(t, r, (1280, 720)).collect()}
    assert got == {(1, 5, "金矿", 100, 100), (2, 6, "圣水瓶", 100, 100), (2, rt.REQUESTED, "金矿", 100, 100), (3, rt.REQUESTED, "金矿", 1279, 0)}


def test_no_rows(spark):
    assert rt.rotate_targets(spark.createDataFrame([], RANKED)).count() == 0
    none = spark.createDataFrame([], "session_id LONG, frame_id LONG, det_no LONG, name STRING, x INT, y INT")
    assert st.with_sites(none, KEYS, ORDER).count() == 0
