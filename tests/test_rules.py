"""Small literal cases for the edges of each rule."""

import json

import pytest
from pyspark.sql import functions as F

from sightlog import vocab
from sightlog.functions import geometry as g
from sightlog.functions import text as tx
from sightlog.operators import audit as au
from sightlog.operators import boxes as bx
from sightlog.operators import catalogue as ct
from sightlog.operators import evaluate as ev
from sightlog.operators import scoring as sc
from sightlog.operators import teacher as te
from sightlog.plans import all_queries
from sightlog.sources import files


def one(df):
    return df.collect()[0]


def test_label_lines(spark):
    lines = ["3 0.5 0.5 0.1 0.2", "3 0.5 0.5 0.1", "", "1  0.25\t0.5 0.5 1.0 "]
    df = spark.createDataFrame([(x, 200, 100) for x in lines], "line STRING, w INT, h INT")
    got = [(r.class_id, r.x1, r.y1, r.x2, r.y2) for r in bx.parse_label_lines(df).collect()]
    assert got == [(3, 90, 40, 110, 60), (1, 0, 0, 100, 100)]
    assert bx.clamp_label_lines(df.limit(2)).select("changed").collect()[1].changed is False


def test_rounding_follows_the_binary_value(spark):
    values = [0.2453125, 0.5203125, 0.5, 0.0000005, 0.1234565]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE").select(g.fixed_text(F.col("v")).alias("t"))
    assert [r.t for r in df.collect()] == [f"{v:.6f}" for v in values]


def test_label_text_is_made_once(spark):
    values = [0.0, -0.25, 1e-7, 0.0000005, 0.2453125, 0.1234565, 0.9999995, 0.9999999, 12.5, 999.9999996, 1000.25, *(i / 1280 for i in range(400))]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE").select(g.fraction_text(F.col("v")).alias("t"))
    assert [r.t for r in df.collect()] == [f"{v:.6f}" for v in values]
    box = F.struct(*[(F.col("id") / 7).alias(c) for c in ("cx", "cy", "bw", "bh")])
    lines = spark.range(5).select(F.lit(10).alias("w"), F.lit(10).alias("h"), g.box_line(F.lit(1), box).alias("line"))
    plan = bx.parse_label_lines(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("format_number") == 1


@pytest.mark.parametrize("box,want", [((10, 10, 50, 40), (10, 10, 50, 40)), ((50, 10, 10, 40), None), ((-5, 90, 300, 130), (0, 90, 200, 100)),
                                      ((210, 10, 260, 40), None)])
def test_clamp_to_image(spark, box, want):
    df = spark.createDataFrame([tuple(float(v) for v in box)], "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE")
    out = g.add_clamped_to_image(df, "o", F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.lit(200), F.lit(100)).collect()
    assert (tuple(out[0].o) if out else None) == want


def test_button_rules_in_order(spark):
    texts = ["donate", "attack next", "Attack", "消息列表", "确认", "zzz", "search back"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = [(r.a, r.b) for r in df.select(tx.button_class(F.col("t")).alias("a"), tx.any_button_class(F.col("t")).alias("b")).collect()]
    assert got == [(11, 11), (6, 6), (None, None), (None, 12), (None, 15), (None, None), (7, 7)]


def test_fenced_json(spark):
    cases = {'```json\n{"a": 1}\n```': '{"a": 1}', '{"a": 2}': '{"a": 2}', 'so {"a": {"b": 3}} ok': '{"a": {"b": 3}}', "{bad": None, "[1]": "[1]"}
    df = spark.createDataFrame([(k,) for k in cases], "t STRING").select("t", tx.fenced_json(F.col("t")).alias("j"))
    assert {r.t: r.j for r in df.collect()} == cases


def test_levels_and_front_matter(spark):
    df = spark.createDataFrame([("12 级",), ("1 - 2 级",), ("info",), ("",), ("建造中",)], "t STRING")
    assert [r.v for r in df.select(tx.first_int(F.col("t")).alias("v")).collect()] == [12, 1, None, None, None]
    text = '﻿---\ntitle: "A: b"\nkey: 1\nkey: 2\nnot a key\n---\nbody: 3\n'
    fm = one(spark.createDataFrame([(text,)], "t STRING").select(tx.front_matter(F.col("t")).alias("m"))).m
    assert fm == {"title": "A: b", "key": "2"}


def test_top_bar_order_and_full_rule(spark):
    corner = lambda x, y: [(x, y), (x + 10, y), (x + 10, y + 8), (x, y + 8)]
    rows = [(1, "900", corner(300, 5)), (1, "1,000", corner(20, 5)), (1, "77", corner(600, 400)), (1, "Lv x", corner(1, 1)), (2, "5000", None), (2, "", None)]
    df = spark.createDataFrame(rows, "frame_id INT, text STRING, bbox ARRAY<STRUCT<x: INT, y: INT>>")
    frames = spark.createDataFrame([(1,), (2,), (3,)], "frame_id INT")
    got = {r.frame_id: (r.detected, r.gold, r.elixir, r.all_full) for r in
           ev.resource_status(frames, ev.top_bar(df, 100), {"gold": 1000, "elixir": 900, "dark_elixir": 1}).collect()}
    assert got == {1: (2, 1000, 900, True), 2: (1, 5000, 0, False), 3: (0, 0, 0, False)}


@pytest.mark.parametrize("large", [2, 1000])
def test_signal_points_of_a_crowded_frame(spark, large):
    names = ["圣水瓶", "金矿", "请求条目", "金币采集图标", "金矿", "请求条目", "黑油采集图标", "进攻按钮", None]
    rows = [(frame, no, n, no + 1, 3, no + 4, 5) for frame in (1, 2) for no, n in enumerate(names)]
    rows += [(3, 1, "金矿", -9, 3, 9, 5), (3, 2, "金矿", 2, 3, 4, 5)]
    df = spark.createDataFrame(rows, "frame_id INT, det_no INT, type STRING, x1 INT, y1 INT, x2 INT, y2 INT")
    out = ev.signal_points(df, 5, large)
    assert out.columns == ["frame_id", "kind", "place", "name", "resource", "x", "y"] and dict(out.dtypes)["place"] == "bigint"
    got = sorted(tuple(r) for r in out.collect())
    lists = [
        ("icon", 1, "金币采集图标", "gold", 5), ("icon", 2, "黑油采集图标", "dark_elixir", 8), ("request", 1, "请求条目", None, 4), ("request", 2, "请求条目", None, 7),
        ("target", 1, "金矿", "gold", 3), ("target", 2, "金矿", "gold", 6), ("target", 3, "圣水瓶", "elixir", 2),
    ]
    assert got == [(frame, *row, 4) for frame in (1, 2) for row in lists] + [(3, "target", 1, "金矿", "gold", 3, 4)]


def test_frame_signals_of_odd_boxes(spark):
    cls = lambda n: vocab.CLASSES.index(n)
    rows = [
        (1, 5, cls("进攻按钮"), 10, 20), (1, 2, cls("进攻按钮"), 30, 40), (1, 9, cls("圣水瓶"), 50, 60), (1, 8, cls("圣水瓶"), 70, 80),
        (1, 1, cls("请求条目"), 1, 1), (1, 3, cls("请求条目"), 1, 1), (2, 7, cls("储金罐"), 2, 3), (2, None, cls("储金罐"), 4, 5),
        (2, 1, cls("请求条目"), 1, 1), (2, 1, cls("金矿"), 0, 9), (2, 1, cls("金矿"), -3, 9), (3, 1, None, 2, 2), (9, 1, cls("金矿"), 1, 1),
        (4, 1 << 62, cls("暗黑重油罐"), (1 << 31) - 1, (1 << 31) - 1),
    ]
    boxes = spark.createDataFrame(rows, "frame_id INT, det_no LONG, class_id INT, x1 INT, y1 INT").withColumns({"x2": F.col("x1"), "y2": F.col("y1")})
    boxes = boxes.withColumns({k: F.col(k).cast("bigint") for k in ("x1", "y1", "x2", "y2")})
    frames = spark.createDataFrame([(1,), (2,), (3,), (4,)], "frame_id INT")
    df = ev.frame_signals(frames, boxes)
    got = {r.frame_id: (r.attack and tuple(r.attack), r.target and tuple(r.target), r.n_targets, r.n_requests, r.more_requests) for r in df.collect()}
    assert got == {
        1: ((30, 40), (cls("圣水瓶"), 70, 80), 2, 2, True), 2: (None, (cls("储金罐"), 4, 5), 2, 1, False),
        3: (None, None, 0, 0, None), 4: (None, (cls("暗黑重油罐"), (1 << 31) - 1, (1 << 31) - 1), 1, 0, None),
    }


def test_numbers_in_texts_are_read_once(spark):
    texts = ["Gold: 1,234", "金币 5 6", "ELIXIR 7 x 8", "圣水", "dark", "黑油: 99999999999999999999", "GOLD elixir 3", "x 4", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "det_no INT, text STRING").selectExpr("det_no AS frame_id", "det_no", "text", "CAST(NULL AS ARRAY<STRUCT<x: INT, y: INT>>) AS bbox")
    said = ev.spoken_resources(df.select("frame_id"), df)
    bar = ev.top_bar(df, 100)
    for out in (said, bar):
        assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp_") == 1
    got = {r.frame_id: (r.gold, r.elixir, r.dark_elixir) for r in said.collect()}
    want = {0: (1234, 0, 0), 1: (56, 0, 0), 2: (0, 7, 0), 6: (3, 0, 0)}
    assert got == {i: want.get(i, (0, 0, 0)) for i in range(len(texts))}
    assert {r.frame_id: (r.cx, r.cy, r.value) for r in bar.collect()} == {i: (0.0, 0.0, v) for i, v in {0: 1234, 1: 56, 2: 78, 6: 3, 7: 4}.items()}


def test_validator_order(spark):
    rows = [("fly", "金矿", 50, 50, None), ("tap", "金矿", None, None, None), ("tap", "金矿", 4, 50, None), ("deploy", "金矿", 50, 50, 1),
            ("tap", "金矿", 50, 50, 1), ("tap", None, 50, 50, None), ("wait", None, None, None, None), ("deploy", "金矿", 94, 50, None), ("tap", "金矿", 95, 50, None)]
    df = spark.createDataFrame(rows, "kind STRING, target STRING, x INT, y INT, troop_x INT").withColumn("troop_y", F.col("troop_x"))
    got = [(r.reason, r.risk) for r in sc.validate_actions(df, (100, 100)).collect()]
    assert got == [("kind", "high"), ("no_coords", "low"), ("out_of_bounds", "medium"), ("troop_out_of_bounds", "medium"), ("ok", "low"),
                   ("target", "medium"), ("ok", "low"), ("ok", "medium"), ("out_of_bounds", "medium")]


def test_loot_distances(spark):
    t = spark.createDataFrame([(i, i, "储金罐", 100, 100, None) for i in range(1, 6)], "frame_id INT, det_no INT, name STRING, x INT, y INT, defence_px DOUBLE")
    land = spark.createDataFrame([(1, 100, 100), (2, 220, 100), (3, 360, 100), (4, 361, 100)], "frame_id INT, x INT, y INT")
    walls = spark.createDataFrame([], "frame_id INT, x1 INT, y1 INT, x2 INT, y2 INT")
    points = t.select("frame_id", F.lit("target").alias("role"), "x", "y").unionByName(land.withColumn("role", F.lit("landable")))
    near = sc.with_neighbours(t.drop("defence_px"), points)
    got = {r.frame_id: (r.reason, r.walk_extra, r.troops_needed, r.expected_loot) for r in sc.estimate_loot(near, walls).collect()}
    assert got == {1: ("ok", 0, 4, 4000), 2: ("ok", 0, 4, 4000), 3: ("ok", 1, 5, 1400), 4: ("too_far", 1, 5, 1400), 5: ("no_landing", 0, 0, 0)}


def test_no_defences_is_neutral(spark):
    t = spark.createDataFrame([(1, 1, "金矿", 640, 710, None), (2, 1, "金矿", 640, 710, 0.0)], "frame_id INT, det_no INT, name STRING, x INT, y INT, defence_px DOUBLE")
    got = {r.frame_id: r.safety for r in sc.score_targets(t, (1280, 720)).collect()}
    assert got == {1: 0.5, 2: 0.0}


def test_verdict_kinds(spark):
    texts = ['"x"', "[1]", '{"approved": 1, "corrected_action": {"coords": [0.5, -0.1]}}', '{"approved": true', '{"corrected_action": {"coords": [640, 360]}}']
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, p STRING")
    got = [(r.error, r.coords and tuple(r.coords)) for r in te.parse_verdicts(df, "p", (100, 100), (1280, 720)).orderBy("i").collect()]
    assert got == [("not an object", None), ("not an object", None), (None, None), ("not an object", None), (None, (50, 50))]


def test_tables_and_notes(spark):
    text = "| a |\n|---|\n| 1 |\n<SmallTitle>T</SmallTitle>\n| b | c |\n| x | y |\n| d |\n|-|\n<SmallTitle>重要说明</SmallTitle>\n1. one\n* two <i>b</i>\nplain\n"
    df = spark.createDataFrame([(1, text)], "k INT, text STRING")
    got = [(r.label, r.headers, r.rows) for r in ct.tables(df, ["k"]).collect()]
    assert got == [("", ["a"], [["1"]]), ("T", ["d"], [])]
    assert [r.note for r in ct.notes(df, ["k"]).collect()] == ["one", "two b"]


def test_call_tables(spark):
    cell = lambda tag, x: f"a(`{tag}`,null,{x})"
    row = lambda *cells: cell("tr", "[" + ",".join(cells) + "]")
    table = lambda head, *rows: f"a(`table`,{{x:1}},[{cell('thead', head)},{cell('tbody', '[' + ','.join(rows) + ']')}])"
    plain = "t(`L`,1)," + table(cell("th", "[t(`a`,1),t(`b`,1)]"), row(cell("td", "`(1`"), cell("td", "`<i>x</i>  y`")), row())
    inner = table(cell("th", "`in`"), row(cell("td", "`2`")))
    texts = [
        (1, plain), (1, plain), (2, None), (3, ""), (4, "))" + plain + ",t(`M`)," + inner), (5, "a(`table`,null,[a(`thead`,null,a(`th`,null,`u`)),a(`tbody`"),
        (6, f"t(`O`),a(`table`,null,[{cell('tbody', row(cell('td', '[t(`o`),' + inner + ']')))}])"), (7, "a(`table`,null,[" + inner + ",t(`x`)"), (8, "a(`table`)"),
        (9, "t(`never closed"), (10, table(cell("th", "{y:`z`}"), row(cell("td", "``")))),
    ]
    df = spark.createDataFrame(texts, "k INT, chunk STRING")
    got = sorted((r.k, r.table_no, r.label, r.headers, r.rows) for r in ct.call_tables(df, "k", "chunk").collect())
    first = ("L", ["ab"], [["(1", "x y"]])
    assert got == [
        (1, 0, *first), (1, 0, *first), (4, 0, *first), (4, 1, "M", ["in"], [["2"]]),
        # the outer table has no head of its own, so that of the table in its cell is the first
        (6, 0, "O", ["in"], [["o"] + ["2"], ["2"]]), (6, 1, "o", ["in"], [["2"]]), (7, 0, "", ["in"], [["2"]]), (8, 0, "", [], []), (10, 0, "", [""], [[""]]),
    ]
    assert "Python" not in ct.call_tables(df, "k", "chunk")._jdf.queryExecution().toString()


def test_discovery(spark):
    paths = ["a/x.py", "build/x.py", "a/x.txt", "x.egg-info/y.c", "a/y.egg-info", "v/node_modules/z.h", "a/x.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path STRING")
    got = {r.path: r.language for r in au.discover(df).collect()}
    assert got == {"a/x.py": "python", "x.egg-info/y.c": "c/c++"}
    assert {r.path for r in au.discover(df, include=["x.egg-info"], exclude=[]).collect()} == {"x.egg-info/y.c"}


def test_call_arguments(spark):
    texts = ['a, f(b, "c)"), d); x', "", ")", "a, b", 'x, "open', "(((a, b))), c)"]
    rows = spark.createDataFrame([(t,) for t in texts], "rest STRING").select(au.call_arguments(F.col("rest"))).collect()
    assert [r[0] for r in rows] == [["a", ' f(b, "c)")', " d"], [], [], ["a"], ["x"], ["(((a, b)))", " c"]]


def findings(spark, source, language):
    files = spark.createDataFrame([("f", language, source)], "path STRING, language STRING, content STRING")
    return sorted(tuple(r)[1:] for r in au.audit(files).collect())


def test_c_rules(spark):
    source = "int f(void) {\n  char *a = malloc(1);\n  char *b = malloc(1);\n  free(a);\n  use(a);\n  free(b);\n  free(b);\n}\n"
    assert findings(spark, source, "c/c++") == [
        ("c-double-free", "CRITICAL", 7, 2), ("c-memory-leak", "MEDIUM", 2, 0), ("c-use-after-free", "CRITICAL", 5, 0)
    ]


def test_c_functions_and_renewal(spark):
    # a nested block, a header-like line inside, a renewed pointer, two frees in a line, an open end
    source = (
        "int f(int n) {\n  p = malloc(1);\n  if (n) {\n    free(p);\n  }\n  else if (x) {\n    p = malloc(2);\n  }\n}\n"
        "free(p); free(p);\nvoid g(void) {\n  q = strdup(s); free(q); free(q);\n  r = malloc(3);\n"
    )
    assert findings(spark, source, "c/c++") == [("c-double-free", "CRITICAL", 12, 26), ("c-memory-leak", "MEDIUM", 2, 0)]


def test_lines_are_counted_alike(spark):
    source = "int a;\x0cint b;\r\ngets(x);\nprintf(u);\rvoid f(void) {\n  char *z = malloc(3);\n}\n"
    assert findings(spark, source, "c/c++") == [("c-format-string", "HIGH", 4, 0), ("c-memory-leak", "MEDIUM", 6, 0), ("c-unsafe-api-gets", "CRITICAL", 3, 0)]


def test_python_rules_scope(spark):
    source = "import os as o\no.system('x')\ndef f():\n    h = open('a')\n    with open('b') as h:\n        pass\nasync def g():\n    k = open('a')\n"
    assert findings(spark, source, "python") == [("python-dangerous-os-system", "CRITICAL", 2, 0), ("python-resource-leak", "MEDIUM", 7, 0)]


def test_files_are_read_once_by_a_rule(spark):
    files = spark.createDataFrame([("f", "python", "def f():\n    h = open('a')\n")], "path STRING, language STRING, content STRING")
    plan = au.rule_findings(au.syntax_facts(files))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapIn") == 1
    # an assignment to what is never released decides nothing
    source = "void f(void) {\n  char *a = malloc(1); // b = 1\n  n = 2;\n  free(a);\n  a = 0;\n}\nint g(void)\nint h(int i) { return i; }\n"
    c = spark.createDataFrame([("f", "c/c++", source), ("g", "c/c++", "int f(void) {\n  n = 2;\n}\n")], "path STRING, language STRING, content STRING")
    events = au.memory_events(c).select("var", "line", "kind").collect()
    assert sorted(map(tuple, events)) == [("a", 2, 1), ("a", 2, 4), ("a", 4, 2), ("a", 5, 4)]


def test_deep_sources_are_findings(spark):
    assert [f[0] for f in findings(spark, "x = " + "(" * 5000 + ")" * 5000, "python")] == ["python-syntax-error"]
    chain = findings(spark, "x = " + "+".join(["eval(1)"] * 3000), "python")
    assert {f[0] for f in chain} <= {"python-dangerous-eval", "python-syntax-error"} and chain
    assert findings(spark, None, "python") == [("audit-read-error", "INFO", 0, 0)]


def test_gate_limits(spark):
    f = spark.createDataFrame([("p", "r", "HIGH", 1, 0)], au.FINDING_SCHEMA)
    got = {r.severity: (r.n, r.over_limit, r.at_threshold) for r in au.gate(f, au.gate_config({"max_high": 1})).collect()}
    assert got["HIGH"] == (1, False, True) and got["CRITICAL"] == (0, False, False) and len(got) == 5
    with pytest.raises(ValueError):
        au.gate_config({"severity_threshold": "loud"})


def test_file_readers(spark, tmp_path):
    s = tmp_path / "s" / "one"
    s.mkdir(parents=True)
    (s / "session_summary.json").write_text("{}")
    (s / "step_0001_local.json").write_text(json.dumps({"step": 1, "state": "搜索中", "detections": [{"type": "金矿", "bbox": [1, 2, 3, 4]}]}))
    (s / "step_0001_coach.json").write_text(json.dumps({"approved": False, "corrected_state": "战斗中"}))
    (s / "step_0002_local.json").write_text(json.dumps({"step": 2, "state": ""}))
    other = tmp_path / "s" / "two"
    other.mkdir()
    (other / "step_0001_local.json").write_text("{}")
    got = {(r.session, r.step_file): r.corrected_state for r in files.step_pairs(spark, str(tmp_path / "s")).collect()}
    assert got == {("one", "step_0001"): "战斗中", ("one", "step_0002"): None}
    lab = tmp_path / "labels" / "val"
    lab.mkdir(parents=True)
    (lab / "f1.txt").write_text("1 0.5 0.5 0.1 0.1\nbad\n")
    rows = files.label_lines(spark, str(tmp_path / "labels")).collect()
    assert {(r.stem, r.split) for r in rows} == {("f1", "val")} and len(rows) == 2
    smp = tmp_path / "samples"
    smp.mkdir()
    for n, raw, img in (("a", '{"image": "a.jpg"}', b"x"), ("b", '{"image": "b.jpg"}', b"x"), ("c", '{"image', None), ("d", '{"image": ""}', None), ("e", '{"image": "e.jpg"}', None)):
        (smp / f"{n}.json").write_text(raw)
        if img:
            (smp / f"{n}.jpg").write_bytes(img)
    fate = te.sample_fate(files.teacher_samples(spark, str(smp)).withColumn("n_boxes", F.lit(1)))
    assert {r.name: r.fate for r in fate.collect()} == {"a": "converted", "b": "overlap", "c": "corrupt", "d": "no_image", "e": "mismatch"}
    (tmp_path / "m.json").write_text('{"0": "x", "10": "y"}')
    assert {r.class_id: r.class_name for r in files.label_map(spark, str(tmp_path / "m.json")).collect()} == {0: "x", 10: "y"}
    src = tmp_path / "src" / "pkg"
    src.mkdir(parents=True)
    (src / "a.py").write_text("eval(x)\n")
    found = au.discover(files.source_files(spark, str(tmp_path / "src")))
    assert [(r.path, r.rule_id) for r in au.syntax_findings(found).collect()] == [("pkg/a.py", "python-dangerous-eval")]
    assert [r.path for r in files.listing(spark, str(tmp_path / "src")).collect()] == ["pkg/a.py"]
    (tmp_path / "9-x.md").write_text("﻿hello")
    assert [(r.link, r.text) for r in files.pages(spark, str(tmp_path)).collect()] == [("9-x", "hello")]


def test_vocabulary():
    assert len(vocab.CLASSES) == 17 and len(vocab.DEFENCES) == 22 and vocab.CLASSES[6] == "进攻按钮"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_front_matter_is_read_once(spark):
    df = spark.createDataFrame([('---\na: "x"\nb: "\nc: y z \na: ""\n---\n',)], "t STRING").select(tx.front_matter(F.col("t")).alias("m"))
    assert one(df).m == {"a": "", "b": '"', "c": "y z"}
    assert plan_of(df.withColumn("n", F.size("m"))).count("split(") == 1


def test_tokens_of_calls_stay_where_their_row_is(spark):
    pages = spark.createDataFrame([("k", "a(`table`,null,[])")], "k STRING, text STRING")
    assert "ENSURE_REQUIREMENTS" not in ct.call_tables(pages, "k", "text")._jdf.queryExecution().executedPlan().toString()


def test_cube_keeps_no_set_of_frames(spark):
    assert "count(distinct" not in plan_of(all_queries()["ag17_split_class_cube"](spark, "/root/testdata/sf0.001"))


def test_estimates_look_for_neighbours_once(spark):
    assert "collect_set(" not in plan_of(all_queries()["so2_loot_estimate"](spark, "/root/testdata/sf0.001"))
