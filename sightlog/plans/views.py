"""Adapter views in plain SQL, used as CTEs by the reference SQL of the queries."""

from __future__ import annotations

from sightlog import vocab


def values_cte(name: str, columns: str, rows) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS {name}_v({columns})"


def case(key: str, mapping: dict, default: str = "NULL") -> str:
    def lit(v):
        return "'" + v + "'" if isinstance(v, str) else (f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v))

    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"CASE {key} {whens} ELSE {default} END"


NAME = case("class_id", dict(enumerate(vocab.CLASSES)))

VIEWS: dict[str, str] = {
    "det": """SELECT l_orderkey AS frame_id,
  CAST(l_linenumber AS BIGINT) * 1000000000000000000 + (l_partkey * 1000003 + l_suppkey) * 50 + CAST(l_quantity AS INT) - 1 AS det_no,
  CAST(l_partkey % 17 AS INT) AS class_id,
  CAST(100 - 9*CAST(round(l_discount*100) AS INT) AS DOUBLE)/CAST(100 AS DOUBLE) AS confidence,
  CAST((l_suppkey*131+l_partkey*17)%1180 AS INT) AS x1,
  CAST((l_partkey*29+l_suppkey*7)%640 AS INT) AS y1,
  CAST((l_suppkey*131+l_partkey*17)%1180 AS INT)+20+2*CAST(l_quantity AS INT) AS x2,
  CAST((l_partkey*29+l_suppkey*7)%640 AS INT)+20+2*CAST(l_quantity AS INT) AS y2,
  CASE l_returnflag WHEN 'R' THEN 'ocr' WHEN 'N' THEN 'llm' ELSE 'local' END AS source
FROM lineitem""",
    "named": f"SELECT *, {NAME} AS type FROM det",
    "frames": """SELECT o_orderkey AS frame_id, o_custkey AS session_id, o_orderdate AS ts, 1280 AS w, 720 AS h,
  CASE WHEN o_orderkey % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM orders""",
    "truth": """SELECT o_orderkey AS frame_id,
  CASE o_orderkey % 6 WHEN 0 THEN '村庄待机' WHEN 1 THEN '搜索中' WHEN 2 THEN '战斗中'
    WHEN 3 THEN '战斗结束' WHEN 4 THEN '捐兵-消息列表' ELSE NULL END AS expected_state,
  o_orderkey % 6 = 0 AS exp_attack, o_orderkey % 6 = 1 AS exp_search, o_orderkey % 6 = 2 AS exp_end,
  o_orderkey % 12 = 2 AS exp_next, o_orderkey % 6 = 3 AS exp_return FROM orders""",
    "steps": """SELECT user_id AS session_id, event_id, ts, event_type, value AS amount,
  event_type='click' AS attack, event_type='view' AND value < 60 AS search, event_type='view' AND value >= 60 AS next_b,
  event_type='signup' AS return_b, event_type='error' AS end_b,
  CASE WHEN event_type='purchase' THEN 1 + CAST(floor(value/50) AS INT) ELSE 0 END AS n_targets FROM events""",
    "local_step": """SELECT conv_id AS session_id, CAST(floor(turn/2) AS BIGINT) AS step_no,
  CAST(length(text) % 7 AS INT) AS state_id, length(text) % 4 <> 0 AS executed FROM conversations WHERE role='user'""",
    "teacher_step": """SELECT conv_id AS session_id, CAST(floor(turn/2) AS BIGINT) AS step_no, length(text) % 3 <> 0 AS approved,
  CASE WHEN length(text) % 5 = 0 THEN NULL ELSE CAST(length(text) % 6 AS INT) END AS corrected_id
  FROM conversations WHERE role='assistant'""",
    "targets": f"""SELECT frame_id, det_no, class_id, confidence, (x1+x2)//2 AS x, (y1+y2)//2 AS y, {NAME} AS name
  FROM det WHERE class_id < 6""",
    "defences": "SELECT frame_id, (x1+x2)//2 AS x, (y1+y2)//2 AS y FROM det WHERE class_id IN (6,7,8,9)",
    "landable": "SELECT frame_id, (x1+x2)//2 AS x, (y1+y2)//2 AS y FROM det WHERE class_id >= 12",
    "walls": "SELECT frame_id, det_no AS wall_no, x1, y1, x2, y2 FROM det WHERE class_id IN (10,11)",
    "actions": """SELECT frame_id, det_no, CASE class_id % 5 WHEN 0 THEN 'tap' WHEN 1 THEN 'deploy' WHEN 2 THEN 'wait'
    WHEN 3 THEN 'stop' ELSE 'swipe' END AS kind, class_id AS target_id,
  CASE WHEN det_no % 9 = 0 THEN NULL ELSE x2 END AS x, CASE WHEN det_no % 9 = 0 THEN NULL ELSE y2 END AS y,
  CASE WHEN det_no % 4 = 0 THEN x2 - 40 END AS troop_x, CASE WHEN det_no % 4 = 0 THEN y2 + 30 END AS troop_y,
  CASE WHEN det_no % 11 = 0 THEN NULL ELSE class_id END AS listed_id FROM det""",
    "ocr": """SELECT frame_id, det_no,
  CASE class_id WHEN 0 THEN concat('Gold: ', x1, ',', lpad(CAST(y1 AS VARCHAR), 3, '0'))
    WHEN 1 THEN concat('金币 ', x1) WHEN 2 THEN concat('Elixir ', x1, ' ', y1)
    WHEN 3 THEN concat('圣水', y1) WHEN 4 THEN concat('dark ', x1) WHEN 5 THEN concat('黑油: ', y1)
    WHEN 6 THEN '点击进攻' WHEN 7 THEN 'Go back' WHEN 8 THEN '搜索对手' WHEN 9 THEN 'next >'
    WHEN 10 THEN '结束战斗' WHEN 11 THEN 'donate' WHEN 12 THEN '消息列表' WHEN 13 THEN concat('Lv ', x1 % 17)
    WHEN 14 THEN '关闭' WHEN 15 THEN '确认' ELSE 'x' END AS text,
  confidence, x1, y1, x2, y2 FROM det""",
    "class_dim": values_cte("class_dim", "class_id, class_name", enumerate(vocab.CLASSES)),
}

NEEDS = {
    "named": ["det"],
    "targets": ["det"],
    "defences": ["det"],
    "landable": ["det"],
    "walls": ["det"],
    "actions": ["det"],
    "ocr": ["det"],
}


def expand_r6(sql: str) -> str:
    """``r6(x)`` stands for x rounded to six decimals, halves to even, by the same two operations in any engine."""
    while "r6(" in sql:
        i = sql.index("r6(")
        depth, j = 1, i + 3
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        sql = f"{sql[:i]}(round_even(CAST({sql[i + 3:j - 1]} AS DOUBLE) * 1e6, 0) / 1e6){sql[j:]}"
    return sql


def with_views(names: list[str], sql: str) -> str:
    """Prefix ``sql`` with the CTEs it names; ``sql`` may go on with CTEs of its own
    by starting with a comma-free ``name AS (...)`` list and the word WITH."""
    order: list[str] = []

    def need(n):
        for d in NEEDS.get(n, []):
            need(d)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    body = expand_r6(sql.strip())
    if not ctes:
        return body
    low = body[:15].upper()
    if low.startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[14:]}"
    if low.startswith("WITH"):
        return f"WITH {ctes},\n{body[4:]}"
    return f"WITH {ctes}\n{body}"
