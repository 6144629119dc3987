"""Queries that run as streams over the event and document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightlog.operators import machines as ma
from sightlog.plans import replay_queries as rq
from sightlog.plans.registry import ORACLES, query
from sightlog.streaming import streams as st

STEP_COLS = """event_type = 'click' AS attack;event_type = 'view' AND value < 60 AS search;event_type = 'view' AND value >= 60 AS next_b;
event_type = 'signup' AS return_b;event_type = 'error' AS end_b;CASE WHEN event_type = 'purchase' THEN 1 + CAST(floor(value / 50) AS INT) ELSE 0 END AS n_targets;
value >= 489 AS all_full;CASE WHEN event_type = 'purchase' AND value < 20 THEN false END AS worth"""


def steps(spark, sf):
    e = st.table_stream(spark, sf, "events")
    return e.selectExpr(
        "user_id AS session_id", "event_id", "CAST(ts AS TIMESTAMP) AS ts", "event_type", "value AS amount", *STEP_COLS.split(";")
    )


def to_the_end(spark, sf, name: str, replay, *extra: str):
    """A replay of the events as a stream that is told of its source's end, so every row comes out."""
    end = st.End(spark, name)
    return st.run_to_table(replay(end.joined(steps(spark, sf).selectExpr("*", *extra))), name, end)


@query("st1_battle_stream", rq.BATTLE, "steps")
def battle_stream(spark, sf):
    return to_the_end(spark, sf, "battle", lambda s: st.machine_stream(s, "session_id", ma.battle_machine()))


@query("st2_donation_stream", ORACLES["st2_donation_replay"])
def donation_stream(spark, sf):
    signals = [c.strip() for c in rq.DON.replace("\n", " ").split(",")]
    return to_the_end(spark, sf, "donation", lambda s: st.machine_stream(s, "session_id", ma.donation_machine()), *signals)


@query("st3_farm_stream", ORACLES["st3_farm_replay"])
def farm_stream(spark, sf):
    return to_the_end(spark, sf, "farm", lambda s: st.machine_stream(s, "session_id", ma.farm_machine()))


@query("st6_gate_stream", f"WITH {rq.GATE} SELECT session_id, event_id, flagged FROM g", "steps")
def gate_stream(spark, sf):
    return to_the_end(spark, sf, "gate", lambda s: st.gate_stream(s, "session_id", "amount", 20, 100))


def routes(spark, sf):
    """Route and token cost of each event, as a stream."""
    return st.table_stream(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type").isin("error", "purchase"), "llm").otherwise("local").alias("route"),
        (500 + F.col("event_id") % 100).alias("prompt_tokens"), (F.col("event_id") % 40).alias("completion_tokens"),
    )


@query(
    "st7_counter_stream",
    """WITH l AS (SELECT ts, CASE WHEN event_type IN ('error', 'purchase') THEN 'llm' ELSE 'local' END AS route, 500 + CAST(event_id % 100 AS BIGINT) AS p, CAST(event_id % 40 AS BIGINT) AS c FROM events),
w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS total, count(*) FILTER (route <> 'llm') AS local, count(*) FILTER (route = 'llm') AS llm,
  coalesce(sum(p) FILTER (route = 'llm'), 0) AS prompt_tokens, coalesce(sum(c) FILTER (route = 'llm'), 0) AS completion_tokens FROM l GROUP BY 1)
SELECT start, CAST(total AS BIGINT) AS total, CAST(local AS BIGINT) AS local, CAST(llm AS BIGINT) AS llm, CAST(prompt_tokens AS BIGINT) AS prompt_tokens, CAST(completion_tokens AS BIGINT) AS completion_tokens,
  round(llm / total, 4) AS llm_ratio FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def counter_stream(spark, sf):
    out = st.run_to_table(st.route_counters(routes(spark, sf), "1 hour", "1 hour"), "counters")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).drop("end")


@query(
    "st7_sliding_stream",
    """WITH l AS (SELECT CASE WHEN event_type IN ('error', 'purchase') THEN 'llm' ELSE 'local' END AS route, 500 + CAST(event_id % 100 AS BIGINT) AS p, CAST(event_id % 40 AS BIGINT) AS c,
  unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events),
w AS (SELECT start, count(*) AS total, count(*) FILTER (route <> 'llm') AS local, count(*) FILTER (route = 'llm') AS llm,
  coalesce(sum(p) FILTER (route = 'llm'), 0) AS prompt_tokens, coalesce(sum(c) FILTER (route = 'llm'), 0) AS completion_tokens FROM l GROUP BY 1)
SELECT start, CAST(total AS BIGINT) AS total, CAST(local AS BIGINT) AS local, CAST(llm AS BIGINT) AS llm, CAST(prompt_tokens AS BIGINT) AS prompt_tokens, CAST(completion_tokens AS BIGINT) AS completion_tokens,
  round(llm / total, 4) AS llm_ratio FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def sliding_stream(spark, sf):
    out = st.run_to_table(st.route_counters(routes(spark, sf), "1 hour", "1 hour", "30 minutes"), "sliding")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).drop("end")


@query(
    "st8_session_stream",
    """WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM steps WINDOW w AS (PARTITION BY session_id ORDER BY event_id)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY event_id) AS run FROM s),
a AS (SELECT session_id, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS closed, CAST(count(*) AS BIGINT) AS total_steps, CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS executed,
  CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS corrected FROM i GROUP BY session_id, run)
SELECT * FROM a WHERE closed <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    "steps",
)
def session_stream(spark, sf):
    out = st.run_to_table(st.session_summaries(steps(spark, sf), "session_id", "6 hours", "1 hour"), "sessions")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "closed")})


@query("st9_content_stream", "SELECT DISTINCT sha256(text) AS digest FROM documents")
def content_stream(spark, sf):
    d = st.table_stream(spark, sf, "documents").select(
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 86400).alias("ts"), "text"
    )
    return st.run_to_table(st.first_contents(d, "text", "2 days").select("digest"), "contents")
