"""DuckDB SQL equal to each registered query, over the driver's views.

``EV`` maps the ``events`` view onto the event record the same way the
Spark adapter does (``value`` truncated, ``produced_at`` floored to ms,
``event_time`` at ms precision).  Window starts are epoch-aligned integer
arithmetic on microseconds, as in Spark's ``window``.
"""

from __future__ import annotations

EV = """ev AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, event_type,
         'user_' || CAST(user_id AS VARCHAR) AS key,
         CAST(trunc(value) AS INTEGER) AS value,
         epoch_us(ts) // 1000 AS produced_at,
         make_timestamp(epoch_us(ts) // 1000 * 1000) AS event_time,
         epoch_us(ts) // 1000 * 1000 AS t_us
  FROM events)"""

MIN_US = 60_000_000
HOUR_US = 3_600_000_000
DAY_US = 86_400_000_000


def _tumble(width_us: int, agg: str, extra_where: str = "") -> str:
    return f"""WITH {EV},
w AS (SELECT key, t_us // {width_us} * {width_us} AS ws, value FROM ev)
SELECT key, make_timestamp(ws) AS window_start, make_timestamp(ws + {width_us}) AS window_end,
       {agg}
FROM w {extra_where} GROUP BY key, ws"""


def _slide(size_us: int, slide_us: int) -> str:
    k = size_us // slide_us
    return f"""WITH {EV},
w AS (SELECT key, t_us // {slide_us} * {slide_us} - i * {slide_us} AS ws, value
      FROM ev, range(0, {k}) r(i))
SELECT key, make_timestamp(ws) AS window_start, make_timestamp(ws + {size_us}) AS window_end,
       round(avg(value), 2) AS avg_value, count(*) AS event_count
FROM w GROUP BY key, ws"""


PASSTHROUGH = f"""WITH {EV}
SELECT event_id AS key,
       CAST(json_object('event_id', event_id, 'event_type', event_type, 'key', key,
                        'value', value, 'produced_at', produced_at) AS VARCHAR) AS value
FROM ev WHERE event_type IN ('click', 'purchase')"""

TUMBLING = _tumble(MIN_US, "count(*) AS event_count")

TUMBLING_APPEND = f"""WITH {EV},
wm AS (SELECT max(t_us) - 10000000 AS wm FROM ev),
w AS (SELECT key, t_us // {MIN_US} * {MIN_US} AS ws FROM ev)
SELECT key, make_timestamp(ws) AS window_start, make_timestamp(ws + {MIN_US}) AS window_end,
       count(*) AS event_count
FROM w WHERE ws + {MIN_US} <= (SELECT wm FROM wm) GROUP BY key, ws"""

SLIDING = _slide(5 * MIN_US, MIN_US)
SLIDING_DOCS = _slide(2 * MIN_US, 30_000_000)

STATS = _tumble(HOUR_US, """count(*) AS event_count, CAST(sum(value) AS BIGINT) AS sum_value,
       min(value) AS min_value, max(value) AS max_value, round(avg(value), 4) AS avg_value""")

ORACLE: dict[str, str] = {
    "passthrough_filter": PASSTHROUGH,
    "passthrough_stream": PASSTHROUGH,
    "tumbling_count": TUMBLING,
    "tumbling_count_stream": TUMBLING,
    "tumbling_count_append_stream": TUMBLING_APPEND,
    "sliding_avg": SLIDING,
    "sliding_avg_docs": SLIDING_DOCS,
    "sliding_panes_avg": SLIDING,
    "sliding_avg_stream": SLIDING,
    "windowed_stats": STATS,
}


# ── per-key state ─────────────────────────────────────────────────────────
W_KEY = "PARTITION BY key ORDER BY t_us, event_id"

RUNNING_COUNT = f"WITH {EV} SELECT key, count(*) AS running_count FROM ev GROUP BY key"

RUNNING_PER_RECORD = f"""WITH {EV}
SELECT key, event_id, make_timestamp(t_us) AS event_time,
       row_number() OVER ({W_KEY}) AS running_count
FROM ev"""

RUNNING_LAST_TYPE = f"""WITH {EV},
r AS (SELECT key, event_type,
             row_number() OVER (PARTITION BY key ORDER BY t_us DESC, event_id DESC) AS rn
      FROM ev)
SELECT key, count(*) AS running_count,
       max(CASE WHEN rn = 1 THEN event_type END) AS last_event_type
FROM r GROUP BY key"""

RUNNING_SUM = f"""WITH {EV}
SELECT key, event_id, make_timestamp(t_us) AS event_time,
       CAST(sum(value) OVER ({W_KEY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
            AS BIGINT) AS running_sum
FROM ev"""

RECENT_LIST = f"""WITH {EV},
r AS (SELECT key, event_id, t_us,
             row_number() OVER (PARTITION BY key ORDER BY t_us DESC, event_id DESC) AS rn
      FROM ev)
SELECT key, string_agg(event_id, ',' ORDER BY t_us, event_id) AS recent,
       count(*) AS n_recent
FROM r WHERE rn <= 3 GROUP BY key"""

TYPE_MAP = f"""WITH {EV}
SELECT key, event_type, count(*) AS type_count FROM ev GROUP BY key, event_type"""

FOLD_STATE = f"""WITH {EV}
SELECT key, max(value) AS max_value, round(avg(value), 4) AS avg_value,
       count(*) AS event_count
FROM ev GROUP BY key"""

GAP6H = 6 * HOUR_US
INACTIVITY = f"""WITH {EV},
n AS (SELECT key, t_us, lead(t_us) OVER ({W_KEY}) AS nxt FROM ev),
wm AS (SELECT max(t_us) - 10000000 AS wm FROM ev)
SELECT key, make_timestamp(t_us) AS last_event_time,
       make_timestamp(t_us + {GAP6H}) AS alert_time
FROM n
WHERE (nxt IS NOT NULL AND nxt - t_us > {GAP6H})
   OR (nxt IS NULL AND t_us + {GAP6H} <= (SELECT wm FROM wm))"""


def _inactivity_stream(delay_us: int) -> str:
    """An alert leaves once the final watermark has reached it."""
    return f"""WITH {EV},
n AS (SELECT key, t_us, lead(t_us) OVER ({W_KEY}) AS nxt FROM ev)
SELECT key, make_timestamp(t_us) AS last_event_time,
       make_timestamp(t_us + {GAP6H}) AS alert_time
FROM n WHERE (nxt IS NULL OR nxt - t_us > {GAP6H})
         AND t_us + {GAP6H} <= (SELECT max(t_us) - {delay_us} FROM ev)"""


FUNNEL = f"""WITH RECURSIVE {EV},
r AS (SELECT key, event_type, row_number() OVER ({W_KEY}) AS rn FROM ev),
st(key, rn, stage, completed) AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT) FROM r
  UNION ALL
  SELECT st.key, st.rn + 1,
         CASE WHEN st.stage = 0 AND r.event_type = 'view' THEN 1
              WHEN st.stage = 1 AND r.event_type = 'click' THEN 2
              WHEN st.stage = 2 AND r.event_type = 'purchase' THEN 0
              ELSE st.stage END,
         st.completed + CASE WHEN st.stage = 2 AND r.event_type = 'purchase' THEN 1 ELSE 0 END
  FROM st JOIN r ON r.key = st.key AND r.rn = st.rn + 1)
SELECT key, CAST(arg_max(stage, rn) AS INTEGER) AS stage, max(completed) AS completed
FROM st GROUP BY key"""

CO_BOUND_US = HOUR_US
CO_PROCESS = f"""WITH {EV},
u AS (SELECT key, event_id, t_us, event_type = 'view' AS is_view
      FROM ev WHERE event_type IN ('view', 'click')),
s AS (SELECT *,
        last_value(CASE WHEN is_view THEN event_id END IGNORE NULLS) OVER w AS vid,
        last_value(CASE WHEN is_view THEN t_us END IGNORE NULLS) OVER w AS vt
      FROM u
      WINDOW w AS ({W_KEY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT key, event_id AS click_id, make_timestamp(t_us) AS click_time,
       CASE WHEN t_us - vt <= {CO_BOUND_US} THEN vid END AS view_id,
       CASE WHEN t_us - vt <= {CO_BOUND_US} THEN make_timestamp(vt) END AS view_time
FROM s WHERE NOT is_view"""

GAP2H = 2 * HOUR_US


def _sessions(closed_only: bool, delay_us: int = 10000000) -> str:
    where = (f"HAVING max(t_us) + {GAP2H} <= (SELECT max(t_us) - {delay_us} FROM ev)"
             if closed_only else "")
    return f"""WITH {EV},
f AS (SELECT key, t_us, event_id,
             CASE WHEN lag(t_us) OVER ({W_KEY}) IS NULL
                    OR t_us - lag(t_us) OVER ({W_KEY}) > {GAP2H} THEN 1 ELSE 0 END AS new
      FROM ev),
s AS (SELECT key, t_us, sum(new) OVER ({W_KEY} ROWS UNBOUNDED PRECEDING) AS sid FROM f)
SELECT key, make_timestamp(min(t_us)) AS session_start,
       make_timestamp(max(t_us) + {GAP2H}) AS session_end, count(*) AS event_count
FROM s GROUP BY key, sid {where}"""


ORACLE.update({
    "running_count": RUNNING_COUNT,
    "running_count_stream": RUNNING_COUNT,
    "running_count_state_stream": RUNNING_COUNT,
    "running_count_per_record": RUNNING_PER_RECORD,
    "running_count_per_record_stream": RUNNING_PER_RECORD,
    "running_last_type": RUNNING_LAST_TYPE,
    "running_last_type_stream": RUNNING_LAST_TYPE,
    "running_sum": RUNNING_SUM,
    "recent_list": RECENT_LIST,
    "recent_list_stream": RECENT_LIST,
    "type_map": TYPE_MAP,
    "type_map_stream": TYPE_MAP,
    "fold_state": FOLD_STATE,
    "fold_state_stream": FOLD_STATE,
    "inactivity_alerts": INACTIVITY,
    "inactivity_alerts_stream": _inactivity_stream(10000000),
    "inactivity_alerts_ooo_stream": _inactivity_stream(48 * HOUR_US),
    "manual_sessions_ooo_stream": _sessions(True, 48 * HOUR_US),
    "running_last_type_ooo_stream": RUNNING_LAST_TYPE,
    "recent_list_ooo_stream": RECENT_LIST,
    "funnel_states": FUNNEL,
    "funnel_states_stream": FUNNEL,
    "co_process": CO_PROCESS,
    "co_process_stream": CO_PROCESS,
    "co_process_ooo_stream": CO_PROCESS,
    "sessions": _sessions(False),
    "sessions_stream": _sessions(True),
    "manual_sessions_stream": _sessions(True),
})


# ── joins ──────────────────────────────────────────────────────────────────
ENRICH = f"""WITH {EV},
dim AS (SELECT 'user_' || CAST(c.c_custkey AS VARCHAR) AS key, c.c_name, c.c_mktsegment, n.n_name
        FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)
SELECT ev.event_id, ev.key, ev.event_type, dim.c_name, dim.c_mktsegment, dim.n_name
FROM ev LEFT JOIN dim ON ev.key = dim.key"""

SIDES = """v AS (SELECT key, event_id AS view_id, t_us AS vt FROM ev WHERE event_type = 'view'),
c AS (SELECT key, event_id AS click_id, t_us AS ct FROM ev WHERE event_type = 'click')"""


def _interval(how: str) -> str:
    return f"""WITH {EV}, {SIDES}
SELECT v.key, view_id, make_timestamp(vt) AS view_time, click_id,
       make_timestamp(ct) AS click_time
FROM v {how} JOIN c ON v.key = c.key AND ct >= vt AND ct <= vt + {HOUR_US}"""


# Stream left outer join: an unmatched view is emitted once the query's
# watermark (minimum over both inputs of max time − 10 s) passes view + bound.
INTERVAL_LEFT_STREAM = f"""WITH {EV}, {SIDES},
wm AS (SELECT least((SELECT max(vt) FROM v), (SELECT max(ct) FROM c)) - 10000000 AS wm),
j AS (SELECT v.key, view_id, vt, click_id, ct
      FROM v LEFT JOIN c ON v.key = c.key AND ct >= vt AND ct <= vt + {HOUR_US})
SELECT key, view_id, make_timestamp(vt) AS view_time, click_id,
       make_timestamp(ct) AS click_time
FROM j WHERE click_id IS NOT NULL OR vt + {HOUR_US} < (SELECT wm FROM wm)"""

WINDOW_JOIN = f"""WITH {EV},
v AS (SELECT key, t_us // {HOUR_US} * {HOUR_US} AS ws, count(*) AS left_count
      FROM ev WHERE event_type = 'view' GROUP BY ALL),
c AS (SELECT key, t_us // {HOUR_US} * {HOUR_US} AS ws, count(*) AS right_count
      FROM ev WHERE event_type = 'click' GROUP BY ALL)
SELECT coalesce(v.key, c.key) AS key, make_timestamp(coalesce(v.ws, c.ws)) AS window_start,
       make_timestamp(coalesce(v.ws, c.ws) + {HOUR_US}) AS window_end,
       coalesce(left_count, 0) AS left_count, coalesce(right_count, 0) AS right_count,
       (left_count IS NOT NULL AND right_count IS NOT NULL) AS joined
FROM v FULL OUTER JOIN c ON v.key = c.key AND v.ws = c.ws"""

# ── dedup, collapse, modes, union ──────────────────────────────────────────
DEDUP = f"WITH {EV} SELECT event_id, event_type, key, value, produced_at FROM ev"

LATEST = f"""WITH {EV},
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t_us DESC, event_id DESC) AS rn
      FROM ev)
SELECT key, event_id, event_type, make_timestamp(t_us) AS event_time FROM r WHERE rn = 1"""


def _type_days(src: str) -> str:
    return f"""WITH {EV}, u AS ({src})
SELECT event_type, make_timestamp(t_us // {DAY_US} * {DAY_US}) AS window_start,
       make_timestamp(t_us // {DAY_US} * {DAY_US} + {DAY_US}) AS window_end,
       count(*) AS event_count
FROM u GROUP BY event_type, t_us // {DAY_US}"""


UPSERT = _type_days("SELECT event_type, t_us FROM ev")
UNION = _type_days("""SELECT event_type, t_us FROM ev
  UNION ALL SELECT 'order', epoch_us(o_orderdate) // 1000 * 1000 FROM orders""")
COMPLETE = f"WITH {EV} SELECT event_type, count(*) AS event_count FROM ev GROUP BY event_type"

# ── decode variants ────────────────────────────────────────────────────────
JSON = """CAST(json_object('event_id', event_id, 'event_type', event_type, 'key', key,
                         'value', value, 'produced_at', produced_at) AS VARCHAR)"""

BRANCH = f"""WITH {EV}, j AS (SELECT *, {JSON} AS js FROM ev)
SELECT CASE WHEN event_type = 'error' THEN 'dead_letter'
            WHEN event_type IN ('click', 'view') THEN 'engagement'
            WHEN event_type = 'purchase' THEN 'revenue' ELSE 'other' END AS branch,
       CASE WHEN event_type <> 'error' THEN event_id END AS event_id,
       CASE WHEN event_type = 'error' THEN substr(js, 1, length(js) - 1) END AS raw
FROM j"""

BAD_JSON = f"""WITH {EV}
SELECT CASE WHEN event_type <> 'error' THEN event_id END AS event_id,
       CASE WHEN event_type <> 'error' THEN event_type END AS event_type,
       CASE WHEN event_type <> 'error' THEN key END AS key,
       CASE WHEN event_type <> 'error' THEN value END AS value,
       CASE WHEN event_type <> 'error' THEN produced_at END AS produced_at,
       event_type = 'error' AS is_malformed
FROM ev"""

STRICT = f"""WITH {EV}
SELECT event_id, event_type, key, value, produced_at FROM ev WHERE event_type <> 'error'"""

WITH_KEY = f"""WITH {EV}
SELECT key AS kafka_key, event_id, event_type, key, value, produced_at FROM ev"""

JVM_EV = """jv AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, event_type,
         CASE WHEN event_type = 'signup' THEN 'unknown' ELSE 'user_' || CAST(user_id AS VARCHAR) END AS key,
         CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS value,
         ts AS event_time, epoch_us(ts) AS t_us
  FROM events)"""

DEFAULTS = f"WITH {JVM_EV} SELECT event_id, key, event_type, value, event_time FROM jv"

SLIDING_JVM = f"""WITH {JVM_EV},
w AS (SELECT key, t_us // {MIN_US} * {MIN_US} - i * {MIN_US} AS ws,
             CAST(round(value * 100) AS BIGINT) AS cents
      FROM jv, range(0, 5) r(i)),
a AS (SELECT key, ws, CAST(sum(cents) AS BIGINT) AS s, count(*) AS n FROM w GROUP BY key, ws)
SELECT key, make_timestamp(ws) AS window_start, make_timestamp(ws + {5 * MIN_US}) AS window_end,
       sign(s) * ((20000 * abs(s) + n * 100) // (200 * n)) / 10000.0::DOUBLE AS avg_value,
       n AS event_count
FROM a"""

PASSTHROUGH_DOCS = f"""WITH {EV}
SELECT key, {JSON.replace("json_object(", "json_object('kafka_key', key, ")} AS value FROM ev WHERE event_type IN ('click', 'purchase')"""

SLIDING_LINES = f"""WITH {EV},
w AS (SELECT key, t_us // {MIN_US} * {MIN_US} - i * {MIN_US} AS ws, value
      FROM ev, range(0, 5) r(i)),
a AS (SELECT key, ws, avg(value) AS av FROM w GROUP BY key, ws)
SELECT printf('key=%s  window=[%s .. %s)  avg_value=%.4f', key,
              strftime(make_timestamp(ws), '%Y-%m-%dT%H:%M:%SZ'),
              strftime(make_timestamp(ws + {5 * MIN_US}), '%Y-%m-%dT%H:%M:%SZ'), av) AS line
FROM a"""

COUNT_LINES = f"""WITH {EV}
SELECT printf('key=%s  count=%d', key, row_number() OVER ({W_KEY})) AS line FROM ev"""

ORACLE.update({
    "enrich_customer": ENRICH,
    "enrich_customer_stream": ENRICH,
    "refreshing_lookup_stream": ENRICH,
    "interval_join": _interval("INNER"),
    "interval_join_left": _interval("LEFT"),
    "interval_join_stream": _interval("INNER"),
    "interval_join_left_stream": INTERVAL_LEFT_STREAM,
    "window_join": WINDOW_JOIN,
    "materialised_join": _interval("INNER"),
    "dedup": DEDUP,
    "dedup_within_watermark_stream": DEDUP,
    "latest_per_key": LATEST,
    "upsert_stream": UPSERT,
    "complete_stream": COMPLETE,
    "union_streams": UNION,
    "union_streams_stream": UNION,
    "branch_side_outputs": BRANCH,
    "branch_sink_stream": BRANCH,
    "decode_bad_json": BAD_JSON,
    "decode_strict": STRICT,
    "decode_with_kafka_key": WITH_KEY,
    "decode_defaults": DEFAULTS,
    "sliding_avg_jvm": SLIDING_JVM,
    "passthrough_docs": PASSTHROUGH_DOCS,
    "sliding_avg_lines": SLIDING_LINES,
    "running_count_lines": COUNT_LINES,
})


# ── late rows ──────────────────────────────────────────────────────────────
LATE_BASE = f"""{EV},
a AS (SELECT *, CAST(event_id AS BIGINT) + (CAST(event_id AS BIGINT) * 7919) % 13 AS arrival_seq
      FROM ev),
m AS (SELECT *, max(t_us) OVER (ORDER BY arrival_seq, CAST(event_id AS BIGINT)
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx
      FROM a),
l AS (SELECT *, coalesce(t_us // {MIN_US} * {MIN_US} + {MIN_US} <= mx - 10000000, false) AS is_late
      FROM m)"""

LATE_SPLIT = f"""WITH {LATE_BASE}
SELECT event_id, key, make_timestamp(t_us) AS event_time, arrival_seq, is_late FROM l"""

LATE_DROP = f"""WITH {LATE_BASE}
SELECT key, make_timestamp(t_us // {MIN_US} * {MIN_US}) AS window_start,
       make_timestamp(t_us // {MIN_US} * {MIN_US} + {MIN_US}) AS window_end,
       count(*) AS event_count
FROM l WHERE NOT is_late GROUP BY key, t_us // {MIN_US}"""

# ── latency ────────────────────────────────────────────────────────────────
LAT_BASE = f"""{EV},
lat AS (SELECT event_type, produced_at + (CAST(event_id AS BIGINT) * 7919) % 500 AS received_at,
               (CAST(event_id AS BIGINT) * 7919) % 500 AS lat
        FROM ev)"""


def _report(width_ms: int, group: str = "") -> str:
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {g}bucket"
    return f"""b AS (SELECT {g}received_at // {width_ms} AS bucket, lat FROM lat),
r AS (SELECT *, row_number() OVER ({part} ORDER BY lat) - 1 AS i,
             count(*) OVER ({part}) AS n FROM b),
rep AS (SELECT {g}bucket, count(*) AS n,
          max(CASE WHEN i = least(floor(n * 0.5::DOUBLE), n - 1) THEN lat END) AS p50,
          max(CASE WHEN i = least(floor(n * 0.95::DOUBLE), n - 1) THEN lat END) AS p95,
          max(CASE WHEN i = least(floor(n * 0.99::DOUBLE), n - 1) THEN lat END) AS p99,
          avg(lat) AS mean, min(lat) AS min, max(lat) AS max
        FROM r GROUP BY {g}bucket)"""


HOUR_MS, MIN5_MS, DAY_MS = 3_600_000, 300_000, 86_400_000

LAT_REPORT = f"""WITH {LAT_BASE}, {_report(HOUR_MS)}
SELECT make_timestamp(bucket * {HOUR_MS} * 1000) AS bucket_start, n, p50, p95, p99, mean,
       min, max, bucket = (SELECT max(bucket) FROM rep) AS is_partial
FROM rep"""

LAT_EMPTY = f"""WITH {LAT_BASE}, {_report(MIN5_MS)},
allb AS (SELECT range AS bucket
         FROM range((SELECT min(bucket) FROM rep), (SELECT max(bucket) FROM rep) + 1))
SELECT make_timestamp(allb.bucket * {MIN5_MS} * 1000) AS bucket_start, coalesce(rep.n, 0) AS n,
       p50, p95, p99, mean, min, max,
       CASE WHEN rep.n IS NOT NULL THEN allb.bucket = (SELECT max(bucket) FROM rep) END
         AS is_partial,
       rep.n IS NULL AS is_empty
FROM allb LEFT JOIN rep ON allb.bucket = rep.bucket"""

LAT_SUMMARY = f"""WITH {LAT_BASE}, {_report(HOUR_MS)}
SELECT CAST(sum(n) AS BIGINT) AS events, count(*) AS buckets, quantile_cont(p99, 0.5) AS median_p99,
       string_agg(CAST(p99 AS VARCHAR), ',' ORDER BY bucket) AS p99_list
FROM rep"""

LAT_P99_ROWS = f"""WITH {LAT_BASE}, {_report(HOUR_MS)}
SELECT make_timestamp(bucket * {HOUR_MS} * 1000) AS bucket_start, p99 FROM rep"""

SKETCH_FLAGS = "true AS p50_ok, true AS p95_ok, true AS p99_ok"
LAT_APPROX = f"""WITH {LAT_BASE}
SELECT make_timestamp(received_at // {HOUR_MS} * {HOUR_MS} * 1000) AS bucket_start, count(*) AS n, {SKETCH_FLAGS}
FROM lat GROUP BY received_at // {HOUR_MS}"""

LAT_MATRIX_SKETCH = f"""WITH {LAT_BASE}
SELECT event_type AS pattern, count(*) AS n, {SKETCH_FLAGS} FROM lat GROUP BY event_type"""

LAT_MATRIX = f"""WITH {LAT_BASE},
lat2 AS (SELECT event_type AS pattern, received_at // {DAY_MS} AS run, received_at, lat FROM lat),
b AS (SELECT pattern, run, received_at // {HOUR_MS} AS bucket, lat FROM lat2),
r AS (SELECT *, row_number() OVER (PARTITION BY pattern, run, bucket ORDER BY lat) - 1 AS i,
             count(*) OVER (PARTITION BY pattern, run, bucket) AS n FROM b),
rep AS (SELECT pattern, run, bucket,
          max(CASE WHEN i = least(floor(n * 0.99::DOUBLE), n - 1) THEN lat END) AS p99
        FROM r GROUP BY ALL),
runs AS (SELECT pattern, run, quantile_cont(p99, 0.5) AS run_p99 FROM rep GROUP BY ALL)
SELECT pattern, count(*) AS runs, quantile_cont(run_p99, 0.5) AS median_p99
FROM runs GROUP BY pattern"""

ORACLE.update({
    "late_split": LATE_SPLIT,
    "late_drop": LATE_DROP,
    "latency_report": LAT_REPORT,
    "latency_report_stream": LAT_REPORT,
    "latency_empty_buckets": LAT_EMPTY,
    "latency_summary": LAT_SUMMARY,
    "latency_matrix": LAT_MATRIX,
    "latency_p99_rows": LAT_P99_ROWS,
    "latency_matrix_sketch": LAT_MATRIX_SKETCH,
    "approx_latency_stream": LAT_APPROX,
})


KEY_PROFILE = f"""WITH {EV}
SELECT key, count(*) AS event_count, max(value) AS max_value,
       count(DISTINCT event_type) AS n_types
FROM ev GROUP BY key"""

FOREACH = f"""WITH {EV}
SELECT {JSON} AS line FROM ev WHERE event_type IN ('click', 'purchase')"""

VALUE_BAND = f"WITH {EV} SELECT event_id, CAST(value // 100 * 100 AS BIGINT) AS value_band FROM ev"

ORACLE.update({
    "key_profile": KEY_PROFILE,
    "key_profile_stream": KEY_PROFILE,
    "ttl_state_stream": RUNNING_COUNT,
    "foreach_rows_stream": FOREACH,
    "sliding_avg_udaf": SLIDING,
    "sliding_avg_pandas_udaf": SLIDING,
    "pandas_udf_stream": VALUE_BAND,
    "window_process_lines": SLIDING_LINES,
})


LATE_STREAM = f"""WITH {EV},
a AS (SELECT *, CAST(event_id AS BIGINT) + (CAST(event_id AS BIGINT) * 7919) % 13 AS seq FROM ev),
b AS (SELECT min(seq) AS lo, max(seq) AS hi FROM a),
c AS (SELECT a.*, least(floor(CAST(seq - lo AS DOUBLE) / (CAST(hi - lo AS DOUBLE) / 3.0::DOUBLE)),
                       2) AS batch
      FROM a, b),
m AS (SELECT batch, max(t_us) AS mx FROM c GROUP BY batch),
p AS (SELECT c.*, (SELECT max(mx) FROM m WHERE m.batch < c.batch) AS prev FROM c)
SELECT event_id, key, make_timestamp(t_us) AS event_time,
       coalesce(t_us // {MIN_US} * {MIN_US} + {MIN_US} <= prev - 10000000, false) AS is_late
FROM p"""

ORACLE["late_split_stream"] = LATE_STREAM

TTL_SEED = f"""WITH {EV},
cut AS (SELECT min(produced_at) + CAST(trunc(CAST(max(produced_at) - min(produced_at) AS DOUBLE) * 0.02::DOUBLE) AS BIGINT) AS c FROM ev)
SELECT key, count(*) + CASE WHEN min(produced_at) <= (SELECT c FROM cut) THEN 1000 ELSE 0 END AS running_count,
       count(*) AS seen
FROM ev GROUP BY key"""

ACC_BY_TYPE = f"""WITH {EV}
SELECT event_type, round(avg(value), 4) AS avg_value, count(*) AS event_count FROM ev GROUP BY event_type"""

ORACLE.update({
    "ttl_seed_stream": TTL_SEED,
    "running_sum_stream": RUNNING_SUM,
    "accumulate_by_type": ACC_BY_TYPE,
})

ORACLE.update({
    "processing_timer_stream": f"WITH {EV} SELECT DISTINCT key FROM ev",
    "processed_at_stream": f"""WITH {EV} SELECT key, event_id, true AS stamped FROM ev
WHERE event_type IN ('click', 'purchase')""",
})

BUSIEST = f"""WITH {EV},
t AS (SELECT key, t_us // {MIN_US} AS m, count(*) AS n FROM ev GROUP BY ALL)
SELECT key, CAST(sum(n) AS BIGINT) AS running_count, max(n) AS busiest_minute, count(*) AS minutes FROM t GROUP BY key"""

ORACLE.update({
    "tumbling_count_sql": TUMBLING,
    "sliding_avg_sql": SLIDING,
    "busiest_minute_sql": BUSIEST,
})

TYPED = f"WITH {EV} SELECT event_id, event_type, key, value, produced_at FROM ev WHERE event_type IN "

ORACLE.update({
    "parquet_table_stream": TYPED + "('click', 'purchase')",
    "equality_filter": TYPED + "('purchase')",
})
