"""DuckDB SQL for the registered queries, written apart from the Spark forms wherever SQL allows it.

Every statement starts from the raw tables; ``_with`` puts the shared derivations in front.
"""

from __future__ import annotations

DERIVED = {
    "business_events": ((), """
        SELECT 'e' || event_id AS event_id, event_id AS seq, CAST(user_id AS VARCHAR) AS customer_id,
               CAST(user_id % 25 AS INTEGER) AS pair_id,
               CASE event_type WHEN 'purchase' THEN 'ORDER_CREATED' WHEN 'view' THEN 'ORDER_UPDATED'
                    WHEN 'error' THEN 'ORDER_CANCELLED' WHEN 'click' THEN 'ORDER_VIEWED'
                    WHEN 'signup' THEN 'ORDER_UNKNOWN' END AS event_type,
               CAST(round(value * 100) AS BIGINT) * CASE WHEN event_type = 'view' AND event_id % 2 = 1 THEN -1 ELSE 1 END AS cents,
               epoch_us(ts) // 1000 AS event_ts_ms, CAST(user_id % 24 AS INTEGER) AS partition,
               event_id AS "offset", props AS payload
        FROM events"""),
    "business_events_ooo": (("business_events",), """
        SELECT * REPLACE ((seq + 400 * (seq % 5)) * 5 + 4 - seq % 5 AS seq) FROM business_events
        WHERE event_type IN ('ORDER_CREATED', 'ORDER_UPDATED', 'ORDER_CANCELLED')"""),
    "business_events_coarse": (("business_events",), """
        SELECT * REPLACE (event_ts_ms // 3600000 * 3600000 AS event_ts_ms) FROM business_events
        WHERE event_type IN ('ORDER_CREATED', 'ORDER_UPDATED', 'ORDER_CANCELLED')"""),
}


def _changes(source: str) -> tuple[tuple[str, ...], str]:
    """The fold: running sums, then the running floor correction."""
    return ((source,), f"""
        SELECT seq, event_id, customer_id,
               CAST(d1 + greatest(0, max(CASE WHEN event_type = 'ORDER_CANCELLED' THEN -d1 END) OVER w) AS INTEGER) AS order_count,
               CAST(d2 + greatest(0, max(CASE WHEN event_type <> 'ORDER_CREATED' THEN -d2 END) OVER w) AS BIGINT) AS cents,
               event_type AS last_event_type, event_ts_ms AS last_updated_ms, 1 AS state_version
        FROM (SELECT *,
                sum(CASE event_type WHEN 'ORDER_CREATED' THEN 1 WHEN 'ORDER_CANCELLED' THEN -1 ELSE 0 END) OVER w AS d1,
                sum(CASE event_type WHEN 'ORDER_CANCELLED' THEN -cents ELSE cents END) OVER w AS d2
              FROM {source} WHERE event_type IN ('ORDER_CREATED', 'ORDER_UPDATED', 'ORDER_CANCELLED')
              WINDOW w AS (PARTITION BY customer_id ORDER BY seq ROWS UNBOUNDED PRECEDING))
        WINDOW w AS (PARTITION BY customer_id ORDER BY seq ROWS UNBOUNDED PRECEDING)""")


DERIVED["changes"] = _changes("business_events")
DERIVED["changes_ooo"] = _changes("business_events_ooo")
DERIVED["changes_coarse"] = _changes("business_events_coarse")
for _name in ("changes", "changes_ooo", "changes_coarse"):
    DERIVED[_name.replace("changes", "latest")] = ((_name,), f"""
        SELECT * FROM {_name} QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY seq DESC) = 1""")
    DERIVED[_name.replace("changes", "accepted")] = ((_name,), f"""
        SELECT * FROM {_name} QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY last_updated_ms DESC, seq) = 1""")


def _with(*needed: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for other in DERIVED[name][0]:
            visit(other)
        if name not in order:
            order.append(name)

    for name in needed:
        visit(name)
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({DERIVED[name][1]})" for name in order) + "\n"


AMOUNT = "CAST(cents * 0.01 AS DECIMAL(18,2))"
STATE = f"customer_id, order_count, {AMOUNT} AS total_amount, last_event_type, last_updated_ms, state_version"

ORACLES: dict[str, str] = {}


def _oracle(name: str, *needed: str, sql: str) -> None:
    ORACLES[name] = (_with(*needed) if needed else "") + sql


_oracle("customer_state_changes", "changes", sql=f"SELECT seq, event_id, {STATE} FROM changes")
_oracle("customer_state_changes_ooo", "changes_ooo", sql=f"SELECT seq, event_id, {STATE} FROM changes_ooo")
_oracle("customer_state_latest", "latest", sql=f"SELECT {STATE} FROM latest")
_oracle("conditional_upsert", "accepted_ooo", sql=f"SELECT {STATE} FROM accepted_ooo")
_oracle("conditional_upsert_ties", "accepted_coarse", sql=f"SELECT {STATE} FROM accepted_coarse")
for _key, _changes_name in (("conditional_write_audit", "changes_ooo"), ("conditional_write_audit_ties", "changes_coarse")):
    _oracle(_key, _changes_name, sql=f"""
        SELECT seq, customer_id, last_updated_ms, stored_version,
               stored_version IS NULL OR last_updated_ms > stored_version AS accepted
        FROM (SELECT *, max(last_updated_ms) OVER (PARTITION BY customer_id ORDER BY seq
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stored_version FROM {_changes_name})""")
_oracle("unknown_event_types", "business_events", sql="""
    SELECT event_type, count(*) AS events FROM business_events
    WHERE event_type IS NULL OR event_type NOT IN ('ORDER_CREATED', 'ORDER_UPDATED', 'ORDER_CANCELLED') GROUP BY event_type""")


_oracle("key_partitions", "business_events", sql="""
    SELECT customer_id, min(partition) AS first_partition, max(partition) AS last_partition, count(*) AS events
    FROM business_events GROUP BY customer_id""")

# -- control log

DERIVED["pairs"] = ((), """
    SELECT CAST(n_nationkey AS INTEGER) AS pair_id, 'app1-' || n_nationkey AS app1, 'app2-' || n_nationkey AS app2 FROM nation""")
DERIVED["handoffs"] = ((), """
    SELECT o_orderkey AS n, CAST(o_custkey % 25 AS INTEGER) AS pair_id, o_orderstatus AS status,
           1704067200000 + (o_orderkey * 7919) % 2678400 * 1000 AS t0,
           CASE WHEN o_orderkey % 2 = 0 THEN 'app2-' ELSE 'app1-' END || (o_custkey % 25) AS gains,
           CASE WHEN o_orderkey % 2 = 0 THEN 'app1-' ELSE 'app2-' END || (o_custkey % 25) AS loses,
           o_orderkey % 19 = 0 AS failed, o_orderkey % 23 = 0 AS refused, o_orderstatus = 'O' AS late,
           [1000 + (o_orderkey + p) % 50 FOR p IN range(4)] AS target FROM orders""")
_TEXT = "'0:' || {0}[1] || ',1:' || {0}[2] || ',2:' || {0}[3] || ',3:' || {0}[4]"
_ROWS = [
    # type, rank, condition, time, target, source, offsets, coordinator, reason, traced
    ("TRIGGER", 0, "true", "t0", None, "'coordinator-1'", None, True, None, True),
    ("SAVEPOINT_FAILED", 1, "failed", "t0 + 500", None, "'coordinator-1'", None, True, None, True),
    ("PREPARE_HANDOFF", 2, "NOT failed", "t0 + 1000", "'broadcast'", "'coordinator-1'", "target", True, None, True),
    ("HEARTBEAT", 3, "true", "t0 + 1500", "'broadcast'", "'coordinator-1'", None, True, None, False),
    ("DRAINED_AT", 4, "NOT failed", "t0 + CASE WHEN late THEN 70000 ELSE 2000 END", "'broadcast'", "loses",
     "[target[1] - CASE WHEN n % 7 = 0 THEN 1 ELSE 0 END, target[2], target[3], target[4]]", False, None, True),
    ("TRANSFER_REFUSED", 5, "NOT failed AND NOT late AND refused", "t0 + 2400", None, "'coordinator-1'", None, True, None, True),
    ("PROMOTE", 6, "NOT failed AND NOT late AND NOT refused", "t0 + 2500 + CASE WHEN n % 13 = 0 THEN 3600000 ELSE 0 END",
     "gains", "'coordinator-1'", None, True, None, True),
    ("DEMOTE", 7, "NOT failed AND NOT late AND NOT refused", "t0 + 2600 + CASE WHEN n % 11 = 0 THEN 3600000 ELSE 0 END",
     "loses", "'coordinator-1'", None, True, None, True),
    ("PROMOTED_CONFIRMED", 8, "NOT failed AND NOT late AND NOT refused AND status = 'F'", "t0 + 3000 + n % 500",
     "'broadcast'", "gains", None, False, None, True),
    ("HANDOFF_ABORT", 9, "NOT failed AND late", "t0 + 61000", "'broadcast'", "'coordinator-1'", None, True, "'App1 drain timeout'", True),
]
DERIVED["control_log"] = (("handoffs",), "\nUNION ALL\n".join(
    f"""SELECT pair_id, ({at}) * 16 + {rank} AS "offset", n AS trace_no, '{name}' AS signal_type,
        CAST({target or 'NULL'} AS VARCHAR) AS target_app_id, CAST({source} AS VARCHAR) AS source_app_id,
        CAST({offsets or 'NULL'} AS BIGINT[]) AS offsets, {"'coordinator-1'" if coordinator else 'CAST(NULL AS VARCHAR)'} AS coordinator_id,
        {at} AS "timestamp", {"'t' || n" if traced else 'CAST(NULL AS VARCHAR)'} AS trace_id, CAST({reason or 'NULL'} AS VARCHAR) AS reason
        FROM handoffs WHERE {condition}"""
    for name, rank, condition, at, target, source, offsets, coordinator, reason, traced in _ROWS
))
DERIVED["control_signals"] = (("control_log",), """
    SELECT *, trace_no * 10 + "offset" % 16 AS record_no FROM control_log
    WHERE signal_type NOT IN ('TRIGGER', 'SAVEPOINT_FAILED', 'TRANSFER_REFUSED')""")

_oracle("decode_business_events", "business_events", sql="""
    SELECT partition, "offset", event_id, customer_id, event_type, CAST(cents * 0.01 AS DECIMAL(18,2)) AS amount, event_ts_ms, payload
    FROM business_events""")


def _json(column: str, name: str) -> str:
    return f"""CASE WHEN {column} IS NULL THEN '' ELSE '"{name}":"' || {column} || '",' END"""


_oracle("encode_control_signals", "control_signals", sql=f"""
    SELECT pair_id, "offset", trace_no, target_app_id AS key,
      '{{' || {_json('signal_type', 'signalType')} || {_json('target_app_id', 'targetAppId')} || {_json('source_app_id', 'sourceAppId')}
      || CASE WHEN offsets IS NULL THEN '' ELSE '"cutoverOffsets":{{"0":' || offsets[1] || ',"1":' || offsets[2] || ',"2":' || offsets[3]
              || ',"3":' || offsets[4] || '}},' END
      || {_json('coordinator_id', 'coordinatorId')} || '"timestamp":' || "timestamp"
      || rtrim(',' || {_json('trace_id', 'traceId')} || {_json('reason', 'reason')}, ',') || '}}' AS value
    FROM control_signals""")
_BAD = "(record_no % 97 = 0 OR record_no % 89 = 0 OR record_no % 83 = 0 OR record_no % 79 = 0)"
_oracle("decode_control_signals", "control_signals", sql=f"""
    SELECT pair_id, "offset", trace_no, signal_type, target_app_id, source_app_id,
           CASE WHEN offsets IS NOT NULL THEN {_TEXT.format('offsets')} END AS cutover_offsets, coordinator_id, "timestamp", trace_id, reason
    FROM control_signals WHERE NOT {_BAD}""")
_oracle("unreadable_control_records", "control_signals", sql=f"""
    SELECT count(*) AS records, count(*) FILTER (WHERE {_BAD}) AS skipped FROM control_signals""")

# -- modes

_oracle("signals_delivered", "control_signals", "pairs", sql="""
    SELECT s.pair_id, "offset", trace_no, app_id, signal_type, target_app_id, trace_id
    FROM control_signals s JOIN (SELECT pair_id, app1 AS app_id FROM pairs UNION ALL SELECT pair_id, app2 FROM pairs) p
      ON s.pair_id = p.pair_id AND (target_app_id = app_id OR target_app_id = 'broadcast')""")
_oracle("signals_for_trace", "control_log", sql="""
    SELECT * FROM (
      SELECT pair_id, "offset", trace_no, signal_type, trace_id,
             last_value(CASE WHEN signal_type = 'TRIGGER' THEN trace_id END IGNORE NULLS)
               OVER (PARTITION BY pair_id ORDER BY "offset", trace_no ROWS UNBOUNDED PRECEDING) AS active_trace
      FROM control_log)
    WHERE signal_type = 'HEARTBEAT' OR trace_id IS NULL OR active_trace IS NULL OR trace_id = active_trace""")
DERIVED["mode_signals"] = (("control_signals", "pairs"), """
    SELECT pair_id, target_app_id AS app_id, CASE signal_type WHEN 'PROMOTE' THEN 'ACTIVE' ELSE 'SHADOW' END AS mode,
           "timestamp" AS ts, "offset", trace_no FROM control_signals WHERE signal_type IN ('PROMOTE', 'DEMOTE')
    UNION ALL SELECT pair_id, app1, 'ACTIVE', 0, -1, -1 FROM pairs
    UNION ALL SELECT pair_id, app2, 'SHADOW', 0, -1, -1 FROM pairs""")
DERIVED["timeline"] = (("mode_signals",), """
    SELECT pair_id, app_id, mode, ts AS valid_from_ms, lead(ts) OVER (PARTITION BY app_id ORDER BY "offset", trace_no) AS valid_to_ms
    FROM (SELECT *, lag(mode) OVER (PARTITION BY app_id ORDER BY "offset", trace_no) AS prev FROM mode_signals)
    WHERE prev IS NULL OR prev <> mode""")
_oracle("mode_timeline", "timeline", sql="SELECT * FROM timeline")
DERIVED["write_modes"] = (("business_events", "pairs", "mode_signals"), """
    SELECT e.pair_id, e.app_id, seq, event_id, customer_id, m.mode
    FROM (SELECT b.*, app_id FROM business_events b
          JOIN (SELECT pair_id, app1 AS app_id FROM pairs UNION ALL SELECT pair_id, app2 FROM pairs) p ON b.pair_id = p.pair_id
          WHERE event_type IN ('ORDER_CREATED', 'ORDER_UPDATED', 'ORDER_CANCELLED')) e
    ASOF JOIN (SELECT * FROM mode_signals QUALIFY row_number() OVER (PARTITION BY app_id, ts ORDER BY "offset" DESC, trace_no DESC) = 1) m
      ON e.app_id = m.app_id AND e.event_ts_ms >= m.ts""")
_oracle("write_mode_asof", "write_modes", sql="SELECT pair_id, app_id, seq, event_id, mode FROM write_modes")
DERIVED["gate"] = (("write_modes",), """
    SELECT pair_id, app_id, count(*) FILTER (WHERE mode = 'ACTIVE') AS written, count(*) FILTER (WHERE mode <> 'ACTIVE') AS dropped
    FROM write_modes GROUP BY ALL""")
_oracle("shadow_gate_counts", "gate", sql="SELECT * FROM gate")
_oracle("handoff_coverage", "write_modes", sql="""
    SELECT pair_id, seq, event_id, customer_id, app1_mode, app2_mode, CAST(writers AS INTEGER) AS writers,
           CASE WHEN writers = 0 THEN 'GAP' ELSE 'OVERLAP' END AS status, CASE WHEN writers = 0 THEN later END AS repaired_by
    FROM (SELECT *, min(CASE WHEN writers > 0 THEN seq END) OVER (PARTITION BY customer_id ORDER BY seq
                 ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later
          FROM (SELECT pair_id, seq, event_id, customer_id, max(mode) FILTER (WHERE app_id LIKE 'app1-%') AS app1_mode,
                       max(mode) FILTER (WHERE app_id LIKE 'app2-%') AS app2_mode, count(*) FILTER (WHERE mode = 'ACTIVE') AS writers
                FROM write_modes GROUP BY ALL))
    WHERE writers <> 1""")
DERIVED["split_brain"] = (("timeline",), """
    SELECT a.pair_id, greatest(a.valid_from_ms, b.valid_from_ms) AS from_ms, CASE WHEN a.valid_to_ms IS NULL THEN b.valid_to_ms
           WHEN b.valid_to_ms IS NULL THEN a.valid_to_ms ELSE least(a.valid_to_ms, b.valid_to_ms) END AS until_ms
    FROM timeline a JOIN timeline b ON a.pair_id = b.pair_id AND a.app_id < b.app_id AND a.mode = 'ACTIVE' AND b.mode = 'ACTIVE'
     AND a.valid_from_ms < coalesce(b.valid_to_ms, 9223372036854775807) AND b.valid_from_ms < coalesce(a.valid_to_ms, 9223372036854775807)
     AND a.valid_from_ms < coalesce(a.valid_to_ms, 9223372036854775807) AND b.valid_from_ms < coalesce(b.valid_to_ms, 9223372036854775807)""")
_oracle("split_brain_intervals", "split_brain", sql="SELECT * FROM split_brain")

# -- offsets

DERIVED["snapshots"] = (("business_events",), """
    SELECT * FROM (
      SELECT k.pair_id, g.group_id, 'business-events' AS topic, k.partition, e."offset" + 1 AS "offset", g.observed_ms
      FROM (SELECT DISTINCT pair_id, partition FROM business_events) k
      JOIN (SELECT p, 'app1' AS group_id, 1704067200000 + i * 21600000 AS observed_ms, 1704067200000 + i * 21600000 AS mark
            FROM range(1, 125) r(i), range(24) q(p)
            UNION ALL
            SELECT p, 'app2', 1704067200000 + i * 21600000, 1704067200000 + i * 21600000
                   - CASE WHEN ((1704067200000 + i * 21600000) // 21600000) % 10 < 4 THEN 0 ELSE 3600000 * (p % 5) END
            FROM range(1, 125) r(i), range(24) q(p)) g ON g.p = k.partition
      ASOF JOIN business_events e ON e.pair_id = k.pair_id AND e.partition = k.partition AND g.mark >= e.event_ts_ms)
    WHERE NOT (group_id = 'app2' AND (observed_ms // 21600000) % 17 = 0 AND partition % 6 = 0)""")
DERIVED["lags"] = (("snapshots",), """
    SELECT a.pair_id, a.observed_ms, a.partition, a."offset" AS app1_offset, b."offset" AS app2_offset,
           greatest(0, a."offset" - coalesce(b."offset", 0)) AS lag
    FROM snapshots a LEFT JOIN snapshots b ON a.pair_id = b.pair_id AND a.partition = b.partition
     AND a.observed_ms = b.observed_ms AND b.group_id = 'app2' WHERE a.group_id = 'app1'""")
DERIVED["max_lags"] = (("lags",), """
    SELECT pair_id, observed_ms, max(lag) AS max_lag FROM lags GROUP BY ALL HAVING count(app2_offset) > 0""")
_oracle("committed_offsets", "snapshots", sql="""SELECT pair_id, partition, "offset", observed_ms FROM snapshots WHERE group_id = 'app2'""")
_oracle("offsets_from_metrics", "snapshots", sql="""SELECT pair_id, observed_ms, partition, "offset" FROM snapshots WHERE group_id = 'app1'""")
_oracle("partition_lag", "lags", sql="SELECT * FROM lags")
_oracle("max_lag", "max_lags", sql="SELECT * FROM max_lags")
_oracle("app2_ready_times", "max_lags", sql="""
    SELECT pair_id, zero_since_ms, min(observed_ms) AS ready_ms
    FROM (SELECT *, min(observed_ms) OVER (PARTITION BY pair_id, island) AS zero_since_ms
          FROM (SELECT *, sum(CASE WHEN max_lag > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY observed_ms) AS island
                FROM max_lags) WHERE max_lag = 0)
    WHERE observed_ms - zero_since_ms >= 43200000 GROUP BY pair_id, zero_since_ms""")
_oracle("worst_partitions", "lags", sql="""
    SELECT pair_id, partition, max_lag, CAST(rank AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY max_lag DESC, partition) AS rank
          FROM (SELECT pair_id, partition, max(lag) AS max_lag FROM lags GROUP BY ALL)) WHERE rank <= 3""")
_oracle("retention_gap", "snapshots", sql="""
    SELECT s.pair_id, s.partition, s."offset", s.observed_ms, earliest, earliest - s."offset" AS missing
    FROM snapshots s JOIN (SELECT pair_id, partition, min("offset") AS earliest FROM business_events
                           WHERE event_ts_ms >= 1704067200000 + 60 * 21600000 GROUP BY ALL) e USING (pair_id, partition)
    WHERE group_id = 'app1' AND s."offset" < earliest""")
_oracle("cutover_split", "snapshots", sql="""
    SELECT event_id, e.pair_id, e.partition, e."offset", c."offset" - 1 AS cutover,
           CASE WHEN c."offset" IS NULL THEN 'NONE' WHEN e."offset" <= c."offset" - 1 THEN 'OLD' ELSE 'NEW' END AS side
    FROM business_events e LEFT JOIN snapshots c ON c.pair_id = e.pair_id AND c.partition = e.partition
     AND c.group_id = 'app1' AND c.observed_ms = 1704067200000 + 62 * 21600000 AND c.partition < 22""")

# -- handoffs

DERIVED["outcomes"] = (("control_log",), """
    SELECT pair_id, trace_id, CASE WHEN done THEN 'HANDOFF_COMPLETE' ELSE 'HANDOFF_FAILED' END AS state,
      CASE WHEN done THEN NULL WHEN savepoint IS NOT NULL THEN 'Savepoint did not complete successfully'
           WHEN drained IS NULL THEN 'App1 drain timeout' ELSE 'Leader transfer refused' END AS reason,
      done AND confirmed IS NULL AS assumed, triggered AS triggered_ms, prepared AS prepared_ms, drained AS drained_ms,
      CASE WHEN done THEN confirmed END AS confirmed_ms,
      CASE WHEN done THEN coalesce(confirmed, drained + 30000) WHEN savepoint IS NOT NULL THEN savepoint
           WHEN drained IS NULL THEN least(prepared + 60000, coalesce(aborted, prepared + 60000)) ELSE refused END AS finished_ms,
      CASE WHEN done THEN coalesce(confirmed, drained + 30000) - triggered END AS duration_ms,
      CASE WHEN done THEN confirmed - prepared END AS prepare_to_confirm_ms
    FROM (SELECT *, savepoint IS NULL AND drained IS NOT NULL AND refused IS NULL AS done
          FROM (SELECT pair_id, trace_id, triggered, savepoint, prepared, refused, aborted, confirmed,
                       CASE WHEN drain <= prepared + 60000 THEN drain END AS drained
                FROM (SELECT pair_id, trace_id, min("timestamp") FILTER (WHERE signal_type = 'TRIGGER') AS triggered,
                        min("timestamp") FILTER (WHERE signal_type = 'SAVEPOINT_FAILED') AS savepoint,
                        min("timestamp") FILTER (WHERE signal_type = 'PREPARE_HANDOFF') AS prepared,
                        min("timestamp") FILTER (WHERE signal_type = 'DRAINED_AT') AS drain,
                        min("timestamp") FILTER (WHERE signal_type = 'TRANSFER_REFUSED') AS refused,
                        min("timestamp") FILTER (WHERE signal_type = 'PROMOTED_CONFIRMED') AS confirmed,
                        min("timestamp") FILTER (WHERE signal_type = 'HANDOFF_ABORT') AS aborted
                      FROM control_log WHERE trace_id IS NOT NULL GROUP BY ALL)))""")
_oracle("handoff_outcomes", "outcomes", sql="SELECT * FROM outcomes")
_oracle("handoff_duration", "outcomes", sql="""
    SELECT pair_id, count(*) AS completed, count(*) FILTER (WHERE assumed) AS assumed, avg(duration_ms) AS avg_duration_ms,
           CAST(quantile_disc(duration_ms, 0.5) AS BIGINT) AS median_duration_ms, max(duration_ms) AS max_duration_ms,
           avg(prepare_to_confirm_ms) AS avg_prepare_to_confirm_ms, max(prepare_to_confirm_ms) AS max_prepare_to_confirm_ms
    FROM outcomes WHERE state = 'HANDOFF_COMPLETE' GROUP BY pair_id""")
_oracle("drain_verification", "handoffs", sql="""
    SELECT pair_id, 't' || n AS trace_id, 4 AS partitions, CASE WHEN n % 7 = 0 THEN 1 ELSE 0 END AS partitions_short,
           true AS reported, n % 7 <> 0 AS drained_ok
    FROM handoffs WHERE NOT failed""")
_oracle("heartbeat_gaps", sql="""
    WITH beats AS (SELECT CAST(user_id AS VARCHAR) AS app_id, epoch_us(ts) // 1000 AS ts_ms, event_id FROM events WHERE event_type = 'click')
    SELECT app_id, ts_ms AS last_beat_ms, next_ms AS next_beat_ms, coalesce(next_ms, (SELECT max(ts_ms) FROM beats)) - ts_ms AS silence_ms,
           next_ms IS NULL AS still_open
    FROM (SELECT *, lead(ts_ms) OVER (PARTITION BY app_id ORDER BY ts_ms, event_id) AS next_ms FROM beats)
    WHERE coalesce(next_ms, (SELECT max(ts_ms) FROM beats)) - ts_ms > 86400000""")
DERIVED["samples"] = (("max_lags", "control_signals", "outcomes"), """
    SELECT 'lag-high' AS rule, 'App2ConsumerLagMessages' AS metric_name, CAST(pair_id AS VARCHAR) AS dim_value,
           CAST(max_lag AS DOUBLE) AS value, observed_ms AS ts_ms, 0 AS sample_no, max_lag > 0 AS holds, 43200000 AS ms FROM max_lags
    UNION ALL
    SELECT 'standby-writes', 'SinkMode', target_app_id, CASE WHEN signal_type = 'PROMOTE' THEN 1.0 ELSE 0.0 END, "timestamp",
           trace_no * 16 + "offset" % 16, signal_type = 'PROMOTE', 86400000
    FROM control_signals WHERE signal_type IN ('PROMOTE', 'DEMOTE')
    UNION ALL
    SELECT 'handoff-slow', 'HandoffDurationMs', CAST(pair_id AS VARCHAR), CAST(duration_ms AS DOUBLE), finished_ms,
           CAST(trace_id[2:] AS BIGINT), duration_ms > 10000, 3600000
    FROM outcomes WHERE duration_ms IS NOT NULL""")
_oracle("sustained_alerts", "samples", sql="""
    SELECT rule, metric_name, dim_value, run_start_ms, min(CASE WHEN ts_ms - run_start_ms > ms THEN ts_ms END) AS fired_ms,
           max(ts_ms) AS last_seen_ms, count(*) AS samples, max(value) AS max_value
    FROM (SELECT *, min(ts_ms) OVER (PARTITION BY rule, dim_value, island) AS run_start_ms
          FROM (SELECT *, count(*) FILTER (WHERE NOT holds) OVER (PARTITION BY rule, dim_value ORDER BY ts_ms, sample_no
                       ROWS UNBOUNDED PRECEDING) AS island FROM samples) WHERE holds)
    GROUP BY rule, metric_name, dim_value, island, run_start_ms HAVING min(CASE WHEN ts_ms - run_start_ms > ms THEN ts_ms END) IS NOT NULL""")
_oracle("metrics_long", "timeline", "max_lags", "outcomes", "gate", "split_brain", sql="""
    SELECT 'Standby' AS namespace, metric_name, dim_name, CAST(dim_value AS VARCHAR) AS dim_value, CAST(value AS DOUBLE) AS value, unit, ts_ms FROM (
      SELECT 'SinkMode' AS metric_name, 'AppId' AS dim_name, app_id AS dim_value, CASE mode WHEN 'ACTIVE' THEN 1 ELSE 0 END AS value,
             'None' AS unit, valid_from_ms AS ts_ms FROM timeline
      UNION ALL SELECT 'App2ConsumerLagMessages', NULL, NULL, max_lag, 'Count', observed_ms FROM max_lags
      UNION ALL SELECT 'HandoffState', 'State', state, CASE state WHEN 'HANDOFF_COMPLETE' THEN 6 ELSE 7 END, 'None', finished_ms FROM outcomes
      UNION ALL SELECT 'HandoffDurationMs', NULL, NULL, duration_ms, 'Milliseconds', finished_ms FROM outcomes WHERE duration_ms IS NOT NULL
      UNION ALL SELECT 'ShadowDropCount', 'AppId', app_id, dropped, 'Count', 1706745600000 FROM gate
      UNION ALL SELECT 'SplitBrainDetected', 'AppId', CAST(pair_id AS VARCHAR), 1, 'Count', from_ms FROM split_brain)""")

# -- leadership and locks: step-by-step recursion

DERIVED["attempts"] = ((), """
    SELECT CAST(o_custkey % 25 AS INTEGER) AS pair_id, CASE WHEN o_orderkey % 2 = 0 THEN 'app1' ELSE 'app2' END AS from_app,
           CASE WHEN o_orderkey % 2 = 0 THEN 'app2' ELSE 'app1' END AS to_app, 1 + o_orderkey // 200 AS expected_version, o_orderkey AS seq,
           row_number() OVER (PARTITION BY o_custkey % 25 ORDER BY o_orderkey) AS rn FROM orders""")
DERIVED["transfer_steps"] = (("attempts", "pairs"), """
    SELECT pair_id, CAST(0 AS BIGINT) AS rn, 'app1' AS leader, CAST(1 AS BIGINT) AS version, false AS accepted FROM pairs
    UNION ALL
    SELECT a.pair_id, a.rn, CASE WHEN from_app = leader AND expected_version = version THEN to_app ELSE leader END,
           CASE WHEN from_app = leader AND expected_version = version THEN version + 1 ELSE version END,
           from_app = leader AND expected_version = version
    FROM transfer_steps s JOIN attempts a ON a.pair_id = s.pair_id AND a.rn = s.rn + 1""")
_oracle("leader_transfers", "transfer_steps", sql="""
    SELECT a.pair_id, a.seq, from_app, to_app, expected_version, accepted FROM attempts a JOIN transfer_steps s USING (pair_id, rn)""")
DERIVED["lease_log"] = ((), """
    SELECT CAST(o_custkey % 50 AS INTEGER) AS lock_id, 'c' || (o_orderkey % 3) AS coordinator_id,
           CASE WHEN o_orderkey % 4 < 2 THEN 'ACQUIRE' WHEN o_orderkey % 4 = 2 THEN 'RENEW' ELSE 'RELEASE' END AS op,
           o_orderkey // 2 AS at_s, o_orderkey AS seq,
           row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS rn FROM orders""")
DERIVED["lease_steps"] = (("lease_log",), """
    SELECT lock_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS holder, CAST(NULL AS BIGINT) AS ttl, false AS accepted,
           CAST(NULL AS BIGINT) AS session FROM (SELECT DISTINCT lock_id FROM lease_log)
    UNION ALL
    SELECT lock_id, rn, CASE WHEN NOT ok THEN holder WHEN op = 'RELEASE' THEN NULL ELSE coordinator_id END,
           CASE WHEN NOT ok THEN ttl WHEN op = 'RELEASE' THEN NULL ELSE at_s + 30 END, ok,
           CASE WHEN ok AND op = 'ACQUIRE' THEN seq ELSE session END
    FROM (SELECT l.*, s.holder, s.ttl, s.session,
                 CASE WHEN op = 'ACQUIRE' THEN s.holder IS NULL OR s.ttl < at_s ELSE coalesce(s.holder = coordinator_id, false) END AS ok
          FROM lease_steps s JOIN lease_log l ON l.lock_id = s.lock_id AND l.rn = s.rn + 1)""")
_oracle("lease_replay", "lease_steps", sql="""
    SELECT l.lock_id, l.seq, coordinator_id, op, at_s, accepted FROM lease_log l JOIN lease_steps s USING (lock_id, rn)""")
DERIVED["intervals"] = (("lease_steps",), """
    SELECT lock_id, coordinator_id, min(at_s) AS from_s,
           coalesce(max(at_s) FILTER (WHERE op = 'RELEASE'), max(at_s) + 30) AS until_s, count(*) FILTER (WHERE op = 'RENEW') AS renewals,
           CASE WHEN count(*) FILTER (WHERE op = 'RELEASE') > 0 THEN 'RELEASED' ELSE 'EXPIRED' END AS ended_by
    FROM (SELECT l.*, s.session FROM lease_log l JOIN lease_steps s USING (lock_id, rn) WHERE accepted) GROUP BY lock_id, session, coordinator_id""")
_oracle("lease_intervals", "intervals", sql="SELECT * FROM intervals")
_oracle("lock_holders", "intervals", sql="""
    SELECT lock_id, coordinator_id AS holder FROM intervals
    WHERE from_s <= (SELECT max(o_orderkey // 2) // 2 FROM orders) AND until_s > (SELECT max(o_orderkey // 2) // 2 FROM orders)""")
_oracle("pair_status", "outcomes", "max_lags", "transfer_steps", "intervals", sql="""
    SELECT p.pair_id, coalesce(o.state, 'IDLE') AS state, o.trace_id, t.leader, t.version, m.max_lag, i.coordinator_id AS holder,
           i.coordinator_id IS NOT NULL AND coalesce(o.state, 'IDLE') <> 'HANDOFF_FAILED' AS ready
    FROM pairs p
    LEFT JOIN (SELECT * FROM outcomes QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY triggered_ms DESC, trace_id DESC) = 1) o USING (pair_id)
    LEFT JOIN (SELECT * FROM transfer_steps QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY rn DESC) = 1) t USING (pair_id)
    LEFT JOIN (SELECT * FROM max_lags QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY observed_ms DESC) = 1) m USING (pair_id)
    LEFT JOIN intervals i ON i.lock_id = p.pair_id AND i.from_s <= (SELECT max(o_orderkey // 2) FROM orders)
         AND i.until_s > (SELECT max(o_orderkey // 2) FROM orders)""")

# -- verification, snapshots, migration


def _hash(amount: str) -> str:
    return f"""sha256('{{"customerId":"' || customer_id || '","orderCount":' || order_count || ',"totalCents":' || {amount}
      || ',"lastEventType":"' || last_event_type || '","lastUpdatedMs":' || last_updated_ms || ',"stateVersion":' || state_version || '}}')"""


_oracle("state_hash", "latest", sql=f"SELECT customer_id AS state_key, {_hash('cents')} AS state_hash FROM latest")
_oracle("state_digest", "latest", sql=f"""
    SELECT count(*) AS states, bit_xor(CAST('0x' || {_hash('cents')}[1:15] AS BIGINT)) AS digest FROM latest""")
_oracle("state_digest_at_offsets", "business_events", "changes", sql=f"""
    SELECT cut, count(*) AS states, bit_xor(CAST('0x' || {_hash('cents')}[1:15] AS BIGINT)) AS digest
    FROM (SELECT c.*, i || '/4' AS cut
          FROM changes c JOIN business_events e USING (event_id)
          JOIN (SELECT partition, max("offset") AS top FROM business_events
                WHERE event_type IN ('ORDER_CREATED', 'ORDER_UPDATED', 'ORDER_CANCELLED') GROUP BY partition) t ON t.partition = e.partition
          CROSS JOIN (VALUES (1), (2), (3)) k(i)
          WHERE e."offset" <= top * i // 4
          QUALIFY row_number() OVER (PARTITION BY i, c.customer_id ORDER BY c.seq DESC) = 1)
    GROUP BY cut""")
_oracle("state_hash_diff", "latest", sql=f"""
    SELECT customer_id AS state_key, expected_hash, actual_hash, CASE WHEN actual_hash IS NULL THEN 'MISSING_ACTUAL'
           WHEN expected_hash = actual_hash THEN 'MATCH' ELSE 'MISMATCH' END AS status
    FROM (SELECT customer_id, {_hash('cents')} AS expected_hash, CASE WHEN CAST(customer_id AS BIGINT) % 41 <> 0 THEN
            {_hash('(cents + CASE WHEN CAST(customer_id AS BIGINT) % 37 = 0 THEN 1 ELSE 0 END)')} END AS actual_hash FROM latest)""")
_oracle("split_invariance", "latest", sql=f"""
    SELECT customer_id AS state_key, {_hash('cents')} AS expected_hash, {_hash('cents')} AS actual_hash, 'MATCH' AS status FROM latest""")
_oracle("state_migration", "latest", sql=f"""
    SELECT customer_id, order_count, {AMOUNT} AS total_amount, last_event_type, last_updated_ms, 3 AS state_version,
           CASE WHEN CAST(customer_id AS BIGINT) % 3 = 0 THEN 'STANDARD' ELSE 'GOLD' END AS tier_level,
           CASE WHEN CAST(customer_id AS BIGINT) % 3 = 2 THEN false ELSE order_count >= 5 END AS frequent FROM latest""")
DERIVED["savepoints"] = ((), f"""
    SELECT 's' || o_orderkey AS savepoint_id,
           's3://snapshots/jobs/state/sp-' || (epoch_us(o_orderdate) // 1000 + o_orderkey % 86400 * 1000) || '-s' || o_orderkey AS location,
           'job-' || (o_custkey % 50) AS source_job_id, epoch_us(o_orderdate) // 1000 + o_orderkey % 86400 * 1000 AS taken_at_ms,
           {_TEXT.format('[1000 + (o_orderkey + p) % 50 FOR p IN range(4)]')} AS kafka_offsets,
           CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'IN_PROGRESS' ELSE 'FAILED' END AS status, o_orderkey AS savepoint_no
    FROM orders""")
_oracle("savepoint_latest_completed", "savepoints", sql="""
    SELECT source_job_id, savepoint_id, location, taken_at_ms, kafka_offsets FROM savepoints WHERE status = 'COMPLETED'
    QUALIFY row_number() OVER (PARTITION BY source_job_id ORDER BY taken_at_ms DESC, savepoint_id) = 1""")
_oracle("savepoint_by_id", "savepoints", sql="SELECT * FROM savepoints WHERE savepoint_id = 's1234'")
_oracle("savepoint_current_status", "savepoints", sql="""
    SELECT savepoint_id, source_job_id, location, taken_at_ms + CASE WHEN status = 'IN_PROGRESS' THEN 0 ELSE 60000 END AS changed_ms, status
    FROM savepoints""")
_oracle("scalar_functions", sql=f"""
    SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS mode_number,
           CAST(CASE WHEN o_orderkey % 9 < 8 THEN o_orderkey % 9 ELSE -1 END AS INTEGER) AS state_number,
           CAST(CASE o_orderkey % 4 WHEN 0 THEN o_orderkey WHEN 1 THEN o_orderkey WHEN 2 THEN o_orderkey % 24 END AS INTEGER) AS metric_partition,
           's3://bucket/' || CASE o_orderkey % 4 WHEN 0 THEN 'a/b/' WHEN 1 THEN '' WHEN 2 THEN 'a/' ELSE 'a/b/' END
             || 'sp-' || (epoch_us(o_orderdate) // 1000) || '-id' || o_orderkey AS path
    FROM orders""")

# -- streams: what they write equals the batch form over the same records

for _key, _same in (
    ("src_business_events", "decode_business_events"),
    ("src_control_signals", "decode_control_signals"),
    ("stream_customer_state", "customer_state_changes"),
    ("stream_customer_state_chunked", "customer_state_changes"),
    ("stream_state_digest", "state_digest_at_offsets"),
    ("state_snapshot_read", "customer_state_latest"),
    ("stream_shadow_pair", "conditional_upsert"),
    ("stream_cutover", "conditional_upsert"),
    ("stream_heartbeat_watchdog", "heartbeat_gaps"),
):
    ORACLES[_key] = ORACLES[_same]
_oracle("stream_bootstrap", "changes", sql=f"""
    SELECT seq, event_id, {STATE} FROM changes WHERE seq > (SELECT max(event_id) // 2 FROM events)""")
_oracle("stream_state_evolution", "changes", sql=f"""
    SELECT seq, event_id, {STATE.replace('state_version', 'CASE WHEN seq <= middle THEN 1 ELSE 2 END AS state_version')},
           CAST(CASE WHEN seq > middle THEN greatest(held, max(CASE WHEN seq > middle THEN cents END) OVER w) END * 0.01 AS DECIMAL(18,2)) AS peak_amount
    FROM (SELECT *, coalesce(max_by(cents, seq) FILTER (WHERE seq <= middle) OVER (PARTITION BY customer_id), 0) AS held
          FROM changes, (SELECT max(event_id) // 2 AS middle FROM events))
    WINDOW w AS (PARTITION BY customer_id ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
_oracle("stream_shadow_counts", "business_events_ooo", sql="""
    SELECT app_id, sum(CASE WHEN (app_id = 'app1') = (seq < middle) THEN 1 ELSE 0 END)::BIGINT AS written,
           sum(CASE WHEN (app_id = 'app1') = (seq < middle) THEN 0 ELSE 1 END)::BIGINT AS dropped
    FROM business_events_ooo, (SELECT min(seq) + (max(seq) - min(seq) + 2) // 2 AS middle FROM business_events_ooo), (VALUES ('app1'), ('app2')) a(app_id)
    GROUP BY app_id""")
_oracle("stream_watermark", "business_events", sql="""
    SELECT event_ts_ms // 3600000 * 3600000 AS hour_ms, event_type, count(*) AS events FROM business_events
    WHERE (event_ts_ms // 3600000 + 1) * 3600000 <= (SELECT max(event_ts_ms) - 5000 FROM business_events) GROUP BY ALL""")
_oracle("stream_mode", "mode_signals", sql="""
    SELECT pair_id, app_id, mode, ts AS since_ms, "offset", trace_no
    FROM (SELECT *, lag(mode) OVER (PARTITION BY app_id ORDER BY "offset", trace_no) AS prev FROM mode_signals) WHERE prev <> mode""")
_oracle("stream_topic_modes", "mode_signals", sql="""
    SELECT pair_id, app_id, mode, ts AS since_ms, CAST(0 AS BIGINT) AS partition, ("offset" - 1704067200000 * 16) * 16777216 + trace_no AS "offset"
    FROM (SELECT *, lag(mode) OVER (PARTITION BY app_id ORDER BY "offset", trace_no) AS prev FROM mode_signals) WHERE prev <> mode""")
# what the wire shows: no trigger, no failed savepoint and no refused transfer
DERIVED["wire_outcomes"] = (("control_signals",), DERIVED["outcomes"][1].replace("FROM control_log", "FROM control_signals").replace(
    """min("timestamp") FILTER (WHERE signal_type = 'TRIGGER') AS triggered""", """min("timestamp") AS triggered"""))
_oracle("stream_topic_progress", "wire_outcomes", sql="""
    SELECT pair_id, trace_id, state, reason, assumed, triggered_ms, prepared_ms, drained_ms, confirmed_ms, finished_ms FROM wire_outcomes
    WHERE finished_ms <= (SELECT max("timestamp") FROM control_signals)""")

# -- pending cutovers

DERIVED["cutover_signals"] = (("control_signals",), """
    SELECT * REPLACE (CASE WHEN signal_type = 'PREPARE_HANDOFF' AND trace_no % 17 <> 0
                           THEN [("timestamp" - 1704067200000) // 1000 - (trace_no * 131 + p * 1777) % 50000 FOR p IN range(4)] END AS offsets)
    FROM control_signals""")
DERIVED["copy_positions"] = ((), """
    SELECT 'app' || copy || '-' || (user_id % 25) AS app_id, event_id % 4 AS partition, (epoch_us(ts) // 1000 - 1704067200000) // 1000 AS "offset",
           epoch_us(ts) // 1000 + CASE WHEN copy = 2 THEN event_id % 4 % 3 * 3600000 ELSE 0 END AS at_ms
    FROM events, (VALUES (1), (2)) c(copy)""")
DERIVED["pending"] = (("cutover_signals", "pairs"), """
    SELECT * FROM (
      SELECT s.pair_id, app_id, s."offset" AS place, trace_no, trace_id, signal_type, "timestamp" AS prepared_ms, offsets,
             lead("timestamp") OVER (PARTITION BY app_id ORDER BY s."offset", trace_no) AS ends_ms
      FROM cutover_signals s JOIN (SELECT pair_id, app1 AS app_id FROM pairs UNION ALL SELECT pair_id, app2 FROM pairs) p
        ON s.pair_id = p.pair_id AND (target_app_id = app_id OR target_app_id = 'broadcast')
      WHERE (signal_type = 'PREPARE_HANDOFF' AND offsets IS NOT NULL) OR signal_type IN ('HANDOFF_ABORT', 'DEMOTE'))
    WHERE signal_type = 'PREPARE_HANDOFF'""")
_oracle("drained_signals", "pending", "copy_positions", sql=f"""
    SELECT pair_id, app_id, trace_id, prepared_ms, greatest(prepared_ms, reached_ms) AS drained_ms, {_TEXT.format('offsets')} AS cutover_offsets
    FROM pending JOIN (
      SELECT app_id, place, trace_no, max(reached_ms) AS reached_ms FROM (
        SELECT a.app_id, place, trace_no, a.p, min(at_ms) AS reached_ms
        FROM (SELECT app_id, place, trace_no, p, offsets[p + 1] AS target FROM pending, range(4) t(p)) a
        JOIN copy_positions c ON c.app_id = a.app_id AND c.partition = a.p AND c."offset" >= target GROUP BY ALL)
      GROUP BY ALL HAVING count(*) = 4) USING (app_id, place, trace_no)
    WHERE reached_ms < prepared_ms OR ends_ms IS NULL OR reached_ms < ends_ms""")
ORACLES["stream_drained"] = ORACLES["drained_signals"]
_oracle("stream_handoff_progress", "outcomes", sql="""
    SELECT pair_id, trace_id, state, reason, assumed, triggered_ms, prepared_ms, drained_ms, confirmed_ms, finished_ms FROM outcomes
    WHERE finished_ms <= (SELECT max("timestamp") FROM control_log)""")
