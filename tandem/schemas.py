"""Declared schemas (DDL) of the tables and names in the wire records; nothing is inferred."""

from __future__ import annotations

BUSINESS_EVENT = (
    "event_id STRING, customer_id STRING, event_type STRING, amount DECIMAL(18,2), event_ts_ms BIGINT, payload STRING"
)
CUSTOMER_STATE = (
    "customer_id STRING, order_count INT, total_amount DECIMAL(18,2), last_event_type STRING, last_updated_ms BIGINT, state_version INT"
)
CONTROL_SIGNAL = (
    "signal_type STRING, target_app_id STRING, source_app_id STRING, cutover_offsets MAP<INT,BIGINT>, "
    "coordinator_id STRING, timestamp BIGINT, trace_id STRING, reason STRING"
)
OFFSET_SNAPSHOT = "pair_id INT, group_id STRING, topic STRING, partition INT, offset BIGINT, observed_ms BIGINT"
SAVEPOINT = (
    "savepoint_id STRING, location STRING, kafka_offsets MAP<INT,BIGINT>, source_job_id STRING, target_job_id STRING, "
    "taken_at_ms BIGINT, status STRING"
)
STATE_HASH = "app_id STRING, state_key STRING, state_hash STRING, kafka_offset BIGINT, timestamp BIGINT, trace_id STRING"
LEADER_ATTEMPT = "pair_id INT, from_app STRING, to_app STRING, expected_version BIGINT, seq BIGINT"
LEASE_OP = "lock_id INT, coordinator_id STRING, op STRING, at_s BIGINT, seq BIGINT"
METRIC = "namespace STRING, metric_name STRING, dim_name STRING, dim_value STRING, value DOUBLE, unit STRING, ts_ms BIGINT"

CUTOVER_CHANGE = "pair_id INT, place1 BIGINT, place2 BIGINT, trace_id STRING, cutover_offsets MAP<INT,BIGINT>"

# Field names of the JSON records.
BUSINESS_EVENT_WIRE = {
    "event_id": "eventId",
    "customer_id": "customerId",
    "event_type": "eventType",
    "amount": "amount",
    "event_ts_ms": "eventTimestamp",
    "payload": "payload",
}
CONTROL_SIGNAL_WIRE = {
    "signal_type": "signalType",
    "target_app_id": "targetAppId",
    "source_app_id": "sourceAppId",
    "cutover_offsets": "cutoverOffsets",
    "coordinator_id": "coordinatorId",
    "timestamp": "timestamp",
    "trace_id": "traceId",
    "reason": "reason",
}

# Signal types, handoff states in order, and the address of all apps.
SIGNAL_TYPES = (
    "PREPARE_HANDOFF",
    "PROMOTE",
    "DEMOTE",
    "DRAINED_AT",
    "PROMOTED_CONFIRMED",
    "HEARTBEAT",
    "HANDOFF_ABORT",
)
SAVEPOINT_STATUSES = ("IN_PROGRESS", "COMPLETED", "FAILED")
HANDOFF_STATES = (
    "IDLE",
    "SAVEPOINT_IN_PROGRESS",
    "WAITING_FOR_APP2_CATCHUP",
    "HANDOFF_INITIATED",
    "WAITING_FOR_APP1_DRAIN",
    "PROMOTING_APP2",
    "HANDOFF_COMPLETE",
    "HANDOFF_FAILED",
)
BROADCAST = "broadcast"
ACTIVE = "ACTIVE"
SHADOW = "SHADOW"
