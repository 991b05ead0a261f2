"""Options of one standby job, checked before anything starts."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from tandem.schemas import ACTIVE, SHADOW


@dataclass(frozen=True)
class StandbyConfig:
    app_id: str
    brokers: str
    initial_mode: str = SHADOW
    control_topic: str = "control-signals"
    control_group: str | None = None
    heartbeat_timeout_ms: int = 30_000
    heartbeat_interval_ms: int = 5_000

    def validate(self) -> StandbyConfig:
        if not self.app_id or not self.app_id.strip():
            raise ValueError("app_id is required")
        if not self.brokers or not self.brokers.strip():
            raise ValueError("brokers is required")
        if self.initial_mode not in (ACTIVE, SHADOW):
            raise ValueError(f"initial_mode must be {ACTIVE} or {SHADOW}, not {self.initial_mode!r}")
        if self.heartbeat_timeout_ms <= 0:
            raise ValueError("heartbeat_timeout_ms must be positive")
        if not 0 < self.heartbeat_interval_ms < self.heartbeat_timeout_ms:
            raise ValueError("heartbeat_interval_ms must be positive and below heartbeat_timeout_ms")
        return self

    @property
    def group(self) -> str:
        return self.control_group or f"control-{self.app_id}"

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> StandbyConfig:
        env = os.environ if env is None else env
        known = {
            "app_id": env.get("STANDBY_APP_ID", ""),
            "brokers": env.get("STANDBY_BROKERS", ""),
            "initial_mode": env.get("STANDBY_INITIAL_MODE", SHADOW).upper(),
        }
        for field, name in (("control_topic", "STANDBY_CONTROL_TOPIC"), ("control_group", "STANDBY_CONTROL_GROUP")):
            if env.get(name):
                known[field] = env[name]
        for field, name in (("heartbeat_timeout_ms", "STANDBY_HEARTBEAT_TIMEOUT_MS"), ("heartbeat_interval_ms", "STANDBY_HEARTBEAT_INTERVAL_MS")):
            if env.get(name):
                known[field] = int(env[name])
        return cls(**known).validate()
