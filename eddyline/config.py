"""Pipeline configuration (brokers, topics, group, mode) from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass

_MODES = ("microbatch", "realtime", "available_now")


@dataclass(frozen=True)
class PipelineConfig:
    bootstrap_servers: str = "localhost:9092"
    input_topic: str = "benchmark-input"
    output_topic: str = "benchmark-output"
    group_id: str | None = None
    mode: str = "microbatch"
    trigger_interval: str = "10 seconds"
    rtm_checkpoint_interval: str = "5 minutes"
    starting_offsets: str = "latest"
    max_offsets_per_trigger: int | None = None
    shuffle_partitions: int | None = None

    def __post_init__(self):
        if self.mode not in _MODES:
            raise ValueError(f"mode must be one of {_MODES}, got {self.mode!r}")

    @classmethod
    def from_env(cls, env: dict | None = None, **overrides) -> "PipelineConfig":
        """Read the reference's variables; ``USE_RTM=1`` selects real-time mode."""
        env = os.environ if env is None else env
        kw = {}
        if env.get("KAFKA_BOOTSTRAP_SERVERS"):
            kw["bootstrap_servers"] = env["KAFKA_BOOTSTRAP_SERVERS"]
        if env.get("INPUT_TOPIC"):
            kw["input_topic"] = env["INPUT_TOPIC"]
        if env.get("OUTPUT_TOPIC"):
            kw["output_topic"] = env["OUTPUT_TOPIC"]
        if env.get("GROUP_ID"):
            kw["group_id"] = env["GROUP_ID"]
        if env.get("USE_RTM", "0") == "1":
            kw["mode"] = "realtime"
        if env.get("MAX_OFFSETS_PER_TRIGGER"):
            kw["max_offsets_per_trigger"] = int(env["MAX_OFFSETS_PER_TRIGGER"])
        if env.get("SHUFFLE_PARTITIONS"):
            kw["shuffle_partitions"] = int(env["SHUFFLE_PARTITIONS"])
        kw.update(overrides)
        return cls(**kw)
