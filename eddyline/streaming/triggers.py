"""Trigger selection: micro-batch, drain-and-stop, or real-time mode.

PySpark's ``trigger()`` has no real-time argument; Spark 4.1's public
``Trigger.RealTime`` is set on the JVM writer.  Real-time mode needs a
source that supports it (Kafka), Update output mode, and — for stateful
operators — ``spark.sql.streaming.realTimeMode.allowlistCheck=false``.
"""

from __future__ import annotations

from pyspark.sql.streaming import DataStreamWriter

from eddyline.config import PipelineConfig
from eddyline.functions.durations import duration_us

RTM_ALLOWLIST_CONF = "spark.sql.streaming.realTimeMode.allowlistCheck"


def real_time_trigger(writer: DataStreamWriter, checkpoint_interval: str = "5 minutes"):
    """Set real-time mode with the public ``Trigger.RealTime(intervalMs)``
    factory; PySpark's ``trigger()`` cannot express it, so the JVM writer is
    configured directly.  ``checkpoint_interval`` is how often progress is
    checkpointed."""
    interval_ms = duration_us(checkpoint_interval) // 1000
    triggers = writer._spark._jvm.org.apache.spark.sql.streaming.Trigger
    writer._jwrite = writer._jwrite.trigger(triggers.RealTime(interval_ms))
    return writer


def set_trigger(writer: DataStreamWriter, mode: str = "microbatch", interval: str = "10 seconds",
                *, stateful: bool = False) -> DataStreamWriter:
    """``microbatch`` (every ``interval``), ``available_now`` or ``realtime``."""
    if mode == "microbatch":
        return writer.trigger(processingTime=interval)
    if mode == "available_now":
        return writer.trigger(availableNow=True)
    if mode == "realtime":
        if stateful:
            writer._spark.conf.set(RTM_ALLOWLIST_CONF, "false")
        return real_time_trigger(writer, interval)
    raise ValueError(f"unknown trigger mode {mode!r}")


def trigger_from_config(writer: DataStreamWriter, cfg: PipelineConfig, *,
                        stateful: bool = False) -> DataStreamWriter:
    interval = cfg.rtm_checkpoint_interval if cfg.mode == "realtime" else cfg.trigger_interval
    return set_trigger(writer, cfg.mode, interval, stateful=stateful)
