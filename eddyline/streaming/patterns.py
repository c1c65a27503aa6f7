"""The four reference event-stream jobs as runnable streaming queries.

``build(pattern, events)`` returns the transformed stream for decoded
event records; ``start(...)`` wires source → decode → transform → sink →
trigger with a :class:`PipelineConfig` (Kafka by default, files for
replay).  Command line::

    python -m eddyline.streaming.patterns 02 --source files --path DIR \
        --sink parquet --out DIR --checkpoint DIR --mode available_now
"""

from __future__ import annotations

import argparse

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from eddyline.config import PipelineConfig
from eddyline.functions.decode import cast_message, decode_events, with_event_time_col
from eddyline.functions.encode import to_kafka_rows
from eddyline.operators.filters import keep_types
from eddyline.operators.windows import sliding, tumbling, with_event_time
from eddyline.schema import KAFKA_SOURCE_SCHEMA
from eddyline.sources.events import read_events
from eddyline.streaming.modes import check_output_mode
from eddyline.streaming.stateful import running_count_stream
from eddyline.streaming.triggers import trigger_from_config

#: What it does, output mode of micro-batches, statefulness.
PATTERNS = {
    "01": ("stateless filter → Kafka rows", "append", False),
    "02": ("count per key and 1-minute tumbling window", "update", True),
    "03": ("average per key, 5-minute window sliding 1 minute", "update", True),
    "04": ("running count per key (stateful aggregation or processor)", "update", True),
}


def build(pattern: str, events: DataFrame, engine: str = "aggregate") -> DataFrame:
    if pattern == "01":
        return to_kafka_rows(keep_types(events), key_col="event_id")
    if pattern == "02":
        return tumbling(with_event_time(events))
    if pattern == "03":
        return sliding(with_event_time(events))
    if pattern == "04":
        return running_count_stream(with_event_time(events), engine=engine)
    raise ValueError(f"unknown pattern {pattern!r}; choose from {sorted(PATTERNS)}")


#: Documented rate limit of pattern 04's job (rows per trigger).
PATTERN_04_OFFSETS = 10_000
KINDS = {"01": "stateless", "02": "aggregation", "03": "aggregation", "04": "aggregation"}


def output_mode(pattern: str, cfg: PipelineConfig, engine: str = "aggregate") -> str:
    """The pattern's mode, checked against its operator; real-time mode takes
    Update only, also for the stateless pattern."""
    realtime = cfg.mode == "realtime"
    mode = "update" if realtime else PATTERNS[pattern][1]
    kind = "transform_with_state" if pattern == "04" and engine == "processor" else KINDS[pattern]
    return check_output_mode(kind, mode, realtime=realtime)


def with_rate_limit(pattern: str, cfg: PipelineConfig) -> PipelineConfig:
    """Pattern 04 reads 10 000 offsets a trigger unless the configuration says
    otherwise (real-time mode has no batches to limit)."""
    if pattern == "04" and cfg.max_offsets_per_trigger is None and cfg.mode != "realtime":
        return replace(cfg, max_offsets_per_trigger=PATTERN_04_OFFSETS)
    return cfg


def source(spark: SparkSession, cfg: PipelineConfig, kind: str, path: str | None,
           max_files: int | None = None) -> DataFrame:
    """Kafka, or files (all new files a trigger unless ``max_files`` is given)."""
    if kind == "kafka":
        raw = read_events(spark, "kafka", cfg=cfg, stream=True)
    else:
        opts = {"maxFilesPerTrigger": str(max_files)} if max_files else {}
        raw = read_events(spark, "parquet", path, stream=True, schema=KAFKA_SOURCE_SCHEMA,
                          options=opts)
    return with_event_time_col(decode_events(cast_message(raw)))


def start(spark: SparkSession, pattern: str, cfg: PipelineConfig, *, source_kind: str = "kafka",
          path: str | None = None, sink: str = "kafka", out: str | None = None,
          checkpoint: str, engine: str = "aggregate", max_files: int | None = None):
    stateful = PATTERNS[pattern][2]
    mode, cfg = output_mode(pattern, cfg, engine), with_rate_limit(pattern, cfg)
    if cfg.shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(cfg.shuffle_partitions))
    result = build(pattern, source(spark, cfg, source_kind, path, max_files), engine)
    if sink == "kafka":
        if pattern != "01":
            from pyspark.sql import functions as F
            result = result.select(F.to_json(F.struct("*")).alias("value"))
        w = (result.writeStream.format("kafka")
             .option("kafka.bootstrap.servers", cfg.bootstrap_servers)
             .option("topic", cfg.output_topic))
    elif sink == "console":
        w = result.writeStream.format("console").option("truncate", "false")
    elif sink == "parquet":
        if mode == "update":
            from eddyline.streaming.sinks import upsert_sink
            w = result.writeStream.foreachBatch(upsert_sink(out))
        else:
            w = result.writeStream.format("parquet").option("path", out)
    else:
        raise ValueError(f"unknown sink {sink!r}")
    w = w.outputMode(mode).option("checkpointLocation", checkpoint).queryName(f"pattern_{pattern}")
    return trigger_from_config(w, cfg, stateful=stateful).start()


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("pattern", choices=sorted(PATTERNS))
    ap.add_argument("--source", default="kafka", choices=["kafka", "files"])
    ap.add_argument("--path")
    ap.add_argument("--sink", default="kafka", choices=["kafka", "console", "parquet"])
    ap.add_argument("--out")
    ap.add_argument("--checkpoint", required=True)
    ap.add_argument("--mode", default=None, choices=["microbatch", "realtime", "available_now"])
    ap.add_argument("--timeout", type=float, default=None)
    ap.add_argument("--engine", default="aggregate", choices=["aggregate", "processor"],
                    help="pattern 04: built-in stateful aggregation or value-state processor")
    a = ap.parse_args(argv)
    from eddyline.session import get_session
    spark = get_session(app=f"pattern-{a.pattern}")
    cfg = PipelineConfig.from_env(**({"mode": a.mode} if a.mode else {}))
    q = start(spark, a.pattern, cfg, source_kind=a.source, path=a.path, sink=a.sink, out=a.out,
              checkpoint=a.checkpoint, engine=a.engine)
    q.awaitTermination(a.timeout)


if __name__ == "__main__":
    main()
