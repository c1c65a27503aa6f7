"""Column-level functions: decode, encode, event time, percentiles."""

from eddyline.functions.decode import (
    cast_message, decode_events, decode_with_key, event_time_col, flexible_event_time,
    with_event_time_col,
)
from eddyline.functions.encode import (
    render_count_line, render_window_line, to_json_payload, to_kafka_rows, with_processed_at,
)
from eddyline.functions.percentile import nearest_rank_index

__all__ = [
    "cast_message", "decode_events", "decode_with_key", "event_time_col", "flexible_event_time",
    "with_event_time_col", "render_count_line", "render_window_line", "to_json_payload",
    "to_kafka_rows", "with_processed_at", "nearest_rank_index",
]
