"""Event sources: Kafka, file streams, rate, and the driver's tables."""

from eddyline.sources.events import read_events, read_kafka
from eddyline.sources.tables import driver_events, load_table, orders_as_events, to_messages
from eddyline.sources.files import stage_stream_files, file_stream

__all__ = ["read_events", "read_kafka", "driver_events", "load_table", "orders_as_events",
           "to_messages", "stage_stream_files", "file_stream"]
