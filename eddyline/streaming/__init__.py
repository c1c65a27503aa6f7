"""Structured Streaming: stateful processors, sinks, triggers, drain."""
