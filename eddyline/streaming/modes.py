"""Which output modes a streaming plan may use (checked before starting).

Fixed values (Structured Streaming rules the operators rely on):
stateless: append, update; windowed aggregation: append (after watermark),
update, complete; session window: append; stream–stream join: append;
dropDuplicates: append, update; transformWithState: append, update;
real-time mode: update only.
"""

from __future__ import annotations

ALLOWED = {
    "stateless": ("append", "update"),
    "aggregation": ("append", "update", "complete"),
    "session_window": ("append",),
    "stream_join": ("append",),
    "dedup": ("append", "update"),
    "transform_with_state": ("append", "update"),
}
REALTIME_MODES = ("update",)


def check_output_mode(kind: str, mode: str, *, realtime: bool = False) -> str:
    """Return ``mode`` if allowed for an operator ``kind``, else raise ValueError."""
    mode = mode.lower()
    if kind not in ALLOWED:
        raise ValueError(f"unknown operator kind {kind!r}; one of {sorted(ALLOWED)}")
    if mode not in ALLOWED[kind]:
        raise ValueError(f"{kind} supports {ALLOWED[kind]}, not {mode!r}")
    if realtime and mode not in REALTIME_MODES:
        raise ValueError(f"real-time mode supports {REALTIME_MODES} only, not {mode!r}")
    return mode
