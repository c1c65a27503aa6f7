"""eddyline — event-stream analytics as plain Spark DataFrame functions.

Every operator takes a DataFrame that may be a table (batch) or a stream
(``df.isStreaming``) and builds a Catalyst plan; nothing runs until the
caller acts on the result.  Batch forms are checked against SQL, stream
forms against the batch forms.
"""

from eddyline.session import get_session, scratch_dir

__all__ = ["get_session", "scratch_dir"]
