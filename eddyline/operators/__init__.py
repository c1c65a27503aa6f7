"""Table-or-stream operators over event records."""
