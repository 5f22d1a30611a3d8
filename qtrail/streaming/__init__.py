"""qtrail.streaming."""
