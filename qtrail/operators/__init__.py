"""qtrail.operators."""
