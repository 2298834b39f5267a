"""Spark-first data work around large model training: inputs, statistics, scores, telemetry."""
