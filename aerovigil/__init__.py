"""Network-telemetry attack detection expressed as Spark DataFrame, ML and streaming jobs."""
