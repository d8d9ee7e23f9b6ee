"""Content-risk analytics on Spark: detectors, roll-ups, sources, sinks and streams."""
