"""civicfeed: city-event analytics expressed as Spark DataFrame, SQL and streaming jobs."""
