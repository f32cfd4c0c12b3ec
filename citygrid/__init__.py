"""Analytics on map features, printable models and telemetry, as Spark DataFrames."""
