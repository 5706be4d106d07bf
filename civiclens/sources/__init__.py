"""Sources (CSV, Parquet, GeoJSON, census sheets), sinks, and the test fixtures."""
