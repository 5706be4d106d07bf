"""Incremental ingestion. The analyses themselves are batch (the original work
has no streaming, windows over time or late data); this package only turns newly
arriving comment files into Parquet once, with Structured Streaming's exactly-once
file sink, so the batch analyses can scan splittable columnar files."""
