"""Live trades as Structured Streaming: bars, deduplication, late data, staleness, online state, sinks and upserts."""
