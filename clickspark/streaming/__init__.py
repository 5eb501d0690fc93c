from clickspark.streaming.ingest import stream_clean_events  # noqa: F401
