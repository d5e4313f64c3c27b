from stratamart.streaming.incremental import stream_append, stream_upsert  # noqa: F401
