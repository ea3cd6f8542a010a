from tessera.streaming.jobs import (  # noqa: F401
    monitor_stream, run_available_now, score_stream, score_stream_reloading, source,
)
