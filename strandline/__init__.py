"""A PySpark-native time-series engine: ingest policies, chunked storage, merged reads, log, codec and tag index."""
