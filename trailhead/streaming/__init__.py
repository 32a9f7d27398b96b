"""Stream forms of the batch operators. Sources are Structured Streaming frames; state lives in RocksDB."""
