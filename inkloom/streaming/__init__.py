"""Incremental ingestion. An extension: the engine's own operators are batch."""
