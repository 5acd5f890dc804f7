"""streaming of the record-linkage engine."""
