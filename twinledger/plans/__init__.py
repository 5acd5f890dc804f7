"""plans of the record-linkage engine."""
