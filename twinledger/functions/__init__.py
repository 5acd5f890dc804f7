"""functions of the record-linkage engine."""
