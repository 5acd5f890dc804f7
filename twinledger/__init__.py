"""Record linkage and master-data quality on Spark."""
