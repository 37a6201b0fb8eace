"""A Spark-native engine: strict SQL over snapshots, versioned records, key-value ranges."""
