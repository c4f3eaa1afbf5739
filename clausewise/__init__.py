"""clausewise: a Spark-native engine for matching and auditing document collections."""
