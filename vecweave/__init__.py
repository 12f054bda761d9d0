"""vecweave: Spark-native analytics for graphs whose vertices carry vectors."""
