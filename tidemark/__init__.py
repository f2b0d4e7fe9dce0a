"""tidemark: Spark-native analytics over time-stamped case records with a binary outcome."""
