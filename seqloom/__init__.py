"""seqloom: Spark-native analytics over sequences, signal tracks and token tables."""
