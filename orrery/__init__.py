"""A Spark-native retrieval and data-preparation engine."""
