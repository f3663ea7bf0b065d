"""A Spark-native engine for preparing and synthesizing text data."""
