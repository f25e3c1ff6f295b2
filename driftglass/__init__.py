"""Driftglass: Spark-native regression testing of retrieval pipelines."""
