"""Spark-native text reframing, lineage and validation engine."""
