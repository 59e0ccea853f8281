"""Spark-native operators for object-visibility timelines and spatial question records."""
