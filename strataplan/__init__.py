"""Spark-native analytics over laser-scan point clouds and 2D plan geometry."""
