"""Spark-native analytics for map-tile positioning: tile geometry, descriptor matching, telemetry and tracking."""
