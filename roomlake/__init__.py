"""Spatial scene analytics on Spark: scenes, visibility, relations and question tables."""
