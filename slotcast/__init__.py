"""Spark-native forecasting panels: time grids, profiles, rolling fits, scores and tests."""
