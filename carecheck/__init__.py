"""Facility truth checks on Spark: clean, score, search and audit a listing of care facilities."""
