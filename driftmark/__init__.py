"""Geolocation of tagged animals on Spark: observations, emission fields, movement models and tracks."""
