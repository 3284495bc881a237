"""Disclosure-drift analytics on Spark: DataFrame operators over filing tables."""
