"""Spark-native analytics for high-throughput screening laboratories.

Every public function takes and returns DataFrames; Catalyst picks the physical plan.
"""
