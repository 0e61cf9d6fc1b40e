"""Differential network analytics of two sample groups, on Spark."""
