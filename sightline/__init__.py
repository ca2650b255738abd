"""Disclosure analytics as Spark jobs: every public function maps DataFrames to a DataFrame."""
