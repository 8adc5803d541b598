"""Trajectory, assignment and detection analytics as lazy Spark DataFrame transformations."""

__version__ = "0.1.0"
