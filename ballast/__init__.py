"""Ballast: Spark jobs that prepare, rebalance, synthesize and evaluate imbalanced tables."""
from ballast.spec import TableSpec

__all__ = ["TableSpec"]
