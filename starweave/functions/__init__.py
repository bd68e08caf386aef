"""Scalar functions of the measure language as Spark columns."""
